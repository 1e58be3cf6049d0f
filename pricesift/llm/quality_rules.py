"""Quality rules with risk-controlled cutoffs.

Each rule is a ratio of two counts of a text, turned into an integer level of
``1/LEVELS``; a cutoff ``c`` rejects a text whose level is ``c`` or more. For each
stratum the rules and cutoffs are chosen so that, with probability 1 - ``delta`` over all
strata together, no stratum loses more than ``risk`` of its good documents to them:

1. Which rules share the risk is settled by the labelled bad documents that pass the base
   rules: the rule that reaches most of them, then the one that reaches most of the rest,
   and so on, but no more rules than the number of good labels can clear. Nothing about
   the good documents but their number is used, so the tests below stay valid.
2. With m rules each hypothesis is "this cutoff rejects more than ``risk / m`` of the good
   documents"; with ``k`` of ``n`` good documents rejected, the exact binomial tail
   P(Bin(n, risk / m) <= k) is its p-value, tested at ``delta / (strata * m)``
   (Bonferroni). The cutoffs of a rule are nested and tested from the strictest down until
   one fails (fixed sequence), so they need no correction among themselves.
3. Of a rule's proven cutoffs the one with the largest gap between bad and good documents
   rejected is taken, the loosest of equals, if there is a gap.

The cutoff grid is fixed beforehand and nothing else is fitted, so every labelled row is
holdout. A stratum without enough good labels gets no cutoff and loses nothing.

Base rules: fewer than 10 words, or over a fifth of the words in 5-word windows
that the text holds more than once.

Defined cases: a null or empty text has no words and fails the base rules; null
strata are one stratum; null labels are ignored and a document labelled more than
once counts as bad if any label is 0; repeated rows each get the same verdict;
without labels only the base rules decide; other columns are kept by ``keep_good``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_shared

LEVELS = 40
REPEAT_WORDS = 5
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
#: Rule: (counted, out of).
RULES = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"),
         "repeats": ("n_repeat_words", "n_words"), "capitals": ("n_capitals", "word_chars"),
         "bangs": ("n_bangs", "n_words"), "echoes": ("n_echoes", "n_words")}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
          "n_capitals", "n_bangs", "n_echoes"]


def _repeat_words(words: list[bytes], hashes: np.ndarray) -> int:
    """Words inside 5-word windows that occur twice or more; hashes only rule texts out."""
    n = len(words) - REPEAT_WORDS + 1
    if n < 2:
        return 0
    rolled = np.zeros(n, np.uint64)
    for i in range(REPEAT_WORDS):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[i:i + n]
    rolled.sort()
    if not (rolled[1:] == rolled[:-1]).any():
        return 0
    windows = list(zip(*(words[i:i + n] for i in range(REPEAT_WORDS)), strict=True))
    counts = Counter(windows)
    start = np.fromiter((counts[w] > 1 for w in windows), bool, n)
    hit = np.zeros(len(words), bool)
    for i in range(REPEAT_WORDS):
        hit[i:i + n] |= start
    return int(hit.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of ``COUNTS``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    n_spaces = len(raw) - len(raw.translate(None, SPACES))
    echoes = np.flatnonzero(hashes[1:] == hashes[:-1]).tolist()
    return (len(words), len(text or "") - n_spaces, len(raw) - len(raw.translate(None, SYMBOLS)),
            len(lines), len(lines) - len(set(lines)), _repeat_words(words, hashes),
            len(raw) - len(raw.translate(None, CAPITALS)), raw.count(b"!"),
            sum(words[i] == words[i + 1] for i in echoes))


def counts_column(text_col: str) -> Column:
    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([measure(t) for t in s], columns=COUNTS, dtype="int64")

    return run(F.col(text_col))


def base_failed(counts: str = "counts") -> Column:
    c = F.col(counts)
    return (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])


def levels(counts: str = "counts") -> Column:
    """map<rule, level>; a ratio over nothing has level 0."""
    c = F.col(counts)
    pairs = []
    for rule, (top, bottom) in RULES.items():
        ratio = F.when(c[bottom] > 0, F.floor(F.lit(LEVELS) * c[top] / F.greatest(c[bottom], F.lit(1)))).otherwise(F.lit(0))
        pairs += [F.lit(rule), F.least(ratio, F.lit(LEVELS)).cast("int")]
    return F.create_map(*pairs)


def binomial_tail(n: int, k: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly up to rounding; 1 where k is not below the mean."""
    if k >= n * p:
        return 1.0
    log = (math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    term, total = 1.0, 1.0  # terms relative to the largest, that of k
    for i in range(k, 0, -1):
        term *= i * (1 - p) / ((n - i + 1) * p)
        total += term
        if term < 1e-17 * total:
            break
    return min(1.0, math.exp(log) * total)


def cover(masks: dict[int, int]) -> list[str]:
    """Rules by the bad documents that they reach and no earlier one does; ``masks`` counts documents by reached rules."""
    rules, out, left = list(RULES), [], dict(masks)
    while True:
        reach = [sum(n for m, n in left.items() if m >> i & 1) for i in range(len(rules))]
        best = max(range(len(rules)), key=lambda i: (reach[i], -i))
        if not reach[best]:
            return out
        out.append(rules[best])
        left = {m: n for m, n in left.items() if not m >> best & 1}


def narrowed(masks: dict[int, int], hist: dict[str, dict[int, tuple[int, int]]], risk: float, delta: float) -> dict[str, int]:
    """Cutoffs of one stratum by rule; ``hist`` is rule -> level -> (good, bad)."""
    n, n_bad = (sum(x[i] for x in next(iter(hist.values())).values()) for i in (0, 1))
    order = cover(masks)
    while order and binomial_tail(n, 0, risk / len(order)) > delta / len(order):
        order.pop()
    out = {}
    for rule in order:
        k, bad_k, best = 0, 0, (0.0, 0)
        for cutoff in range(LEVELS, 0, -1):
            good, bad = hist[rule].get(cutoff, (0, 0))
            k, bad_k = k + good, bad_k + bad
            if binomial_tail(n, k, risk / len(order)) > delta / len(order):
                break
            best = max(best, (bad_k / max(n_bad, 1) - k / n, cutoff))
        if best[0] > 0:
            out[rule] = best[1]
    return out


def select_cutoffs(labelled: DataFrame, risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """(stratum, cutoffs map<rule, level>) from (stratum, good, levels) rows of labelled documents;
    the risk is shared by the rules that the bad documents call for."""
    reached = sum((F.when(F.element_at("levels", r) > 0, 1 << i).otherwise(0) for i, r in enumerate(RULES)), F.lit(0))
    masks = (labelled.where("good = 0").groupBy("stratum", F.lit("").alias("rule"), reached.alias("level"))
             .agg(F.lit(0).cast("long").alias("good"), F.count(F.lit(1)).alias("bad")))
    rows = labelled.select("stratum", "good", F.explode("levels").alias("rule", "level"))
    hist = rows.groupBy("stratum", "rule", "level").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    both = write_shared(hist.unionByName(masks), "rule-levels")
    strata = max(1, both.groupBy("stratum").agg(F.sum("good").alias("g")).where("g > 0").count())

    def select(rows: pd.DataFrame) -> pd.DataFrame:
        masks, hist = {}, {rule: {} for rule in RULES}
        for rule, level, good, bad in zip(rows["rule"], rows["level"], rows["good"], rows["bad"], strict=True):
            if rule:
                hist[rule][int(level)] = int(good), int(bad)
            else:
                masks[int(level)] = int(bad)
        found = narrowed(masks, hist, risk, delta / strata)
        stratum = rows["stratum"].iloc[0]
        return pd.DataFrame([(stratum, *f) for f in found.items()], columns=["stratum", "rule", "cutoff"], dtype="object")

    best = both.groupBy("stratum").applyInPandas(select, "stratum string, rule string, cutoff int")
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05, id_col: str = "doc_id",
          stratum_col: str = "lang") -> DataFrame:
    """``docs`` with a ``_ps_counts`` column -> the same rows with ``_ps_base_failed`` and ``_ps_kept``."""
    marks = (labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_ps_id"))
             .agg(F.min("quality").alias("quality")))
    labelled = (docs.select(F.col(id_col).alias("_ps_id"), F.col(stratum_col).cast("string").alias("stratum"),
                            levels("_ps_counts").alias("levels"), base_failed("_ps_counts").alias("failed"))
                .join(marks, "_ps_id").select("stratum", (F.col("quality") == 1).cast("long").alias("good"), "levels", "failed")
                .where("good = 1 OR NOT failed"))  # bad documents that the base rules leave to the cutoffs
    cut = write_shared(select_cutoffs(labelled, risk, delta), "cutoffs")
    cut = cut.select(F.col("stratum").alias("_ps_stratum"), F.col("cutoffs").alias("_ps_cutoffs"))
    joined = docs.join(cut, F.col(stratum_col).cast("string").eqNullSafe(F.col("_ps_stratum")), "left")
    level = levels("_ps_counts")
    none = F.coalesce("_ps_cutoffs", F.create_map().cast("map<string,int>"))
    rejected = F.exists(F.map_entries(none), lambda e: F.element_at(level, e["key"]) >= e["value"])
    return (joined.withColumn("_ps_base_failed", base_failed("_ps_counts"))
            .withColumn("_ps_kept", ~(F.col("_ps_base_failed") | rejected))
            .drop("_ps_stratum", "_ps_cutoffs"))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """Documents that pass the base rules and the selected cutoffs, all columns kept.

    Texts are measured once; the measured table is written to the shared folder,
    so neither the second pass nor a join moves the texts through a shuffle again.
    """
    measured = write_shared(docs.withColumn("_ps_counts", counts_column(text_col)), "measured")
    return judge(measured, labels, **options).where("_ps_kept").select(*docs.columns)
