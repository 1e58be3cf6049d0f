import math
import random
from collections import Counter
from fractions import Fraction

from helpers import empty_docs, odd_docs, odd_texts, word_list
from pyspark.sql import functions as F

from pricesift.llm import quality_rules as Q


def plain_measure(text):
    t, w = text or "", word_list(text)
    counts = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if counts[tuple(w[i:i + 5])] > 1:
            hit |= set(range(i, i + 5))
    lines = [x for x in t.split("\n") if word_list(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines), len(lines) - len(set(lines)), len(hit),
            sum("A" <= c <= "Z" for c in t), t.count("!"), sum(a == b for a, b in zip(w, w[1:], strict=False)))


def test_measures_equal_plain_counts():
    rng = random.Random(8)
    texts = odd_texts() + [" ".join(rng.choice(["a", "b", "c|", "!D", "\n", "x\ny"]) for _ in range(rng.randrange(60))) for _ in range(200)]
    for t in texts:
        assert Q.measure(t) == plain_measure(t)


def test_binomial_tail_is_exact():
    for n, k, p in [(100, 0, 0.01), (1200, 3, 0.0083), (500, 2, 0.05), (40, 1, 0.05), (3000, 10, 0.0083)]:
        exact = sum(math.comb(n, i) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k + 1))
        assert abs(Q.binomial_tail(n, k, p) / float(exact) - 1) < 1e-9
    assert Q.binomial_tail(10, 5, 0.1) == 1.0 and Q.binomial_tail(0, 0, 0.1) == 1.0


def labelled(spark, n_good, level_good, n_bad, level_bad, stratum="en"):
    rows = [(stratum, 1, level_good(i)) for i in range(n_good)] + [(stratum, 0, level_bad(i)) for i in range(n_bad)]
    df = spark.createDataFrame(rows, "stratum string, good long, x int")
    return df.select("stratum", "good", F.create_map(*[v for r in Q.RULES for v in (F.lit(r), F.when(F.lit(r) == "symbols", F.col("x")).otherwise(0))]).alias("levels"))


def test_cutoffs_keep_their_bound_and_need_enough_labels(spark):
    rows = labelled(spark, 4000, lambda i: 20 if i % 16 == 0 else 2, 500, lambda i: 10)  # 6 % of the good reach level 20
    rows = rows.unionByName(labelled(spark, 60, lambda i: 0, 50, lambda i: 30, "few")).unionByName(
        labelled(spark, 4000, lambda i: 0, 50, lambda i: 30, None))
    got = {r.stratum: r.cutoffs for r in Q.select_cutoffs(rows).collect()}
    # losing 6 % exceeds the risk at any cutoff up to 20, and nothing bad lies above: no cutoff there
    assert "en" not in got and "few" not in got and got[None] == {"symbols": 30}
    loose = {r.stratum: r.cutoffs for r in Q.select_cutoffs(rows, risk=0.08).collect()}
    assert loose["en"] == {"symbols": 10}
    assert Q.binomial_tail(4000, 250, 0.08) <= 0.05 / 3 and Q.binomial_tail(4000, 250, 0.05) > 0.05 / 3
    assert Q.binomial_tail(60, 0, 0.05) > 0.05 / 3


def test_narrowed_rules_serve_small_strata_and_keep_the_bound(spark):
    rows = labelled(spark, 300, lambda i: 0, 50, lambda i: 30, "few").unionByName(
        labelled(spark, 70, lambda i: 0, 50, lambda i: 30, "fewer")).unionByName(
        labelled(spark, 1000, lambda i: 20 if i % 10 == 0 else 0, 50, lambda i: 10 + 20 * (i % 2), None))  # a tenth of the good at 20
    assert {r.stratum: r.cutoffs for r in Q.select_cutoffs(rows).collect()} == {"few": {"symbols": 30}, None: {"symbols": 30}}
    text = "one two three four five six seven eight nine ten eleven "
    docs = spark.createDataFrame([(i, text + ("|" * 30 if i % 5 == 0 else f"w{i}"), "de") for i in range(500)], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 5 != 0).cast("int").alias("quality"))
    assert sorted(r.doc_id for r in Q.keep_good(docs, labels).collect()) == [i for i in range(500) if i % 5]


def test_narrowed_false_rejection_stays_within_delta():
    rng, over, runs = random.Random(5), 0, 400
    for _ in range(runs):  # a twentieth of the good lies at or above every level from 20 down: each such cutoff is just too loose
        k = sum(rng.random() < 0.0501 for _ in range(500))
        hist = {r: {0: (500, 40)} for r in Q.RULES} | {"symbols": {0: (500 - k, 0), 20: (k, 0), 10: (0, 40)}}
        over += bool(Q.narrowed({1: 40}, hist, 0.05, 0.05))
    assert over <= 0.08 * runs


def test_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(5, 1), (5, 0), (6, None), (None, 1), (9, 1), (999, 0)], "doc_id long, quality int")
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    want = [r for r in docs.collect() if (m := plain_measure(r.text))[0] >= 10 and 100 * m[5] <= 20 * m[0]]
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")
    assert sorted(map(key, kept.collect())) == sorted(map(key, want))
    assert Q.keep_good(docs, labels.limit(0)).count() == len(want)
    counted = docs.withColumn("_ps_counts", Q.counts_column("text"))
    judged = Q.judge(counted, labels.withColumn("level", F.lit(1)).withColumn("stratum", F.lit("x")).withColumn("lang", F.lit("en"))).collect()
    assert len(judged) == docs.count() and sum(r._ps_kept for r in judged) == len(want)
    assert Q.judge(empty_docs(spark).withColumn("_ps_counts", Q.counts_column("text")), labels).count() == 0
    assert Q.keep_good(empty_docs(spark), labels).count() == 0
