"""Benchmark decontamination as a prefix-filtered set join, in Spark expressions only.

Every benchmark item is cut into windows of ``window`` consecutive words (an item
of fewer words is one window). Exact containment of a window needs all of its
words, so one necessary word, its *prefix*, is enough to join on: the rarest of
the window by its count over all documents. A document word equal to a prefix
proposes one alignment; the length and position bounds discard alignments that
would leave the document, and the words of the alignment are compared one by
one. Words whose count is zero rule their windows out before the join. The words
of all documents are written once, blank-separated, to the shared folder.

The windows are broadcast in blocks of at most ``block_windows`` rows, counted
first, so the broadcast side has a proven bound whatever the benchmark holds;
each block is joined with all documents. Exploded words stay inside one code
generation stage: only verified occurrences leave it, so nothing is shuffled
but word counts of benchmark words and the hits.

Defined cases: a null text has no words; a null or empty item has no window; a
null ``item_id`` counts as the empty id; rows of equal id and text get equal
results; documents keep one output row per input row; an empty benchmark leaves
every document clean. Extra columns are ignored by ``find`` and kept by
``drop_contaminated``.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_shared
from .common import row_key

#: What parts words: ASCII other than letters of either case and digits.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def spaced(text_col: str) -> Column:
    """The words of a text, as written, with one blank between them."""
    return F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), GAP, " "))


def plain(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def benchmark_windows(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """Distinct (item, words) windows of the benchmark."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
                             plain(spaced(text_col)).alias("said")).where("said <> ''")
    items = items.select("item", F.split("said", " ").alias("all_words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("all_words") - window + 1, F.lit(1)))
    return (items.select("item", F.explode(F.transform(starts, lambda s: F.slice("all_words", s, window))).alias("win"))
            .distinct())


def with_prefix(windows: DataFrame, said: DataFrame, block_words: int) -> DataFrame:
    """Add each window's rarest word (by its count over all documents) and that word's place.

    Words are counted in full lower case, which only merges them: no match can be lost.
    """
    vocabulary = write_shared(windows.select(F.explode("win").alias("w"))
                              .select(F.lower("w").alias("token")).distinct(), "bench-words")
    n = vocabulary.count()
    blocks = max(1, -(-n // block_words))
    spoken = said.select(F.explode_outer(F.split(F.lower("said"), " ")).alias("token"))

    def counted(b: int) -> DataFrame:
        block = vocabulary.where(F.pmod(F.xxhash64("token"), F.lit(blocks)) == b)
        return spoken.join(F.broadcast(block), "token").groupBy("token").count()

    counts = reduce(DataFrame.unionByName, [counted(b) for b in range(blocks)])
    return (windows.select("item", "win", F.posexplode("win").alias("place", "w"))
            .withColumn("token", F.lower("w"))
            .join(counts, "token")
            .groupBy("item", "win")
            .agg(F.min(F.struct("count", "place", "token")).alias("rarest"), F.count("*").alias("known"))
            .where(F.col("known") == F.size("win"))
            .select("item", F.array_join("win", " ").alias("win"), F.size("win").alias("len"),
                    F.col("rarest.place").alias("place"), F.col("rarest.token").alias("token")))


def occurrences(said: DataFrame, windows: DataFrame, block_windows: int) -> DataFrame:
    """(_ps_key, start, len, item) of every window that a document holds.

    Every expression here compiles into one code generation stage, and the outer
    explode keeps the optimizer from tokenising twice for an emptiness filter: a
    document's words are held once and never copied to its exploded rows.
    """
    n = windows.count()
    blocks = max(1, -(-n // block_windows))
    spoken = (said.select("_ps_key", F.split("said", " ").alias("doc_words"))
              .select("_ps_key", "doc_words", F.posexplode_outer("doc_words").alias("pos", "w"))
              .withColumn("token", F.lower("w")))

    def found(b: int) -> DataFrame:
        block = windows.where(F.pmod(F.xxhash64("item", "win"), F.lit(blocks)) == b)
        start = F.col("pos") - F.col("place")
        aligned = (spoken.join(F.broadcast(block), "token")
                   .where((start >= 0) & (start + F.col("len") <= F.size("doc_words"))))
        same = plain(F.array_join(F.slice("doc_words", start + 1, F.col("len")), " ")) == F.col("win")
        return aligned.where(same).select("_ps_key", start.alias("start"), "len", "item")

    return reduce(DataFrame.unionByName, [found(b) for b in range(blocks)])


def covered(spans: Column) -> Column:
    """Number of words inside any of the sorted (start, end) spans."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))

    def step(acc, s):
        return F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], acc["to"]))).alias("n"),
                        F.greatest(acc["to"], s["end"]).alias("to"))

    return F.aggregate(F.sort_array(spans), zero, step, lambda acc: acc["n"])


def find(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id",
         text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text",
         block_windows: int = 200_000, block_words: int = 500_000) -> DataFrame:
    """One row per document row: (id, _ps_key, n_words, n_hit, items, spans).

    ``items`` are the ids (as strings, sorted) of the benchmark items of which at
    least one window occurs; ``spans`` the matched word ranges (end exclusive).
    """
    said = write_shared(docs.select(F.col(id_col), row_key(id_col, text_col).alias("_ps_key"),
                                    spaced(text_col).alias("said")), "said")
    windows = benchmark_windows(benchmark, window, item_col, bench_text_col)
    prefixed = write_shared(with_prefix(windows, said, block_words), "bench-windows")
    start, end = F.col("start").cast("long"), (F.col("start") + F.col("len")).cast("long")
    hits = (occurrences(said, prefixed, block_windows)
            .groupBy("_ps_key")
            .agg(F.collect_set(F.struct(start.alias("start"), end.alias("end"))).alias("spans"),
                 F.sort_array(F.collect_set("item")).alias("items")))
    n_words = F.octet_length("said") - F.octet_length(F.replace("said", F.lit(" "), F.lit(""))) + 1
    base = said.select(id_col, "_ps_key", F.when(F.col("said") == "", 0).otherwise(n_words).cast("long").alias("n_words"))
    joined = base.join(hits, "_ps_key", "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return joined.select(
        id_col, "_ps_key", "n_words",
        F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce(F.sort_array("spans"), none).alias("spans"))


def is_contaminated(share: int = 20) -> Column:
    """At least one word in ``share`` is hit."""
    return (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents without the contaminated ones, with all their columns."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    bad = find(docs, benchmark, **options).where(is_contaminated()).select("_ps_key").distinct()
    keyed = docs.withColumn("_ps_key", row_key(id_col, text_col))
    return keyed.join(bad, "_ps_key", "left_anti").drop("_ps_key")
