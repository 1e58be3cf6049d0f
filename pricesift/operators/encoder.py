"""Text vectors for knowledge search (X2): hashed term counts, inverse document frequency, unit length.

A token's place is the first 28 bits of its MD5 modulo the dimension, so the same
vectors can be computed anywhere. Counting is grouped aggregation over exploded
tokens; the document frequencies are a table of at most ``dim`` rows, whose broadcast
is bounded whatever the corpus holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

DIM = 256


def term_counts(texts: DataFrame, key: str, text: str, dim: int = DIM) -> DataFrame:
    """(key, place, n): how often each hashed term occurs in a text."""
    place = F.conv(F.substring(F.md5("token"), 1, 7), 16, 10).cast("bigint") % dim
    return (texts.select(key, F.explode(tokens(text)).alias("token"))
            .groupBy(key, place.cast("int").alias("place")).agg(F.count("*").alias("n")))


def document_weights(counts: DataFrame, n_docs: int) -> DataFrame:
    """(place, idf) = ln((N + 1) / (df + 1)) over the documents."""
    return counts.groupBy("place").agg(F.log(F.lit(n_docs + 1.0) / (F.count("*") + 1)).alias("idf"))


def vectors(counts: DataFrame, weights: DataFrame, key: str, dim: int = DIM) -> DataFrame:
    """(key, vec array<float>): weighted counts at their places; unknown terms weigh nothing."""
    w = counts.join(F.broadcast(weights), "place").select(key, "place", (F.col("n") * F.col("idf")).cast("float").alias("w"))
    terms = w.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("place", "w"))).alias("terms"))
    zero = F.lit(0.0).cast("float")
    return terms.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(
        F.try_element_at("terms", i), zero)).alias("vec"))
