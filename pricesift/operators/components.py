"""Connected components of an edge table by alternating star contraction.

Each round links every node to the smallest node it knows: first its larger
neighbours (large star), then its smaller ones (small star). Both are grouped
minima and joins on narrow rows; a hub's rows are combined map-side before the
shuffle and its join is one that Spark splits when skewed. Every round is written
to the shared folder, so a lost executor repeats one round at most, and nothing
but two scalars a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_shared


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    if large:
        pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    out = pairs.join(least, "a")
    if large:
        return out.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return (out.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())


def _state(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an (a, b) edge table of any ordered type.

    ``root`` is the smallest node of the component.
    """
    now = write_shared(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                       .where("a <> b").distinct(), "edges")
    before = _state(now)
    while before[0]:
        now = write_shared(_star(_star(now, True), False), "edges")
        after = _state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
