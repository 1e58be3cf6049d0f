"""Per-query result summaries (A1-A8) and per-product price profiles.

All are grouped aggregates with partial (map-side) aggregation, so a hot query
is combined in every task before the shuffle. "First row" choices use
``min(struct(key, order...))`` which is exact on ties and also combines
map-side (``min_by`` picked the last tied row when checked).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def price_stats(results: DataFrame, price: str = "price_num", key: str = "query_id") -> DataFrame:
    """A1/A2: n, min, max, mean, spread; only queries with >= 2 results."""
    g = (results.groupBy(key)
         .agg(F.count("*").alias("n"), F.min(price).alias("min_price"), F.max(price).alias("max_price"),
              F.avg(price).alias("avg_price"))
         .filter(F.col("n") >= 2))
    spread = F.col("max_price") - F.col("min_price")
    return g.withColumn("spread", spread).withColumn("high_spread", spread > F.col("avg_price") * 0.3)


def price_verdict(stats: DataFrame, expected: DataFrame, key: str = "query_id") -> DataFrame:
    """A3: deal when the lowest price is under the expected minimum, high when over the maximum."""
    j = stats.join(expected, key, "left")
    v = (F.when(F.col("exp_min").isNull(), F.lit(None))
         .when(F.col("min_price") < F.col("exp_min"), "deal")
         .when(F.col("min_price") > F.col("exp_max"), "high")
         .otherwise("none"))
    return j.withColumn("verdict", v)


def best_deal(results: DataFrame, price: str = "price_num", order: str = "rank",
              key: str = "query_id") -> DataFrame:
    """A4: first row (in result order) with the lowest price."""
    b = results.groupBy(key).agg(F.min(F.struct(F.col(price).alias("p"), F.col(order).alias("o"),
                                                F.col("seller").alias("seller"),
                                                F.col("price").alias("price"))).alias("b"))
    return b.select(key, F.col("b.price").alias("best_price"), F.col("b.seller").alias("best_seller"),
                    F.col("b.o").alias("best_rank"))


def seller_summary(results: DataFrame, price: str = "price_num", order: str = "rank",
                   key: str = "query_id") -> DataFrame:
    """A5: per seller offers, min, max and first-seen position; sellers per query."""
    s = (results.withColumn("seller_key", F.coalesce("seller", F.lit("Unknown")))
         .groupBy(key, "seller_key")
         .agg(F.count("*").alias("n_offers"), F.min(price).alias("min_price"),
              F.max(price).alias("max_price"), F.min(order).alias("first_seen"),
              F.min(F.struct(F.col(order), F.col("price"))).getField("price").alias("first_price")))
    n = s.groupBy(key).agg(F.count("*").alias("n_sellers"))
    return s.join(n, key)


def rating_summary(results: DataFrame, order: str = "rank", key: str = "query_id") -> DataFrame:
    """Mean of truthy ratings and the first best-rated row."""
    r = results.filter(F.col("rating").isNotNull() & (F.col("rating") != 0))
    return (r.groupBy(key)
            .agg(F.avg("rating").alias("avg_rating"),
                 F.min(F.struct((-F.col("rating")).alias("nr"), F.col(order).alias("o"),
                                F.col("seller").alias("seller"))).alias("b"))
            .select(key, "avg_rating", (-F.col("b.nr")).alias("best_rating"),
                    F.col("b.seller").alias("best_rated_seller")))


def group_best(df: DataFrame, group_cols: list[str], order_cols: list[str]) -> DataFrame:
    """Best member per group (similarity desc, price asc, arrival) + F17 group id."""
    best = F.min(F.struct((-F.col("similarity")).alias("ns"), F.col("norm_price").alias("np"),
                          *[F.col(c) for c in order_cols], F.col("product_name").alias("best_name")))
    g = df.groupBy(*group_cols).agg(best.alias("b"), F.count("*").alias("group_size"))
    return g.select(*group_cols, "group_size", "b.*").withColumn(
        "group_id", F.substring(F.md5(F.col("best_name")), 1, 8))


def product_price_range(points: DataFrame) -> DataFrame:
    """Stored price range per product, computed from observed points."""
    return (points.groupBy("product_id")
            .agg(F.min("price").alias("price_min"), F.max("price").alias("price_max"),
                 F.avg("price").alias("price_avg")))
