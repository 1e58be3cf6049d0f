"""Rank score (F7), per-query rank (W1), result limit (T2), output form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pricing import clean_price_us, price_digits, us_rule
from ..session import write_shared
from ..settings import DEFAULT, Settings
from ..sources.registry import RELIABILITY
from ..sources.tables import ARRIVAL


def reliability(source) -> Column:
    m = F.create_map(*[x for k, v in RELIABILITY.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, F.lower(F.col(source))), F.lit(DEFAULT.default_reliability))


def availability_bonus(col: str = "availability") -> Column:
    a = F.lower(F.col(col))
    return F.when(a.isin("in stock", "available"), 0.15).when(a.contains("limited"), 0.1).otherwise(0.0)


def rank_score(similarity: str = "similarity", source: str = "source", availability: str = "availability",
               rating: str = "rating", reviews: str = "reviews_count", shipping: str = "shipping_cost",
               price: str = "norm_price", settings: Settings = DEFAULT, stage_shipping: bool = False) -> Column:
    """F7, terms added in the reference's order, clamped to [0, 1]."""
    r, n = F.col(rating), F.col(reviews)
    rating_t = F.when(r.isNotNull() & (r != 0), F.least(r / 5.0, F.lit(1.0)) * 0.1).otherwise(0.0)
    reviews_t = F.when(n.isNotNull() & (n != 0), F.least(F.log10(n + 1) / 4.0, F.lit(1.0)) * 0.1).otherwise(0.0)
    ship = F.col("_ship") if stage_shipping else clean_price_us(shipping)
    has_ship = F.coalesce(F.length(F.col(shipping)), F.lit(0)) > 0
    ship_t = F.when(has_ship & ship.isNotNull() & (ship != 0),
                    -F.least(ship / F.col(price) * 0.05, F.lit(0.05)))
    if settings.free_shipping_bonus:
        ship_t = ship_t.when(has_ship & (ship == 0), 0.05)
    score = (F.col(similarity) * 0.4 + reliability(source) * 0.2 + availability_bonus(availability)
             + rating_t + reviews_t + ship_t.otherwise(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def with_rank_score(df: DataFrame, out: str = "score", **kw) -> DataFrame:
    """Adds the F7 score with the parsed shipping amount staged once per row."""
    return (df.withColumn("_ship", us_rule(price_digits(F.col(kw.get("shipping", "shipping_cost")))))
            .withColumn(out, rank_score(stage_shipping=True, **kw)).drop("_ship"))


def rank_within_query(df: DataFrame, score: str = "score", price: str = "norm_price",
                      key: str = "query_id", skew_safe: bool | None = None) -> DataFrame:
    """1..n by score desc, price asc, then arrival order."""
    order = [F.col(score).desc(), F.col(price).asc(), *[F.col(c).asc() for c in ARRIVAL]]
    use_range = DEFAULT.skew_safe_rank if skew_safe is None else skew_safe
    if use_range:
        return row_number_by_range(df, key, order, "rank")
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("bigint"))


def row_number_by_range(df: DataFrame, key: str, order: list[Column], out: str = "rank") -> DataFrame:
    """Exact ``row_number() over (partition by key order by ...)`` that splits hot keys.

    1. The input is written once, since choosing the ranges reads it before the shuffle does.
    2. Range-partition on (key, order...) and sort each partition: a key holding
       a third of all rows spans a third of the partitions instead of one task.
       ``monotonically_increasing_id`` numbers rows in sorted order inside each
       partition; writing the table freezes partition ids and positions.
    3. A small table of (partition, key) -> first id, count gives every key's
       offset in the earlier partitions (a window over <= partitions + keys rows).
    4. rank = id - first id of the (partition, key) + offset + 1.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = write_shared(df, "to-rank")
    s = write_shared(df.repartitionByRange(n, F.col(key), *order).sortWithinPartitions(F.col(key), *order)
                     .withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()), "sorted")
    stats = s.groupBy("_pid", key).agg(F.min("_mid").alias("_m0"), F.count("*").alias("_c"))
    w = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = write_shared(stats.withColumn("_off", F.coalesce(F.sum("_c").over(w), F.lit(0))).drop("_c"), "offsets")
    # The offsets table has at most (partitions + keys) rows; broadcast it when
    # its checked size is small so the sorted data is not shuffled again.
    if stats.count() <= DEFAULT.broadcast_max_rows:
        stats = F.broadcast(stats)
    return (s.join(stats, ["_pid", key])
            .withColumn(out, (F.col("_mid") - F.col("_m0") + F.col("_off") + 1).cast("bigint"))
            .drop("_pid", "_mid", "_m0", "_off"))


def top_n_per_query(df: DataFrame, score: str = "score", price: str = "norm_price",
                    key: str = "query_id", limit_col: str = "max_results",
                    bound: int | None = None) -> DataFrame:
    """Keep rank <= max_results (<= 0 means no limit).

    Rows of queries with a positive limit are ranked with ``row_number() <=
    bound`` where ``bound`` (the largest limit, read from the small queries
    table) is a literal, so Spark adds a partial WindowGroupLimit before the
    shuffle and a hot query ships at most ``bound`` rows per task. Only queries
    without a limit need the full rank (range-partitioned, see
    ``row_number_by_range``).
    """
    if bound is None:
        return rank_within_query(df, score, price, key).filter(
            (F.col(limit_col) <= 0) | (F.col("rank") <= F.col(limit_col)))
    order = [F.col(score).desc(), F.col(price).asc(), *[F.col(c).asc() for c in ARRIVAL]]
    w = Window.partitionBy(key).orderBy(*order)
    limited = (df.filter(F.col(limit_col) > 0)
               .withColumn("rank", F.row_number().over(w).cast("bigint"))
               .filter(F.col("rank") <= F.lit(int(max(bound, 1))))
               .filter(F.col("rank") <= F.col(limit_col)))
    unlimited = rank_within_query(df.filter(F.col(limit_col) <= 0), score, price, key)
    return limited.unionByName(unlimited)


def limit_bound(queries: DataFrame, limit_col: str = "max_results") -> int:
    """Largest positive result limit over the queries table (a scalar)."""
    v = queries.agg(F.max(limit_col).alias("m")).first()["m"]
    return int(v) if v is not None and v > 0 else 0


def offer_output(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """camelCase output, price as the truncated integer string."""
    return df.select(
        "query_id", "l_orderkey", "l_linenumber", "product_id", "seller_id",
        F.col("link"), F.col("norm_price").cast("bigint").cast("string").alias("price"),
        F.col("norm_currency").alias("currency"), F.col("product_name").alias("productName"),
        "availability", "rating", F.col("reviews_count").alias("reviewsCount"), "seller",
        F.col("shipping_cost").alias("shippingCost"), "source",
        F.round("similarity", 6).alias("similarityScore"), "rank", *(extra or []))
