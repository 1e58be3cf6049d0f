"""Rolling price history (W2, W3, W4) and price learning in batch (M1).

Keep-last-30 is ``row_number() <= 30`` with a literal bound, which Spark plans
as a partial WindowGroupLimit before the shuffle: a product with a third of all
points still ships only 30 rows per task. Trend and current price are then
conditional aggregates over those <= 30 rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..settings import DEFAULT

ORDER = ["observed_at", "seq", "seq2"]


def last_points(points: DataFrame, keep: int = DEFAULT.history_keep) -> DataFrame:
    """Newest ``keep`` points per product, rn = 1 is the newest."""
    w = Window.partitionBy("product_id").orderBy(*[F.col(c).desc() for c in ORDER])
    return points.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= keep)


def trend_of(last: DataFrame) -> DataFrame:
    """Current price, trend (newest vs third newest) and last update per product."""
    g = last.groupBy("product_id").agg(
        F.count("*").alias("n_points"),
        F.max(F.when(F.col("rn") == 1, F.col("price"))).alias("current_price"),
        F.max(F.when(F.col("rn") == 3, F.col("price"))).alias("third_price"),
        F.max(F.when(F.col("rn") == 1, F.col("observed_at"))).alias("last_updated"),
        F.min("observed_at").alias("oldest_kept"),
        F.max(F.when(F.col("rn") == 1, F.col("product_name"))).alias("product_name"))
    trend = (F.when(F.col("n_points") < 3, "stable")
             .when(F.col("current_price") > F.col("third_price"), "increasing")
             .when(F.col("current_price") < F.col("third_price"), "decreasing")
             .otherwise("stable"))
    return g.withColumn("price_trend", trend).drop("third_price")


def learn_prices(history: DataFrame, new_points: DataFrame | None = None,
                 keep: int = DEFAULT.history_keep) -> DataFrame:
    """M1 batch: union old history with new points, keep 30, derive the insight row.

    New products get the reference's defaults ("Monitor for trends",
    "Insufficient data for analysis", no prediction).
    """
    pts = history if new_points is None else history.unionByName(new_points)
    pts = pts.filter(F.col("product_name").isNotNull() & (F.col("product_name") != "")
                     & F.col("price").isNotNull())
    t = trend_of(last_points(pts, keep))
    return (t.withColumn("best_time_to_buy", F.lit("Monitor for trends"))
            .withColumn("price_prediction", F.lit(None).cast("double"))
            .withColumn("market_analysis", F.lit("Insufficient data for analysis")))


def history_arrays(last: DataFrame) -> DataFrame:
    """Nested export form: ARRAY<STRUCT<date, price, source>> oldest first (<= 30 items)."""
    return (last.groupBy("product_id")
            .agg(F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in ORDER], "price", "source")))
                 .alias("pts"))
            .select("product_id", F.transform("pts", lambda p: F.struct(
                F.date_format(p["observed_at"], "yyyy-MM-dd'T'HH:mm:ss").alias("date"),
                p["price"].alias("price"), p["source"].alias("source"))).alias("historical_prices")))
