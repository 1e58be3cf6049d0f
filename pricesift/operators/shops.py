"""Shop selection per query (J1, P7, P8, P9, T1) and the search-URL frontier.

The registry is a fixed literal of a few dozen rows, so it is broadcast; the
per-query window below only ever sees the handful of shops of one query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.registry import SHOP_ORDER, US_FALLBACK, source_registry


def shops_for_queries(queries: DataFrame, apply_lists: bool = True) -> DataFrame:
    spark = queries.sparkSession
    reg = F.broadcast(source_registry(spark))
    q = queries.withColumn("country_uc", F.upper("country"))
    j = q.join(reg.withColumnRenamed("country", "country_uc"), "country_uc")
    if apply_lists:
        inc = F.transform("include_sources", lambda s: F.lower(s))
        exc = F.transform("exclude_sources", lambda s: F.lower(s))
        src = F.lower("source")
        j = j.filter((F.coalesce(F.size("include_sources"), F.lit(0)) <= 0) | F.array_contains(inc, src))
        j = j.filter(~F.coalesce(F.array_contains(exc, src), F.lit(False)))
    w = Window.partitionBy("query_id").orderBy("priority", "reg_order")
    return j.withColumn("shop_rank", F.row_number().over(w).cast("bigint"))


def search_urls(queries: DataFrame) -> DataFrame:
    """One URL per query and shop; Amazon/eBay fall back to US for unknown countries."""
    spark = queries.sparkSession
    reg = source_registry(spark)
    here = F.broadcast(reg.select("source", F.col("country").alias("_c"), F.col("domain").alias("_d")))
    us = F.broadcast(reg.filter(F.col("country") == "US")
                     .select(F.col("source").alias("_s2"), F.col("domain").alias("_us")))
    tmpl = F.broadcast(reg.select("source", "url_template").distinct()
                       .withColumnRenamed("source", "_s3"))
    f = queries.select("query_id", "query", F.upper("country").alias("country"),
                       F.explode(F.array(*[F.lit(s) for s in SHOP_ORDER])).alias("source"))
    f = (f.join(here, (f.source == here.source) & (f.country == here._c), "left").drop(here.source)
         .join(us, f.source == us._s2, "left").join(tmpl, f.source == tmpl._s3, "left"))
    fallback = F.col("source").isin(*sorted(US_FALLBACK))
    domain = F.when(F.col("_d").isNotNull(), F.col("_d")).when(fallback, F.col("_us"))
    url = F.replace(F.replace("url_template", F.lit("{domain}"), F.coalesce(domain, F.lit(""))),
                    F.lit("{q}"), F.url_encode("query"))
    return f.select("query_id", "source", url.alias("url"))
