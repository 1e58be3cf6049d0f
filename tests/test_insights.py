"""Insight goldens on the three fixed offers (FIXTURES.md section 2)."""
from pricesift.operators import aggregates as AG
from pricesift.operators import insights as I

ROWS = [(1, "999", 999.0, "Apple Store", 4.8, 1), (1, "1049", 1049.0, "Best Buy", 4.7, 2),
        (1, "1099", 1099.0, "Amazon", 4.6, 3)]
SCHEMA = "query_id long, price string, price_num double, seller string, rating double, rank long"


def test_price_stats_and_best_deal(spark):
    r = spark.createDataFrame(ROWS, SCHEMA)
    s = AG.price_stats(r).collect()[0]
    assert (s.n, s.min_price, s.max_price, s.avg_price, s.spread, s.high_spread) == (3, 999, 1099, 1049, 100, False)
    b = AG.best_deal(r).collect()[0]
    assert (b.best_price, b.best_seller) == ("999", "Apple Store")
    rs = AG.rating_summary(r).collect()[0]
    assert round(rs.avg_rating, 6) == 4.7 and rs.best_rated_seller == "Apple Store"


def test_price_and_comparison_text(spark):
    r = spark.createDataFrame(ROWS, SCHEMA)
    ctx = spark.createDataFrame([(1, 1000.0, 1200.0)], "query_id long, exp_min double, exp_max double")
    p = I.price_insight(r, ctx).collect()[0]
    assert p.content == ("Found 3 results with prices ranging from $999 to $1099.\nAverage price: $1049\n"
                         "💰 Great deal! Lowest price ($999) is below expected range ($1000.0-$1200.0)\n"
                         "🏆 Best price: $999 from Apple Store")
    assert p.confidence == 0.9
    c = I.comparison_insight(r).collect()[0]
    assert c.content == ("Found products from 3 different sellers:\n📱 Apple Store: $999\n📱 Best Buy: $1049\n"
                         "📱 Amazon: $1099\n⭐ Average rating: 4.7/5\n🌟 Highest rated: 4.8/5 from Apple Store")


def test_half_even_formatting(spark):
    r = spark.createDataFrame([(1, "2", 2.0, "a", None, 1), (1, "3", 3.0, "a", None, 2),
                               (1, "4", 4.0, "b", None, 3), (1, "1", 1.0, "b", None, 4)], SCHEMA)
    p = I.price_insight(r, spark.createDataFrame([], "query_id long, exp_min double, exp_max double")).collect()[0]
    assert "Average price: $2\n" in p.content     # 2.5 rounds half to even
    assert "High price variance ($3)" in p.content


def test_knowledge_of_asked_products_equals_the_rows_of_all(spark, sf):
    from pricesift.sources import tables as T
    asked = T.queries(spark, sf).selectExpr("query_id as product_id").where("product_id % 3 = 0")
    want = T.knowledge(spark, sf).join(asked, "product_id", "left_semi")
    found = T.knowledge(spark, sf, asked)
    assert found.count() == want.count() == asked.count()
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))


def test_alternatives_are_three_of_the_nearest_without_the_part_itself(spark):
    from pricesift.sources import tables as T
    prices = [5.0] * 6 + [5.5, 6.0, 6.0, 9.0, 9.0, 40.0, 41.0]
    rows = [(k, "A" if k < 12 else "B", p, f"n{k}") for k, p in enumerate(prices)]
    parts = spark.createDataFrame(rows, "p_partkey long, p_type string, p_retailprice double, name string")
    got = {r["_pk"]: r["alternatives"] for r in T.alternatives_of_parts(parts, parts.where("p_partkey % 2 = 0")).collect()}
    assert got == {k: [n for _, _, n in sorted((abs(p - q), j, m) for j, u, q, m in rows if u == t and j != k)[:3]]
                   for k, t, p, _ in rows if k % 2 == 0}


def test_bands_are_found_once_for_all_that_read_them(spark, sf):
    import glob

    from pricesift.plans.catalog import spark_queries
    from pricesift.session import _WRITTEN, ensure_checkpoint_dir
    written = lambda: set(glob.glob(ensure_checkpoint_dir(spark).removeprefix("file:") + "/alternatives-*"))
    _WRITTEN.pop((spark.sparkContext.applicationId, "bands", sf), None)
    before = written()
    for name in ("alternative_bands", "insight_recommendation", "alternative_bands"):
        spark_queries()[name](spark, sf).count()
    assert len(written() - before) == 1


def test_no_side_of_the_size_of_part_is_broadcast(spark, sf):
    from pyspark.sql import functions as F

    from pricesift.plans import q_vectors as V
    from pricesift.sources import tables as T
    texts = T.queries(spark, sf).select(F.col("query_id").alias("id"), F.col("query").alias("text"))
    plan = V.text_hits(spark, sf, texts)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [doc_id" in plan
    plan = V._enhance(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin [") - plan.count("SortMergeJoin [p_type") >= 3
