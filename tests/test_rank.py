"""Fixed-shop goldens (FIXTURES.md section 2): similarity, F7 score and rank."""
import datetime as dt

from pyspark.sql import functions as F

from pricesift.functions.text import name_similarity_udf
from pricesift.operators.normalize import normalize_offers
from pricesift.operators.rank import offer_output, rank_score, top_n_per_query

Q = "iPhone 16 Pro, 128GB"
T0 = dt.datetime(2025, 1, 1)
ROWS = [
    (1, "Apple iPhone 16 Pro 128GB - Natural Titanium", "999", "In Stock", 4.8, 1247, None, "MockStore"),
    (2, "Apple iPhone 16 Pro 256GB - Blue Titanium", "1099", "In Stock", 4.9, 892, "0", "MockStore"),
    (3, "Apple iPhone 16 Pro 512GB - White Titanium", "1299", "Limited Stock", 4.7, 634, "15", "MockStore Premium"),
]


def offers(spark):
    data = [(1, Q, 50, "USD", i, i, i, i, T0, n, p, "USD", a, r, c, s, "MockStore", sl, f"https://x/{i}")
            for i, n, p, a, r, c, s, sl in ROWS]
    schema = ("query_id long, query string, max_results int, target_currency string, l_orderkey long, "
              "l_linenumber int, product_id long, seller_id long, scraped_at timestamp, product_name string, "
              "price string, currency string, availability string, rating double, reviews_count long, "
              "shipping_cost string, source string, seller string, link string")
    return spark.createDataFrame(data, schema)


def test_scores_and_ranks(spark):
    o = normalize_offers(offers(spark)).withColumn("similarity", name_similarity_udf("product_name", "query"))
    o = o.withColumn("score", rank_score())
    got = top_n_per_query(o).select("l_orderkey", F.round("similarity", 3).alias("s"),
                                    F.round("score", 6).alias("score"), "rank").orderBy("rank").collect()
    assert [(r.l_orderkey, r.s, r.score, r.rank) for r in got] == [
        (1, 0.848, 0.782605, 1), (2, 0.722, 0.730571, 2), (3, 0.730, 0.675492, 3)]


def test_output_form(spark):
    o = normalize_offers(offers(spark)).withColumn("similarity", F.lit(0.5)).withColumn("score", rank_score())
    out = offer_output(top_n_per_query(o)).orderBy("rank").collect()
    assert [r.price for r in out] == ["999", "1099", "1299"] and out[0].currency == "USD"
    assert set(out[0].asDict()) >= {"productName", "reviewsCount", "shippingCost", "similarityScore", "rank"}


def test_conversion_and_unknown_currency(spark):
    df = spark.createDataFrame([("1000", "INR", "USD"), ("10", "XYZ", "USD"), ("0", "USD", "USD"),
                                ("€100", None, "USD")], "price string, currency string, target_currency string")
    got = [(r.norm_price, r.norm_currency) for r in normalize_offers(df).collect()]
    assert got == [(12.0, "USD"), (10.0, "XYZ"), (110.00000000000001, "USD")]


def test_range_rank_equals_window_on_skewed_keys(spark):
    from pyspark.sql import Window

    from pricesift.operators.rank import row_number_by_range
    # key 0 holds most rows; ties on score are broken by the unique id
    df = spark.range(0, 5000).select(
        F.when(F.col("id") % 10 < 7, F.lit(0)).otherwise(F.col("id") % 13).alias("k"),
        (F.col("id") % 17).cast("double").alias("score"), F.col("id"))
    order = [F.col("score").desc(), F.col("id")]
    a = row_number_by_range(df, "k", order, "r").select("k", "id", "r")
    b = df.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(*order)).cast("bigint"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select("k", "id", "r").collect()))


def test_register_shop_extends_registry(spark):
    from pricesift.sources import registry as R
    if "Mock Shop" not in R.SHOP_ORDER:
        R.register_shop("Mock Shop", [("US", "mock.example", "USD")], "https://{domain}/find?q={q}")
    rows = R.source_registry(spark).filter("source = 'Mock Shop'").collect()
    assert [(r.country, r.domain, r.price_rule) for r in rows] == [("US", "mock.example", "us")]


def test_topn_writes_only_the_columns_it_shows(spark, sf, monkeypatch):
    from pricesift.operators import rank
    from pricesift.plans.q_pricing import topn_offers
    written = []
    keep = rank.write_shared
    monkeypatch.setattr(rank, "write_shared", lambda df, name, *a: written.append((name, df.columns)) or keep(df, name, *a))
    topn_offers(spark, sf)
    columns = dict(written)["to-rank"]
    assert "score" in columns and not {"link", "seller", "product_name", "shipping_cost", "price"} & set(columns)
