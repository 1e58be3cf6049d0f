"""Query and product feature goldens (FIXTURES.md section 3-4)."""
from pyspark.sql import functions as F

from pricesift.functions import features as FT


def qf(spark, text):
    df = spark.createDataFrame([(text,)], "q string")
    return df.select(FT.query_features("q").alias("f")).collect()[0].f.asDict()


def test_query_features(spark):
    f = qf(spark, "OnePlus 12 256GB")
    assert (f["storage"], f["storage_gb"], f["brand"], f["model"]) == ("256GB", 256, "Oneplus", "Oneplus 12")
    f = qf(spark, "iPhone 16 Pro")
    assert f["model"] == "Iphone 16 Pro" and f["brand"] is None
    f = qf(spark, "MacBook Pro M3")
    assert (f["brand"], f["model"]) == ("Macbook", "Macbook Pro M3")
    f = qf(spark, "phone under 1000")
    assert all(v is None for v in f.values())
    f = qf(spark, "2 terabyte rose gold s24-ultra")
    assert (f["storage"], f["storage_gb"], f["color"]) == ("2TB", 2048, "Rose Gold")


def test_product_features(spark):
    q = "iPhone 16 Pro 128GB"
    rows = [("Apple iPhone 16 Pro 128GB - Natural Titanium", "apple", "iphone 16 pro", "128GB", "pro"),
            ("Samsung Galaxy S24 Ultra 256GB", "apple", "s24 ultra", "256GB", "pro")]
    df = spark.createDataFrame([(r[0], q) for r in rows], "n string, q string")
    got = df.select(FT.product_features("n", "q").alias("f")).collect()
    for g, r in zip(got, rows):
        assert (g.f.brand, g.f.model, g.f.storage, g.f.color) == r[1:]


def test_hints(spark):
    df = spark.createDataFrame([("phone",), ("Apple iPhone 16 Pro 128GB",)], "q string")
    got = df.select(FT.query_hints("q", FT.query_features("q")).alias("h")).collect()
    assert got[0].h == [FT.HINT_VAGUE, FT.HINT_BRAND, FT.HINT_STORAGE, FT.HINT_MODEL]
    assert got[1].h == []
