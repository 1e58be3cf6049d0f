"""The shop feed data source."""
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In
from pyspark.sql.types import StructType

from pricesift.operators.retrieval import by_shop
from pricesift.sources import registry
from pricesift.sources import shop_feed as S
from pricesift.sources import tables as T


def feed(spark, sf):
    offers = T.shop_offers(spark, sf).select(*[c.split()[0] for c in S.SCHEMA.split(", ")])
    return offers, by_shop(offers).inputFiles()[0].split("/shop=")[0]


def test_reads_registered_shops_and_prunes_files(spark, sf):
    offers, path = feed(spark, sf)
    known = {(r[0], r[1]) for r in registry.registry_rows()}
    got = S.read_feed(spark, path)
    want = [r for r in offers.collect() if (r.shop, r.shop_country) in known]
    key = lambda r: tuple((v is not None, v) for v in r.asDict().values())
    names = [c.split()[0] for c in S.SCHEMA.split(", ")]
    assert sorted(map(key, got.select(*names).collect())) == sorted(map(key, want)) and len(want) < offers.count()
    shop, country = want[0].shop, want[0].shop_country
    one = got.where((F.col("shop") == shop) & (F.col("shop_country") == country) & (F.col("rating") > 2)).agg(F.count("*"), F.min("shop_country"), F.max("shop"))
    assert tuple(one.first()) == (sum((r.shop, r.shop_country) == (shop, country) and (r.rating or 0) > 2 for r in want), country, shop)
    uri = path if path.startswith("file:") else f"file://{path}"
    reader = S.ShopFeedReader(StructType.fromDDL(S.SCHEMA), uri, known)
    files = len(reader.partitions())
    rest = list(reader.pushFilters([EqualTo(("shop_country",), country), In(("shop",), (shop, "nobody")), GreaterThan(("rating",), 2.0)]))
    assert rest == [GreaterThan(("rating",), 2.0)] and 0 < len(reader.partitions()) < files
    assert {(p.shop, p.shop_country) for p in reader.partitions()} == {(shop, country)}
    assert S.read_feed(spark, path).select("product_name").where("shop = 'nobody'").count() == 0


def test_a_new_shop_is_read_once_it_is_registered(spark, tmp_path, monkeypatch):
    for name in ("SHOP_ORDER", "EXTRA_SHOPS"):
        monkeypatch.setattr(registry, name, list(getattr(registry, name)))
    for name in ("URL_TEMPLATES", "PRICE_RULES"):
        monkeypatch.setattr(registry, name, dict(getattr(registry, name)))
    columns = [c.split()[0] for c in S.SCHEMA.split(", ")]
    df = spark.createDataFrame([("Corner Shop", "FR", 1, 2, "Pixel", "EUR", "9,99", None, None, 3, "1", "me")], S.SCHEMA).select(*columns)
    df.write.partitionBy("shop", "shop_country").parquet(str(tmp_path / "feed"))
    assert S.read_feed(spark, str(tmp_path / "feed")).count() == 0
    registry.register_shop("Corner Shop", [("FR", "corner.example", "EUR")], "https://{domain}/?q={q}")
    assert [tuple(r) for r in S.read_feed(spark, str(tmp_path / "feed")).select(*columns).collect()] == [tuple(r) for r in df.collect()]
