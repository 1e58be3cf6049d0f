"""The shops' front and the sparse index, held against plain loops."""
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pricesift.operators import retrieval as R
from pricesift.operators.sparse_index import build_index, query_terms, search
from pricesift.session import input_state, once
from pricesift.sources.registry import registry_rows

NAMES = ["Samsung Galaxy S21 Ultra 128GB Black", "Galaxy S21 Ultra 128GB - Black (Unlocked)", "Google Pixel 5 Pro 64GB", "Pixel 5 Pro - White", "Nokia G10", ""]
COUNTRY_OF = {"Amazon": ["US", "IN", "DE"], "Walmart": ["US"], "eBay": ["US", "DE"], "Flipkart": ["IN"], "Other": ["US"]}


def fixture(spark):
    rng = random.Random(1)
    offers = [(i, i % 7, rng.choice(NAMES), shop, rng.choice(COUNTRY_OF[shop])) for i in range(400) for shop in [rng.choice(list(COUNTRY_OF))]]
    requests = [(1, "galaxy s21 ultra", "US", [], [], "galaxy s21 ultra 128gb Samsung"), (2, "pixel", "in", [], [], "Pixel 5 Pro India official"),
                (3, "pixel", "US", ["AMAZON", "ebay"], ["eBay"], "pixel 5 pro"), (4, "deals", "US", [], [], "deals"), (5, "nokia", "XX", [], [], "nokia g10"),
                (6, "nokia", "DE", None, ["amazon"], "nokia g10"), (7, "", "US", [], [], "")]
    return (offers, requests, spark.createDataFrame(offers, "product_id long, seller_id long, product_name string, shop string, shop_country string"),
            spark.createDataFrame([(*r[:5], 10, "USD", r[5]) for r in requests],
                                  "query_id long, query string, country string, include_sources array<string>, exclude_sources array<string>, "
                                  "max_results int, target_currency string, search_text string"))


def words(text, without=()):
    return {w for w in re.sub(r"[^\w\s]", " ", text.lower()).split() if w not in without}


def plain(offers, requests):
    shops = {(r[0], r[1]) for r in registry_rows()}
    out = []
    for q, _, country, inc, exc, text in requests:
        want = words(text, R.COUNTRY_WORDS)
        for o in offers:
            listed = (not inc or o[3].lower() in [x.lower() for x in inc]) and o[3].lower() not in [x.lower() for x in exc or []]
            if want and (o[3], o[4]) in shops and o[4] == country.upper() and listed and len(want & words(o[2])) >= math.ceil(0.75 * len(want)):
                out.append((q, o[0]))
    return sorted(out)


def test_front_honours_country_lists_and_text_and_prunes(spark):
    offers, requests, o, r = fixture(spark)
    front = R.by_shop(o)
    index = R.token_index(front.select("product_name").distinct(), 4)
    found = R.search_offers(front, index, r)
    got = sorted((x.query_id, x.product_id) for x in found.collect())
    assert got == plain(offers, requests) and {q for q, _ in got} == {1, 2, 3, 6}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "dynamicpruning" in plan and plan.count("dynamicpruning") == 2  # by shop and by country


def test_index_side_is_not_moved(spark):
    _, _, o, _ = fixture(spark)
    index = R.token_index(o.select("product_name").distinct(), 4)
    texts = spark.createDataFrame(
        [(i, ["galaxy", "s21"]) for i in range(50)], "query_id long, query_tokens array<string>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = R.matching_names(index, texts)
        plan = hits._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    below = [x for x in plan.split("\n") if "name_tokens" in x and ("Exchange" in x or "Scan parquet" in x)]
    assert any("Scan parquet" in x for x in below) and not any("Exchange" in x for x in below)


def plain_hits(docs, queries, k, floor, dim):
    def weights(c, idf):
        return {p: n * idf[p] for p, n in c.items() if p in idf}
    df = Counter(p for c in docs.values() for p in c)
    idf = {p: math.log((len(docs) + 1.0) / (n + 1)) for p, n in df.items()}
    as_float = lambda x: __import__("struct").unpack("f", __import__("struct").pack("f", x))[0]
    out = []
    for q, c in queries.items():
        qw = {p: as_float(x) for p, x in weights(c, idf).items()}
        qn = math.sqrt(sum(x * x for x in qw.values()))
        scored = []
        for d, e in docs.items():
            dw = {p: as_float(x) for p, x in weights(e, idf).items()}
            dn = math.sqrt(sum(x * x for x in dw.values()))
            if qn and dn:
                scored.append((-round(sum(x * dw.get(p, 0) for p, x in qw.items()) / (qn * dn), 9), d))
        out += [(q, d, -s, i + 1) for i, (s, d) in enumerate(sorted(scored)[:k]) if -s >= floor]
    return sorted(out)


@pytest.mark.parametrize(("k", "floor", "dim"), [(1, 0.3, 20), (5, 0.3, 60), (3, 0.7, 9), (4, 0.05, 30)])
def test_sparse_search_equals_plain(spark, k, floor, dim):
    rng = random.Random(dim)
    draw = lambda n: Counter(min(int(rng.expovariate(6 / dim)), dim - 1) for _ in range(n))
    docs, queries = {i: draw(rng.randrange(1, 12)) for i in range(300)}, {i: draw(rng.randrange(0, 6)) for i in range(60)}
    table = lambda rows, key: spark.createDataFrame([(i, p, n) for i, c in rows.items() for p, n in c.items()], f"{key} long, place int, n long")
    counts = table(docs, "doc_id")
    idf = counts.groupBy("place").agg(F.log(F.lit(len(docs) + 1.0) / (F.count("*") + 1)).alias("idf"))
    index = build_index(counts, idf)
    got = search(index, table(queries, "id"), k, floor)
    rounded = lambda rows: sorted((q, d, round(s, 8), r) for q, d, s, r in rows)
    assert rounded((r.id, r.doc_id, r.score, r["rank"]) for r in got.collect()) == rounded(plain_hits(docs, queries, k, floor, dim))
    read = query_terms(index, table(queries, "id"), floor).select(F.sum(F.size("essential")), F.sum(F.size("terms"))).first()
    assert floor < 0.3 or read[0] < read[1]  # not every place of a query is read


def test_equal_vectors_are_one_row_and_pairs_are_never_shuffled(spark):
    rows = [(d, p, 1) for d in range(100, 400) for p in (d % 2, 2)] + [(5, 3, 1)]
    counts = spark.createDataFrame(rows, "doc_id long, place int, n long")
    idf = spark.createDataFrame([(p, 1.0) for p in range(4)], "place int, idf double")
    index = build_index(counts, idf)
    assert sorted(r.doc_id for r in index.documents.collect()) == [5, 100, 101]
    asked = spark.createDataFrame([(i, p, 1) for i in range(200) for p in (1, 2)], "id long, place int, n long")
    got = search(index, asked, 3, 0.3)
    assert {(r.id, r.doc_id, r["rank"]) for r in got.collect()} == {(i, d, n + 1) for i in range(200) for n, d in enumerate((101, 103, 105))}
    assert search(index, asked.where("id < 0"), 3, 0.3).count() == 0


def test_written_once_until_the_input_changes(spark, tmp_path):
    (tmp_path / "a").write_text("1")
    made = []
    build = lambda: made.append(1) or len(made)
    assert once(spark, "t", str(tmp_path), build) == once(spark, "t", str(tmp_path), build) == 1
    before = input_state(spark, str(tmp_path))
    (tmp_path / "a").write_text("22")
    assert input_state(spark, str(tmp_path)) != before and once(spark, "t", str(tmp_path), build) == 2
