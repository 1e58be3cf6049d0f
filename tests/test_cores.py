"""The search that holds what requests share once, against the same search with a row per request and offer."""
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricesift.functions import fuzz
from pricesift.operators import cores, search
from pricesift.operators import retrieval as R
from pricesift.sources.registry import registry_rows

ARR = ["scraped_at", "l_orderkey", "l_linenumber", "product_id", "seller_id"]
SHOPS = sorted({r[0] for r in registry_rows() if r[1] == "US"})[:3]


def shop_offers(spark, n, seed):
    """Offers of one family of names that differ in model, colour and form, at prices that chain or lie apart."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        model, color = rng.randrange(100, 112), rng.choice(["Blue", "Black", "Größe"])
        name = rng.choice([f"Galaxy S{model} Ultra {color} - (Unlocked)", f"Samsung Galaxy S{model} Ultra {color} phone 50MP", f"Nokia G{model} {color}", "日本"])
        rows.append((dt.datetime(2025, 1, 1 + i % 5) if i % 6 else None, i, i % 3, i % 17, i % 11, name, f"{10 * 1.05 ** rng.randrange(20):.2f}", "USD", "In Stock", 4.0, i % 50,
                     "1.00", f"s{i % 11}", f"/dp/{i}", "Amazon", rng.choice(SHOPS), rng.choice(["US", "IN"])))
    return spark.createDataFrame(rows, "scraped_at timestamp, l_orderkey long, l_linenumber int, product_id long, seller_id long, product_name string, "
                                       "price string, currency string, availability string, rating double, reviews_count long, shipping_cost string, seller string, "
                                       "link string, source string, shop string, shop_country string")


def requests(spark, n):
    rows = []
    for i in range(n):
        text = [f"Galaxy S{100 + i % 12} Ultra Blue", f"Samsung Galaxy S{100 + i % 12} Ultra phone", f"S{100 + i % 12}", "Galaxy Ultra Blue", "Nokia", "日本"][i % 6]
        rows.append((i, text, "US" if i % 4 else "in", [SHOPS[0]] if i % 3 == 1 else [], [SHOPS[1]] if i % 5 == 2 else [], i % 3 * 4, "USD", text))
    return spark.createDataFrame(rows, "query_id long, query string, country string, include_sources array<string>, exclude_sources array<string>, "
                                       "max_results int, target_currency string, search_text string")


def by_rows(front, index, asked):
    found = R.search_offers(front, index, asked)
    best = search.best_members(search.grouped_offers(found, ARR), ["query_id", "dup_group"], ARR)
    return best


def key(df):
    cols = ["query_id", "product_name", "norm_price", *ARR, "similarity", "group_size", "group_id"]
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)


@pytest.mark.parametrize("limits", [None, (15, 10 ** 6, 10 ** 6), (10 ** 6, 10 ** 6, 40), (15, 50, 40)])
def test_best_members_equal_those_of_a_row_per_request_and_offer(spark, monkeypatch, limits):
    if limits:  # sets too large for a task: cells, forests, slices
        whole = cores.best_of_groups
        monkeypatch.setattr(search, "best_of_groups", lambda m, x, q, s: whole(m, x, q, s, *limits))
    offers, asked = shop_offers(spark, 500, 4), requests(spark, 60)
    front = R.by_shop(offers)
    index = R.token_index(front.select("product_name").distinct(), 4)
    got = search.ranked_results(R.shared_search(front, index, asked), ARR, None)
    want = key(by_rows(front, index, asked))
    limited = {r.query_id: r.max_results for r in asked.collect()}
    full = [r for r in want if limited[r[0]] <= 0]
    assert [r for r in key(got) if limited[r[0]] <= 0] == full and len(full) > 50
    assert any(r[-2] > 5 for r in full) and set(key(got)) <= set(want)
    n = {q: sum(r[0] == q for r in want) for q in limited}
    assert {r.query_id: r["count"] for r in got.groupBy("query_id").count().collect()} == {
        q: min(n[q], m) if m > 0 else n[q] for q, m in limited.items() if n[q]}


def test_rows_do_not_grow_with_the_requests(spark):
    offers = shop_offers(spark, 200, 5)
    front = R.by_shop(offers)
    index = R.token_index(front.select("product_name").distinct(), 4)
    few, many = (R.shared_search(front, index, requests(spark, n)) for n in (60, 600))
    for part in ("members", "offers"):
        assert getattr(few, part).count() == getattr(many, part).count()
    assert many.extras.count() == few.extras.count()  # the same texts of the same shops are one request
    assert R.search_offers(front, index, requests(spark, 600)).count() > 5 * many.offers.count()


@pytest.mark.parametrize(("mode", "limits"), [("components", {}), ("greedy", {}), ("greedy", {"names": 15})])
def test_best_of_queries_equals_grouped_offers(spark, mode, limits):
    o = shop_offers(spark, 300, 6).withColumn("query_id", F.col("product_id") % 3).withColumn("query", F.lit("galaxy ultra")).withColumn("target_currency", F.lit("USD"))
    want = search.best_members(search.grouped_offers(o, ARR, mode), ["query_id", "dup_group"], ARR)
    queries = spark.createDataFrame([(i, "galaxy ultra") for i in range(5)], "query_id long, query string")  # two find nothing
    got = search.best_of_queries(o, queries, ARR, mode, **limits).withColumn("group_id", F.substring(F.md5("product_name"), 1, 8))
    assert key(got) == key(want) and got.where("group_size > 1").count()


@pytest.mark.parametrize("name", ["dedup_components", "dedup_greedy"])
def test_no_table_of_offers_is_written_to_group_them(spark, sf, monkeypatch, name):
    from pricesift.operators import match
    from pricesift.plans.catalog import spark_queries
    from pricesift.session import write_shared
    from pricesift.sources import tables
    offers = tables.offers_for_queries(spark, sf)
    names = offers.select("query_id", "product_name").distinct().count()
    written = []

    def record(df, *args):
        out = write_shared(df, *args)
        written.append(out.count())
        return out

    for module in (cores, match, search):
        monkeypatch.setattr(module, "write_shared", record)
    out = spark_queries()[name](spark, sf)
    assert out.count() > 0 and written and max(written) <= names < offers.count() / 5


def test_offers_of_queries_equal_the_join(spark, sf):
    from pricesift.sources import tables
    q = tables.queries(spark, sf).select("query_id", "query", "country", "max_results", "target_currency", "family")
    want = tables.offers(spark, sf).join(q, F.col("query_key") == F.col("family")).drop("family")
    got = tables.offers_for_queries(spark, sf)
    assert got.columns == want.columns and got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_bounds_and_windows_of_names_equal_the_plain_ratios():
    rng = random.Random(2)
    words = ["red", "blue", "größe", "widget", "widgets", "s21", "ultra", "(x)", "日本", "a" * 30]
    names = ["", "!!"] + [" ".join(rng.sample(words, rng.randrange(1, 5))) for _ in range(60)]
    for texts in (names, [*names, "long " * 40]):  # one word of marks, and texts of more characters
        clean = [fuzz.clean_text(n.lower()) for n in texts]
        table = fuzz.Names(clean, [" ".join(sorted(fuzz.words_of(c))) for c in clean], [sorted(set(fuzz.words_of(c))) for c in clean])
        assert (table.marks_clean.masks is None) == (len(texts) > len(names))
        a, b = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
        ts, tset, least, most = table.bounds(a, b)
        part = table.partial(a, b)
        plain = [(fuzz.token_sort_ratio(clean[i], clean[j]), fuzz.token_set_ratio(clean[i], clean[j]), fuzz.partial_ratio(clean[i], clean[j])) for i, j in zip(a, b, strict=True)]
        assert [tuple(p) for p in zip(ts, tset, part, strict=True)] == plain
        score = fuzz.blend(ts, tset, part)
        assert (least <= score).all() and (score <= most).all()
        assert (table.similar(a, b, 0.85) == (score > 0.85)).all()
