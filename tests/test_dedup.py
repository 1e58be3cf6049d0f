"""Near-duplicate grouping: greedy replay vs a plain-Python run of the reference's loop."""
# The names, prices and scores below are fixed values: recorded results that must be reproduced.
import datetime as dt
import json
import random

from pyspark.sql import functions as F

from pricesift.functions import fuzz
from pricesift.operators.aggregates import group_best
from pricesift.operators.components import connected_components
from pricesift.operators.match import dedup_groups

ARR = ["scraped_at", "l_orderkey", "l_linenumber", "product_id", "seller_id"]
T0 = dt.datetime(2025, 1, 1)
VARIANTS = [("Apple iPhone 16 Pro 128GB - Natural Titanium", 1.0),
            ("iPhone 16 Pro 128GB Natural Titanium (Unlocked)", 1.02),
            ("Apple iPhone 16 Pro - 128GB - Natural Titanium", 0.98),
            ("iPhone 16 Pro 128GB - Natural Titanium - Factory Unlocked", 1.01),
            ("Apple iPhone 16 Pro (128GB) Natural Titanium", 0.99)]


def frame(spark, rows):
    data = [(q, T0, i, 1, i, i, n, float(p), 0.5) for i, (q, n, p) in enumerate(rows)]
    return spark.createDataFrame(data, "query_id long, scraped_at timestamp, l_orderkey long, l_linenumber int, "
                                       "product_id long, seller_id long, product_name string, norm_price double, "
                                       "similarity double")


def python_greedy(rows):
    groups = []
    for i, (q, n, p) in enumerate(rows):
        for g in groups:
            if g[0][0] == q and any(fuzz.name_similarity(n, m) > 0.85 and 1 - abs(p - mp) / max(p, mp) > 0.9
                                    for _, m, mp, _ in g):
                g.append((q, n, p, i))
                break
        else:
            groups.append([(q, n, p, i)])
    return sorted(sorted(x[3] for x in g) for g in groups)


def spark_groups(df, mode):
    out = dedup_groups(df, ARR, mode=mode).groupBy("query_id", "dup_group").agg(
        F.sort_array(F.collect_list("l_orderkey")).alias("m")).collect()
    return sorted(list(r.m) for r in out)


def test_five_variants_collapse_to_one(spark):
    rows = [(1, n, 999 * f) for n, f in VARIANTS]
    df = frame(spark, rows)
    assert spark_groups(df, "greedy") == [[0, 1, 2, 3, 4]]
    best = group_best(dedup_groups(df, ARR), ["query_id", "dup_group"], ARR).collect()
    assert len(best) == 1 and len(best[0].group_id) == 8


def test_greedy_matches_python_loop(spark):
    names = ["red widget small", "red widget smal", "blue bolt", "blue bolts", "red widget small",
             "green gear", "red widgets small", "blue bolt"]
    prices = [100, 104, 50, 53, 120, 70, 98, 49]
    rows = [(q, n, p) for q in (1, 2) for n, p in zip(names, prices)]
    df = frame(spark, rows)
    assert spark_groups(df, "greedy") == python_greedy(rows)
    comps = spark_groups(df, "components")
    # every greedy group lies inside one component
    for g in python_greedy(rows):
        assert any(set(g) <= set(c) for c in comps)


def all_pairs_components(rows):
    """Components of the graph over all row pairs with a similar name and a close price."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sims = {}
    for i, (q, n, p) in enumerate(rows):
        for j in range(i):
            r, m, o = rows[j]
            if q != r or not 1 - abs(p - o) / max(p, o) > 0.9:
                continue
            if (n, m) not in sims:
                sims[n, m] = n == m or fuzz.name_similarity(n, m) > 0.85
            if sims[n, m]:
                parent[root(i)] = root(j)
    out = {}
    for i in range(len(rows)):
        out.setdefault(root(i), []).append(i)
    return sorted(out.values())


def test_components_equal_all_pairs_on_random_rows(spark):
    rng = random.Random(11)
    words = ["red", "blue", "widget", "widgets", "small", "smal", "bolt", "bolts"]
    rows = [(rng.randrange(3), " ".join(rng.sample(words, rng.randrange(2, 4))), round(10 * 1.06 ** rng.randrange(9 if i % 4 else 90), 2))
            for i in range(160)]
    got = spark_groups(frame(spark, rows), "components")
    assert got == all_pairs_components(rows)
    assert any(len(g) > 5 for g in got) and any(len(g) == 1 for g in got)


def test_connected_components_on_chains_and_hubs(spark):
    edges = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("hub", f"s{i}") for i in range(50)] + [("x", "x")]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"c{i:03d}"] for i in range(61)} == {"c000"}
    assert {got[f"s{i}"] for i in range(50)} == {"hub"} and "x" not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_group_similar_equals_a_plain_first_fit_loop(spark):
    from pricesift.operators.match import feature_similarity, group_similar
    rng = random.Random(3)
    parts = [["Apple iPhone 16 Pro", "iPhone 16 Pro", "Samsung Galaxy S24", "plain thing", ""], ["128GB", "256GB", ""], ["Black", "White", ""]]
    rows = [(rng.randrange(2), i, " ".join(x for x in (rng.choice(p) for p in parts) if x)) for i in range(120)]
    items = spark.createDataFrame(rows, "query_id long, rank long, product_name string")
    names = sorted({r[2] for r in rows})
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    sim = {(r.a, r.b): r.s for r in pairs.select("a", "b", feature_similarity(F.col("a"), F.col("b"), F.lit("")).alias("s")).collect()}
    want, led = {}, set()
    for i, (q, rank, n) in enumerate(rows):
        if i in led:
            continue
        for j in range(i, len(rows)):
            if j == i or (j not in led and rows[j][0] == q and sim[n, rows[j][2]] >= 0.8):
                led.add(j)
                want[rows[j][1]] = rank
    got = {r["rank"]: json.loads(r.leader_key)["rank"] for r in group_similar(items, "query_id", "product_name", ["rank"]).collect()}
    assert got == want and len(set(want.values())) not in (1, len(rows))


def test_vocabulary_pairs_meet_where_they_are_compared(spark):
    from pricesift.operators.match import BLOCK_NAMES, vocabulary_pairs
    sizes = {1: 1, 2: 5, 3: 2 * BLOCK_NAMES + 7}
    v = spark.createDataFrame([(q, f"name {i:04d}", i) for q, n in sizes.items() for i in range(n)], "query_id long, name string, n long")
    pairs = vocabulary_pairs(v, "query_id", "name", ["n"])
    assert pairs.where("n_a >= n_b").count() == 0 and pairs.distinct().count() == pairs.count()
    got = {r.query_id: r["count"] for r in pairs.groupBy("query_id").count().collect()}
    assert got == {q: n * (n - 1) // 2 for q, n in sizes.items() if n > 1}
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobin" not in plan and "REPARTITION_BY_NUM" in plan  # dealt before the join, not after it


def test_segments_are_linked_in_cells_of_any_size(spark):
    from pricesift.operators import match
    rng = random.Random(5)
    words = ["red", "blue", "widget", "widgets", "small", "smal", "bolt", "bolts", "rot", "größe"]
    rows = [(rng.randrange(4), " ".join(rng.sample(words, rng.randrange(2, 5))), round(10 * 1.06 ** rng.randrange(9 if i % 4 else 60), 2))
            for i in range(400)]
    segs = match.chain_segments(frame(spark, rows))
    want = all_pairs_components(rows)
    seg_of = {(r.query_id, r.product_name, r.norm_price): r.seg for r in segs.collect()}
    # One cell per set, or many blocks per set and its queries dealt apart: the same components.
    for names, n_rows in ((1000, 10 ** 6), (20, 60)):
        root = {r.node: r.root for r in match.segment_labels(segs, names=names, rows=n_rows).collect()}
        got = {}
        for i, row in enumerate(rows):
            seg = seg_of[row]
            got.setdefault(root.get(seg, seg), []).append(i)
        assert sorted(got.values()) == want, (names, n_rows)


def test_touching_lists_every_close_pair_in_batches(monkeypatch):
    import numpy as np

    from pricesift.operators import match
    from pricesift.settings import DEFAULT
    monkeypatch.setattr(match, "PAIRS_AT_ONCE", 50)
    rng = np.random.default_rng(1)
    lo = np.sort(np.round(10 * 1.1 ** rng.uniform(0, 20, 200), 2))
    hi = np.round(lo * rng.choice([1.0, 1.05, 1.6], 200), 2)
    got = [pair for i, j in match._touching(lo, hi, DEFAULT) for pair in zip(i.tolist(), j.tolist(), strict=True)]
    want = [(i, j) for i in range(200) for j in range(i + 1, 200) if lo[j] <= hi[i] or 1 - (lo[j] - hi[i]) / lo[j] > 0.9]
    assert sorted(got) == want and len(set(got)) == len(got)


def test_names_are_compared_once_for_all_queries_of_a_cell(monkeypatch):
    import pyarrow as pa

    from pricesift.operators import match
    from pricesift.settings import DEFAULT
    texts = [f"plain thing {i}" for i in range(30)]
    names = pa.table({"product_name": texts, "clean": texts, "key": [" ".join(sorted(t.split())) for t in texts],
                      "tokens": [sorted(t.split()) for t in texts], "empty": [False] * 30, "block": pa.array([0] * 30, pa.int64())})
    names = names.append_column("blocks", pa.array([1] * 30, pa.int64()))
    segs = pa.table({"query_id": [q for q in range(20) for _ in texts], "product_name": texts * 20, "lo": [float(10 + i) for i in range(30)] * 20,
                     "hi": [float(10 + i) for i in range(30)] * 20, "seg": [f"{q}|{t}" for q in range(20) for t in texts],
                     "blocks": pa.array([1] * 600, pa.int64())})
    compared = []
    real = fuzz.Names.similar
    monkeypatch.setattr(fuzz.Names, "similar", lambda self, a, b, floor: compared.append(len(a)) or real(self, a, b, floor))
    out = match._link_cell(DEFAULT)(segs, names)
    assert sum(compared) <= 30 * 29 // 2  # before: these pairs for each of the 20 queries
    assert out.num_rows == 20 * 29 and set(out["whole"].to_pylist()) == {True}
