import random

import numpy as np
import xxhash
from helpers import empty_docs, odd_docs, word_list
from pyspark.sql import functions as F

from pricesift.llm import simhash


def plain_fingerprint(text, k=4):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = word_list(low)
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, bits):
    """fp -> smallest linked fp (signed order), by comparing all pairs."""
    fps = sorted(set(fps))
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    arr = np.array(fps, np.int64).view(np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1:] ^ arr[i]) <= bits):
            a, b = root(fps[i]), root(fps[i + 1 + j])
            parent[max(a, b)] = min(a, b)
    return {f: root(f) for f in fps}


def clustered(seed, centres, members, flips):
    rng, out = random.Random(seed), set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(members):
            m = c
            for b in rng.sample(range(64), rng.randrange(flips + 1)):
                m ^= 1 << b
            out.add(m)
    return [x - (1 << 64) if x >> 63 else x for x in out]


def test_links_equal_all_pairs_for_every_distance_and_entry_limit(spark):
    fps = clustered(5, 6, 40, 5) + clustered(6, 60, 2, 4)
    df = spark.createDataFrame([(f,) for f in set(fps)], "fp long")
    for bits, limit in ((4, 8192), (4, 3), (3, 3), (2, 8192), (1, 2)):
        want = plain_components(fps, bits)
        got = {r.node: r.root for r in simhash.link(df, bits, limit).collect()}
        assert {f: got.get(f, f) for f in want} == want, (bits, limit)


def test_entry_edges_do_not_grow_with_pairs(spark):
    fps = clustered(9, 1, 400, 2)
    df = spark.createDataFrame([(f,) for f in fps], "fp long").repartition(4)
    masks = F.array(*[F.struct(F.lit(i).alias("choice"), F.lit(m).alias("mask")) for i, m in enumerate(simhash._masks(4))])
    index = df.select("fp", F.explode(masks).alias("m")).select(
        F.col("m.choice").alias("choice"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("key"), "fp")
    edges = index.repartition("choice", "key").sortWithinPartitions("choice", "key").mapInArrow(
        simhash._entry_edges(4, 8192), "a long, b long")
    assert edges.count() <= 70 * len(fps)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = simhash.near_duplicates(docs).collect()
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    for i, t in texts:
        if i is not None:
            assert by_id[i].fp & (2**64 - 1) == plain_fingerprint(t)
    assert by_id[0].component_id == by_id[1].component_id == by_id[2].component_id == 0
    assert by_id[6].component_id == 5
    assert {r.component_id for r in rows if r.doc_id is None} == {0, None}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len({r.root for r in rows}) and len(set(ids)) == len(ids)
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0 == simhash.keep_one(empty_docs(spark)).count()
