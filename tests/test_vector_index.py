"""The inverted file against brute force."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from pricesift.operators.knn import knn_topk
from pricesift.operators.vector_index import build, index_topk
from pricesift.settings import Settings


def brute(m, ids, q_ids, k):
    u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    out = {}
    for q in q_ids:
        s = u @ u[ids.index(q)]
        order = sorted((-round(float(x), 5), i) for x, i in zip(s, ids, strict=True) if i != q and np.abs(m[ids.index(i)]).sum())
        out[q] = [i for _, i in order[:k]]
    return out


def table(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "doc_id long, embedding array<float>").repartition(4)


def clustered(n=1500, dim=12, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, dim))
    return centres[rng.integers(30, size=n)] + 0.25 * rng.normal(size=(n, dim))


@pytest.mark.parametrize("spread", [0, 1])
def test_exact_search_misses_nothing_and_recall_grows(spark, spread):
    m = clustered() if not spread else np.random.default_rng(1).normal(size=(700, 6))
    docs = table(spark, m)
    q = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("qvec"))
    index = build(docs, n_cells=25, sample_rows=200)
    assert index.rows.count() == len(m) and index.cells.agg(F.sum("n")).first()[0] == len(m)
    want = brute(m, list(range(len(m))), range(0, len(m), 20), 5)

    def got(**kw):
        out = {}
        for r in index_topk(index, q, 5, exclude_self=True, **kw).orderBy("query_id", "rank").collect():
            out.setdefault(r.query_id, []).append(r.doc_id)
        return out

    def recall(found):
        return np.mean([len(set(found.get(k, [])) & set(v)) / 5 for k, v in want.items()])

    assert recall(got(exact=True, probes=2)) == 1.0
    few, more = recall(got(probes=1)), recall(got(probes=8))
    assert few <= more and more >= 0.9


def test_recall_on_the_driver_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("qvec"))
    want = {(r.query_id, r.doc_id) for r in knn_topk(q, docs, 10, exclude_self=True).collect()}
    found = {(r.query_id, r.doc_id) for r in index_topk(build(docs), q, 10, exclude_self=True).collect()}
    assert len(want & found) / len(want) >= 0.9


def test_hot_vector_zero_and_null_vectors(spark):
    m = np.vstack([np.tile([1.0, 2.0, 3.0], (400, 1)), clustered(300, 3), np.zeros((3, 3))])
    docs = table(spark, m).unionByName(spark.createDataFrame([(9999, None)], "doc_id long, embedding array<float>"))
    index = build(docs, n_cells=9)
    small = Settings(knn_doc_block_rows=50, knn_query_block_rows=7)
    q = docs.where("doc_id < 40 OR doc_id > 690").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("qvec"))
    a = index_topk(index, q, 3, exact=True, exclude_self=True, min_score=0.3, settings=small)
    b = index_topk(index, q, 3, exact=True, exclude_self=True, min_score=0.3)
    rows = lambda d: sorted((r.query_id, r["rank"], round(r.score, 5)) for r in d.collect())
    assert rows(a) == rows(b) and len(rows(a)) >= 120
    assert {r.doc_id for r in a.where("query_id = 5").collect()} == {0, 1, 2}  # of equal scores the smallest ids
    assert build(docs.limit(0)).rows.count() == 0 and index_topk(build(docs.limit(0)), q, 3).count() == 0
