"""Exact top-k cosine search (J8, T4, P13) and vector normalisation.

Plan: documents are hashed into D blocks and queries into Q blocks (D and Q
come from two ``count()`` scalars and the block sizes in ``Settings``). Each
document row is tagged with every query block and each query row with every
document block, so cell (d, q) meets exactly one document block and one query
block in ``cogroup(...).applyInPandas``. A cell does numpy matrix products of a
few queries at a time, selects by the k-th score (no full sort) and emits, per query,
its k best documents (equal scores by id). A final ``row_number() <= k`` per query (a literal bound, so Spark
adds a partial WindowGroupLimit before the shuffle) picks the global top k.

Memory per task is bounded by the block sizes, no pair table is ever
materialised, nothing goes through the driver, and the result is exact.
With a small query set (Q = 1) the documents are shuffled exactly once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..settings import DEFAULT, Settings

_CELL_SCHEMA = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("doc_id", T.LongType()),
    T.StructField("score", T.DoubleType()),
])


_STEP = 128  # queries of a cell that are compared at once


def l2_norm(vec) -> Column:
    v = F.col(vec) if isinstance(vec, str) else vec
    return F.sqrt(F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x * x))


def normalize(vec) -> Column:
    """unit-length copy of a vector column (double precision)."""
    v = (F.col(vec) if isinstance(vec, str) else vec).cast("array<double>")
    n = l2_norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def _cell_topk(k: int, exclude_self: bool, digits: int | None = None):
    def fn(docs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if docs.empty or qs.empty:
            return pd.DataFrame({"query_id": pd.Series([], dtype="int64"),
                                 "doc_id": pd.Series([], dtype="int64"),
                                 "score": pd.Series([], dtype="float64")})
        dm = np.vstack(docs["vec"].to_numpy()).astype(np.float64)
        qm = np.vstack(qs["vec"].to_numpy()).astype(np.float64)
        dn = np.linalg.norm(dm, axis=1, keepdims=True)
        qn = np.linalg.norm(qm, axis=1, keepdims=True)
        dm = np.divide(dm, dn, out=np.zeros_like(dm), where=dn > 0)
        qm = np.divide(qm, qn, out=np.zeros_like(qm), where=qn > 0)
        by_id = np.argsort(docs["id"].to_numpy(dtype=np.int64), kind="stable")
        dm, did = dm[by_id], docs["id"].to_numpy(dtype=np.int64)[by_id]
        qid = qs["id"].to_numpy(dtype=np.int64)
        rows, cols, scores = [], [], []
        for at in range(0, len(qid), _STEP):
            sims = qm[at:at + _STEP] @ dm.T                # (queries, docs) of this step
            if digits is not None:
                sims = np.round(sims, digits)
            if exclude_self:
                sims[qid[at:at + _STEP, None] == did[None, :]] = -np.inf
            # The k best of each query: all at or above the k-th score, equal scores by id, cut to k.
            floor = np.partition(sims, -k, axis=1)[:, -k, None] if sims.shape[1] > k else -np.inf
            r, c = np.nonzero((sims >= floor) & np.isfinite(sims))
            order = np.lexsort((c, -sims[r, c], r))
            r, c = r[order], c[order]
            best = np.arange(len(r)) - np.searchsorted(r, r) < k
            rows.append(r[best] + at)
            cols.append(c[best])
            scores.append(sims[r[best], c[best]])
        rows, cols, scores = np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)
        return pd.DataFrame({"query_id": qid[rows], "doc_id": did[cols], "score": scores})
    return fn


def knn_topk(queries: DataFrame, docs: DataFrame, k: int, query_id: str = "query_id",
             query_vec: str = "qvec", doc_id: str = "doc_id", doc_vec: str = "embedding",
             exclude_self: bool = False, min_score: float | None = None,
             settings: Settings = DEFAULT, digits: int | None = None) -> DataFrame:
    """Top-k documents per query by cosine; ``min_score`` filters after the top-k.

    ``digits`` rounds the scores before they are compared, so that equal texts tie.
    """
    n_docs = docs.count()
    n_q = queries.count()
    if n_docs == 0 or n_q == 0 or k <= 0:
        empty = T.StructType([*(_CELL_SCHEMA.fields), T.StructField("rank", T.LongType())])
        return (queries.sparkSession.createDataFrame([], empty)
                .withColumnRenamed("query_id", query_id).withColumnRenamed("doc_id", doc_id))
    nd = max(1, math.ceil(n_docs / settings.knn_doc_block_rows))
    nq = max(1, math.ceil(n_q / settings.knn_query_block_rows))
    d = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(doc_vec).cast("array<float>").alias("vec"),
                    F.pmod(F.xxhash64(doc_id), F.lit(nd).cast("bigint")).alias("db"),
                    F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nq - 1).cast("bigint"))).alias("qb"))
    q = queries.select(F.col(query_id).cast("bigint").alias("id"),
                       F.col(query_vec).cast("array<float>").alias("vec"),
                       F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nd - 1).cast("bigint"))).alias("db"),
                       F.pmod(F.xxhash64(query_id), F.lit(nq).cast("bigint")).alias("qb"))
    cand = (d.groupBy("db", "qb").cogroup(q.groupBy("db", "qb"))
            .applyInPandas(_cell_topk(k, exclude_self, digits), _CELL_SCHEMA))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id"))
    top = cand.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)
    if min_score is not None:
        top = top.filter(F.col("score") >= min_score)
    return top.withColumnRenamed("query_id", query_id).withColumnRenamed("doc_id", doc_id)
