"""Inverted-file index over unit vectors (J8, J11, J12 at scale).

Centroids are fitted by k-means on a bounded sample (``sample_rows``); every row of the
table is then assigned to its nearest centroid and written with its cell, so the whole
table is indexed. A cell holds its largest angle to the centroid. A query looks into the
``probes`` nearest cells; that is the approximate search, whose recall grows with
``probes``. With ``exact`` the k-th best score found so far bounds what is left: by the
triangle inequality for angles a row of a cell is no nearer to the query than the
centroid's angle less the cell's, and every cell that could still hold a better row is
searched as well, so nothing is missed.

A cell of more than ``block_rows`` rows is split into blocks, and a cell that is asked by
many queries into query blocks, so a vector that a third of all rows share is spread over
many tasks. Each block emits at most k rows a query. What is broadcast are the centroids
(``MAX_CELLS`` at most) and the cells' sizes.

Zero vectors have no direction: they are in a cell of their own that exact and approximate
search leave out, as no score of theirs reaches a positive floor.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_shared
from ..settings import DEFAULT, Settings
from .knn import _CELL_SCHEMA, _cell_topk

MAX_CELLS, SAMPLE_ROWS, ROUNDS = 4096, 20_000, 12
#: Angles are computed in single precision; bounds give way by this much.
SLACK = 2e-3


@dataclass
class VectorIndex:
    """``rows``: (id, vec, cell) of every row; ``cells``: (cell, n, angle); ``centroids``: unit vectors by cell."""

    rows: DataFrame
    cells: DataFrame
    centroids: np.ndarray


def unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def fit_centroids(sample: np.ndarray, n_cells: int, seed: int = 0) -> np.ndarray:
    """Spherical k-means of unit vectors; an empty cell is started anew at the row that fits worst."""
    rng, sample = np.random.default_rng(seed), unit(sample.astype(np.float32))
    sample = sample[np.abs(sample).sum(axis=1) > 0]
    if not len(sample):
        return np.zeros((0, sample.shape[1]), np.float32)
    centroids = sample[rng.choice(len(sample), min(n_cells, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        scores = sample @ centroids.T
        cell, best = scores.argmax(axis=1), scores.max(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, sample)
        empty = np.flatnonzero(np.bincount(cell, minlength=len(centroids)) == 0)
        sums[empty] = sample[np.argsort(best)[:len(empty)]]
        centroids = unit(sums)
    return centroids


def _vectors(column: pa.Array) -> np.ndarray:
    return unit(np.stack([np.asarray(v, np.float32) for v in column.to_pylist()])) if len(column) else np.zeros((0, 0), np.float32)


def build(vectors: DataFrame, id_col: str = "doc_id", vec_col: str = "embedding", n_cells: int | None = None,
          sample_rows: int = SAMPLE_ROWS) -> VectorIndex:
    """Index every row of ``vectors``; the centroids alone come from a sample of at most ``sample_rows`` rows."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("vec")).where("vec IS NOT NULL")
    n = rows.count()
    share = min(1.0, 1.2 * sample_rows / max(n, 1))
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(sample_rows).select("vec").toArrow()["vec"]
    cells = min(MAX_CELLS, n_cells or max(1, math.isqrt(n)))
    held = _vectors(sample)
    centroids = fit_centroids(held, cells) if held.size else np.zeros((0, 1), np.float32)
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)  # MAX_CELLS unit vectors at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, c = _vectors(batch.column(1)), shared.value
            if not len(m):
                continue
            zero = np.abs(m).sum(axis=1) == 0
            scores = m @ c.T if len(c) else np.zeros((len(m), 1), np.float32)
            cell = np.where(zero, -1, scores.argmax(axis=1)).astype(np.int32)
            angle = np.where(zero, 0, np.arccos(np.clip(scores.max(axis=1), -1, 1))).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], names=["id", "vec", "cell", "angle"])

    assigned = write_shared(rows.mapInArrow(assign, "id long, vec array<float>, cell int, angle double"), "vector-index")
    sizes = assigned.where("cell >= 0").groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("angle"))
    return VectorIndex(assigned.drop("angle"), write_shared(sizes, "vector-cells"), centroids)


def _probed(index: VectorIndex, queries: DataFrame, probes: int) -> DataFrame:
    """(id, vec, cell, angle, near): a query's angle to every cell, and whether the cell is one of the nearest."""
    shared = queries.sparkSession.sparkContext.broadcast(index.centroids)  # MAX_CELLS unit vectors at most

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = shared.value
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                m = _vectors(part.column(1))
                if not len(m) or not len(c):
                    continue
                angle = np.arccos(np.clip(m @ c.T, -1, 1))
                place = np.argsort(np.argsort(angle, axis=1, kind="stable"), axis=1, kind="stable")
                row, cell = np.divmod(np.arange(angle.size), len(c))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(cell.astype(np.int32)), pa.array(angle.ravel().astype(np.float64)),
                     pa.array(place.ravel() < probes)], names=["id", "cell", "angle", "near"])

    return queries.mapInArrow(probe, "id long, cell int, angle double, near boolean")


def _search(index: VectorIndex, asked: DataFrame, queries: DataFrame, k: int, exclude_self: bool, settings: Settings) -> DataFrame:
    """Top rows of each asked (id, cell), block by block."""
    block, qblock = settings.knn_doc_block_rows, settings.knn_query_block_rows
    sizes = F.broadcast(index.cells.select("cell", F.ceil(F.col("n") / block).cast("int").alias("blocks")))  # one row a cell
    docs = index.rows.join(sizes, "cell").select("id", "vec", "cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    crowd = asked.groupBy("cell").agg(F.ceil(F.count("*") / qblock).cast("int").alias("crowds"))
    crowd = F.broadcast(write_shared(crowd, "asked-cells"))  # one row a cell at most
    docs = docs.join(crowd, "cell").withColumn("crowd", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1))).drop("crowds")
    q = (asked.select("id", "cell").join(queries, "id").join(sizes, "cell").join(crowd, "cell")
         .select("id", "vec", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                 F.pmod(F.xxhash64("id"), F.col("crowds")).cast("int").alias("crowd")))
    keys = ["cell", "block", "crowd"]
    return docs.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInPandas(_cell_topk(k, exclude_self), _CELL_SCHEMA)


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id"))
    return found.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def index_topk(index: VectorIndex, queries: DataFrame, k: int, probes: int = 16, exact: bool = False, min_score: float | None = None,
               exclude_self: bool = False, query_id: str = "query_id", query_vec: str = "qvec", settings: Settings = DEFAULT) -> DataFrame:
    """(query_id, doc_id, score, rank): up to k nearest rows of each query; ``exact`` leaves none out."""
    q = write_shared(queries.select(F.col(query_id).cast("bigint").alias("id"), F.col(query_vec).cast("array<float>").alias("vec"))
                     .where("vec IS NOT NULL"), "index-queries")
    angles = _probed(index, q, probes)
    if exact:  # every cell that exists may be asked later
        angles = write_shared(angles.join(F.broadcast(index.cells.select("cell", F.col("angle").alias("widest"))), "cell"), "query-cells")
    found = write_shared(_search(index, angles.where("near"), q, k, exclude_self, settings), "found")
    if exact:
        floor = F.lit(-1.0) if min_score is None else F.lit(float(min_score))
        kth = _best(found, k).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
        left = angles.where("NOT near").join(kth.withColumnRenamed("query_id", "id"), "id", "left")
        reach = F.cos(F.greatest(F.lit(0.0), F.col("angle") - F.col("widest") - SLACK))
        more = left.where(reach >= F.greatest(F.coalesce("kth", floor), floor)).select("id", "cell")
        found = found.unionByName(_search(index, write_shared(more, "more-cells"), q, k, exclude_self, settings))
    best = _best(found, k)
    return best if min_score is None else best.where(F.col("score") >= min_score)
