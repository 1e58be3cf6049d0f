"""Exact search over sparse unit vectors with an inverted index and upper bounds.

Documents of one vector are one row of the index, led by the smallest id, and so are equal
queries. The index holds, per place, the largest unit weight. A query's places are ordered
by the most they can add to a cosine; those that together stay under the floor can't carry
a document over it, so documents are found through the remaining, essential places alone.
Document and query blocks meet in cells: a cell inverts its documents, adds up the postings
of a query's essential places, and compares in full only those documents that can still
reach the floor and the best scores. So no pair of query and document is ever a row of a
shuffle: what moves is the blocks, and at most k rows per query and cell. Every document at
or above the floor is found, whatever the data; the work follows the postings that are read.

Scores are ``round(sum(q * d) / (|q| * |d|), digits)``; equal scores go by document id.
Documents and queries whose vectors are zero have no hits.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_shared

#: Room for the rounding of sums of doubles, far above it and far below any score difference that is shown.
SLACK = 1e-7
DOC_BLOCK = 1 << 16    # documents of a cell
QUERY_BLOCK = 1 << 14  # queries of a cell
_HIT = T.StructType([T.StructField("id", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])


@dataclass
class SparseIndex:
    """Written tables: documents (doc_id, norm, terms) of one row per vector, their copies (first, doc_id)
    and places (place, idf, top)."""

    documents: DataFrame
    copies: DataFrame
    places: DataFrame


def build_index(counts: DataFrame, weights: DataFrame, doc_id: str = "doc_id") -> SparseIndex:
    """Index of (doc_id, place, n) term counts under (place, idf) weights, a table of one row per place."""
    w = counts.join(F.broadcast(weights), "place").select(
        F.col(doc_id).alias("doc_id"), "place", (F.col("n") * F.col("idf")).cast("float").cast("double").alias("w"))
    terms = F.array_sort(F.collect_list(F.struct("place", "w"))).alias("terms")
    each = write_shared(w.where("w <> 0").groupBy("doc_id").agg(terms), "index-vectors")
    first = each.groupBy("terms").agg(F.min("doc_id").alias("doc_id"))
    squares = F.aggregate("terms", F.lit(0.0), lambda acc, t: acc + t["w"] * t["w"])
    documents = write_shared(first.select("doc_id", F.sqrt(squares).alias("norm"), "terms"), "index-documents")
    tops = (documents.select("norm", F.inline("terms")).groupBy("place").agg(F.max(F.abs("w") / F.col("norm")).alias("top")))
    copies = each.join(documents.select("terms", F.col("doc_id").alias("first")), "terms").select("first", "doc_id")
    return SparseIndex(documents, copies, write_shared(weights.join(tops, "place", "left"), "index-places"))


def query_terms(index: SparseIndex, counts: DataFrame, floor: float) -> DataFrame:
    """(id, norm, terms, rest, essential): each query's weights by place, what its other places can add at most,
    and its essential places with their unit weights."""
    w = counts.join(F.broadcast(index.places), "place").select(
        "id", "place", (F.col("n") * F.col("idf")).cast("float").cast("double").alias("w"), F.coalesce("top", F.lit(0.0)).alias("top"))
    q = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.struct("place", "w", "top")).alias("all")).where("norm > 0")
    most = F.transform("all", lambda t: F.struct((F.abs(t["w"]) / F.col("norm") * t["top"]).alias("most"), t["place"].alias("place"),
                                                 (t["w"] / F.col("norm")).alias("u")))
    q = q.withColumn("by_most", F.array_sort(most))
    sums = F.aggregate("by_most", F.array(F.lit(0.0)), lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + t["most"])))
    under = F.size(F.filter(F.slice("_sums", 2, F.greatest(F.size("by_most"), F.lit(1))), lambda s: s < F.lit(floor - SLACK)))
    q = q.withColumn("_sums", sums).withColumn("_n", under)
    essential = F.slice("by_most", F.col("_n") + 1, F.greatest(F.size("by_most"), F.lit(1)))
    return q.select("id", "norm", F.map_from_entries(F.transform("all", lambda t: F.struct(t["place"], t["w"]))).alias("terms"),
                    F.element_at("_sums", F.col("_n") + 1).alias("rest"), essential.alias("essential"), "by_most")


def _cell(k: int, floor: float, digits: int):
    """The best ``k`` documents of a document block for each query of a query block."""
    def fn(docs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(docs) and len(queries):
            docs = docs.sort_values("doc_id")
            ids, norms = docs["doc_id"].to_numpy(np.int64), docs["norm"].to_numpy(np.float64)
            place, weight = np.concatenate(docs["places"].to_numpy()), np.concatenate(docs["weights"].to_numpy())
            row = np.repeat(np.arange(len(ids)), docs["places"].map(len).to_numpy())
            by_place = np.argsort(place, kind="stable")
            place, weight, row = place[by_place], weight[by_place], row[by_place]
            at, start = np.unique(place, return_index=True)
            end = np.append(start[1:], len(place))
            unit = weight / norms[row]
            lists = {p: slice(i, j) for p, i, j in zip(at.tolist(), start.tolist(), end.tolist(), strict=True)}
            for qid, norm, places, weights, n_essential, rest in zip(*(queries[c] for c in (
                    "id", "norm", "places", "weights", "n_essential", "rest")), strict=True):
                # The essential places come last; what the others may add to a score is ``rest`` at most.
                part = np.zeros(len(ids))
                for p, w in zip(places[len(places) - n_essential:], weights[len(places) - n_essential:], strict=True):
                    if p in lists:
                        part[row[lists[p]]] += w / norm * unit[lists[p]]
                least = floor
                if len(part) > k:
                    least = max(floor, np.partition(part, -k)[-k] - rest)
                found = np.flatnonzero(part + rest >= least - SLACK)
                dot = np.zeros(len(found))
                for p, w in zip(places, weights, strict=True):
                    if p in lists and len(found):
                        held = row[lists[p]]
                        where = np.minimum(np.searchsorted(held, found), len(held) - 1)
                        dot += np.where(held[where] == found, w * weight[lists[p]][where], 0.0)
                score = np.round(dot / (norm * norms[found]), digits)
                good = np.flatnonzero(score >= floor)
                good = good[np.lexsort((found[good], -score[good]))[:k]]
                if len(good):
                    out.append(pd.DataFrame({"id": qid, "doc_id": ids[found[good]], "score": score[good]}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "doc_id": [], "score": []}).astype(
            {"id": "int64", "doc_id": "int64", "score": "float64"})
    return fn


def search(index: SparseIndex, counts: DataFrame, k: int, floor: float, digits: int = 9) -> DataFrame:
    """(id, doc_id, score, rank): up to ``k`` documents of score >= ``floor`` for each id of (id, place, n) query counts."""
    rows = F.array_sort(F.collect_list(F.struct("place", "n"))).alias("counted")
    asked = write_shared(counts.groupBy("id").agg(rows), "query-counts")
    alike = write_shared(asked.groupBy("counted").agg(F.min("id").alias("lead")), "query-leads")
    q = write_shared(query_terms(index, alike.select(F.col("lead").alias("id"), F.inline("counted")), floor), "query-terms")
    hits = write_shared(_best(_cells(index, q, k, floor, digits), k), "query-best")
    if k > 1:  # copies tie with the first of them; no more than k of a vector can be shown
        firsts = hits.select(F.col("doc_id").alias("first")).distinct()
        near = Window.partitionBy("first").orderBy("doc_id")
        copies = index.copies.join(firsts, "first", "left_semi").withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= k)
        hits = _best(hits.withColumnRenamed("doc_id", "first").join(copies, "first").select("id", "doc_id", "score"), k)
    leads = asked.join(alike, "counted").select("id", "lead")
    return leads.join(hits.withColumnRenamed("id", "lead"), "lead").select("id", "doc_id", "score", "rank")


def _best(scored: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("id").orderBy(F.desc("score"), F.asc("doc_id"))
    return scored.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)


def _cells(index: SparseIndex, q: DataFrame, k: int, floor: float, digits: int) -> DataFrame:
    """Every document block meets every query block once; blocks are small enough to keep all tasks busy."""
    tasks = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nd = max(1, math.ceil(index.documents.count() / DOC_BLOCK))
    nq = max(1, math.ceil(q.count() / QUERY_BLOCK), math.ceil(2 * tasks / nd))
    n = nd * nq
    d = index.documents.select("doc_id", "norm", F.col("terms.place").alias("places"), F.col("terms.w").alias("weights"),
                               F.pmod(F.xxhash64("doc_id"), F.lit(nd)).alias("db"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"))
    # Places in the order of what they add at most: the essential ones last.
    places = F.transform("by_most", lambda t: t["place"])
    weights = F.transform("by_most", lambda t: F.element_at("terms", t["place"]))
    a = q.select("id", "norm", places.alias("places"), weights.alias("weights"), F.size("essential").alias("n_essential"), "rest",
                 F.explode(F.sequence(F.lit(0), F.lit(nd - 1))).alias("db"), F.pmod(F.xxhash64("id"), F.lit(nq)).alias("qb"))
    cell = (F.col("db").cast("long") * nq + F.col("qb").cast("long")).alias("cell")
    d, a = d.withColumn("cell", cell).drop("db", "qb"), a.withColumn("cell", cell).drop("db", "qb")
    # An explicit count is kept by AQE, which would put small but costly cells into one task.
    return (d.repartition(2 * n, "cell").groupBy("cell").cogroup(a.repartition(2 * n, "cell").groupBy("cell"))
            .applyInPandas(_cell(k, floor, digits), _HIT))
