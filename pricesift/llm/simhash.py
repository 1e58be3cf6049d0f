"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints within ``d``
bits share at least ``8 - d`` of them, so the index holds each fingerprint under
every choice of ``8 - d`` positions: fingerprints that reach the guaranteed
number of matches meet in at least one entry, and no posting list of a single
byte is ever expanded into pairs. Within an entry the shared bytes of a pair are
tallied, a pair is judged only under the first choice that it shares, and its
bit distance is verified. An entry gives at most one edge per member (a spanning
star of each of its local components), never all its pairs. Entries of more than
``entry_limit`` distinct fingerprints are linked through midpoints instead: two
fingerprints within ``d`` bits both lie within about d/2 of a common midpoint,
and each member links to the smallest one near each of its midpoints, so the
work stays in proportion to the members. Both ways find the same components.

Exact copies collapse into one fingerprint with map-side combination before
anything is indexed. Components come from alternating star contraction on
narrow edge tables (``operators.components``).

Defined cases: a null or empty text has fingerprint zero, linked like any other;
fewer words than a shingle hash as one sequence; repeated rows are rows of one
component; a null id never becomes a component id unless every id is null; an
empty table gives no rows; other columns are ignored (``near_duplicates``) or
kept (``keep_one``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import write_shared
from .common import row_key

SEED = 42
_SLAB = 1 << 16  # shingles whose bits are counted at once


def fingerprint(text: str | None, shingle: int) -> int:
    """Signed 64-bit SimHash of the word shingles of one text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined, xxh = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return int(np.uint64(xxh(joined, SEED)).astype(np.int64))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-shingle])).tolist()
    ends = (ends[shingle - 1:] - 1).tolist()
    n, ones = len(ends), np.zeros(64, np.int64)
    for at in range(0, n, _SLAB):
        h = np.array([xxh(joined[a:b], SEED) for a, b in zip(starts[at:at + _SLAB], ends[at:at + _SLAB], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint_column(text_col: str, shingle: int) -> Column:
    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([fingerprint(t, shingle) for t in s], dtype="int64")

    return run(F.col(text_col))


def _masks(same_bytes: int) -> list[int]:
    """A signed 64-bit mask for each choice of positions."""
    out = [sum(0xFF << 8 * p for p in c) for c in combinations(range(8), same_bytes)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def _first_choice(same_bytes: int) -> np.ndarray:
    """For each 8-bit set of equal positions, the number of its first choice (-1: too few)."""
    order = {c: i for i, c in enumerate(combinations(range(8), same_bytes))}
    return np.array([order.get(tuple(p for p in range(8) if bits >> p & 1)[:same_bytes], -1) for bits in range(256)])


def _links(xor: np.ndarray, choice: int | np.ndarray, first: np.ndarray, max_bits: int) -> np.ndarray:
    """Which of these pairs to link under this choice: tally the equal bytes, then verify the bits."""
    tally = np.packbits(xor.view(np.uint8).reshape(-1, 8) == 0, axis=1, bitorder="little")[:, 0]
    return (first[tally] == choice) & (np.bitwise_count(xor.view(np.uint64)) <= max_bits)


def _star(fps: np.ndarray, choice: int, first: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges that span the local components of one index entry."""
    parent = list(range(len(fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(fps) - 1):
        for j in np.flatnonzero(_links(fps[i + 1:] ^ fps[i], choice, first, max_bits)).tolist():
            a, b = root(i), root(i + 1 + j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return [(int(fps[i]), int(fps[root(i)])) for i in range(len(fps)) if root(i) != i]


def _entry_edges(max_bits: int, entry_limit: int):
    """(choice, key, fp) rows sorted by entry -> (a, b) edges; b is null for members of a large entry."""
    first = _first_choice(8 - max_bits)

    def close(run: list[np.ndarray], choice: int, out: list) -> None:
        fps = np.unique(np.concatenate(run))
        if len(fps) > entry_limit:
            out.extend((int(x), None) for x in fps)
        elif len(fps) > 1:
            out.extend(_star(fps, choice, first, max_bits))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_n, at = [], 0, None  # the entry that may go on in the next batch
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            if not batch.num_rows:
                continue
            choice, key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cut = np.flatnonzero((np.diff(choice) != 0) | (np.diff(key) != 0)) + 1
            lo, hi = np.concatenate(([0], cut)), np.concatenate((cut, [len(fp)]))
            out: list[tuple[int, int | None]] = []
            if at is not None and at != (choice[0], key[0]):
                close(held, at[0], out)
                held, held_n = [], 0
            single = hi - lo == 1
            if held:
                single[0] = False
            single[-1] = False
            pairs = np.flatnonzero((hi - lo == 2)[:-1]) if len(lo) > 1 else np.array([], int)
            pairs = pairs[pairs > 0] if held else pairs
            if len(pairs):  # the many entries of two members, all at once
                x, y = fp[lo[pairs]], fp[lo[pairs] + 1]
                ok = _links(x ^ y, choice[lo[pairs]], first, max_bits) & (x != y)
                out.extend(zip(np.maximum(x, y)[ok].tolist(), np.minimum(x, y)[ok].tolist(), strict=True))
                single[pairs] = True
            for g in np.flatnonzero(~single):
                held.append(fp[lo[g]:hi[g]])
                held_n += hi[g] - lo[g]
                at = (choice[lo[g]], key[lo[g]])
                if g < len(lo) - 1:
                    close(held, at[0], out)
                    held, held_n = [], 0
                elif held_n > 4 * entry_limit:  # large already: keep one more than the limit, pass the rest on
                    fps = np.unique(np.concatenate(held))
                    if len(fps) > entry_limit:
                        out.extend((int(x), None) for x in fps)
                        fps = fps[:entry_limit + 1]
                    held, held_n = [fps], len(fps)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], schema=schema)
        if held:
            out = []
            close(held, at[0], out)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], schema=schema)

    return edges


def _midpoint_edges(members: DataFrame, max_bits: int) -> DataFrame:
    """Edges between fingerprints within ``max_bits``, through shared midpoints."""
    near, far = max_bits // 2, (max_bits + 1) // 2
    bits = [1 << b if b < 63 else -(1 << 63) for b in range(64)]
    flips = F.array(*[F.lit(b) for b in bits])
    flip = F.array(F.struct(F.lit(0).cast("long").alias("flip"), F.lit(0).alias("dist")),
                   *[F.struct(F.lit(b).cast("long").alias("flip"), F.lit(1).alias("dist")) for b in bits])
    if far == 2:
        flip = F.concat(flip, F.flatten(F.transform(flips, lambda x, i: F.transform(
            F.slice(flips, F.lit(1), i), lambda y: F.struct(x.bitwiseOR(y).alias("flip"), F.lit(2).alias("dist"))))))
    spread = (members.select("a", F.explode(flip).alias("f"))
              .select("a", F.col("a").bitwiseXOR(F.col("f.flip")).alias("mid"), F.col("f.dist").alias("dist")))
    # A midpoint has at most as many members as there are flips: bounded windows.
    b = F.min(F.when(F.col("dist") <= near, F.col("a"))).over(Window.partitionBy("mid"))
    return (spread.select("a", b.alias("b")).where(F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct())


def link(fps: DataFrame, max_bits: int = 4, entry_limit: int = 8192) -> DataFrame:
    """(node, root) of the distinct fingerprints in column ``fp`` that link to another one."""
    if not 1 <= max_bits <= 4:
        raise ValueError("the index is built for a distance of one to four bits")
    masks = F.array(*[F.struct(F.lit(i).alias("choice"), F.lit(m).alias("mask")) for i, m in enumerate(_masks(8 - max_bits))])
    width = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Spread the fingerprints before they multiply: their own exchange was sized for single rows.
    index = (fps.select("fp").repartition(width, "fp").select("fp", F.explode(masks).alias("m"))
             .select(F.col("m.choice").alias("choice"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("key"), "fp"))
    entries = index.repartition("choice", "key").sortWithinPartitions("choice", "key")
    found = write_shared(entries.mapInArrow(_entry_edges(max_bits, entry_limit), "a long, b long"), "entry-edges")
    large = found.where(F.col("b").isNull()).select("a").distinct()
    edges = found.where(F.col("b").isNotNull())
    if not large.isEmpty():
        edges = edges.unionByName(_midpoint_edges(large, max_bits))
    return connected_components(edges)


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id",
                    text_col: str = "text", entry_limit: int = 8192) -> DataFrame:
    """(id, _ps_key, fp, root, component_id) of every row of ``docs``.

    ``root`` is the smallest linked fingerprint, ``component_id`` the smallest id
    reachable over links, the row's own included.
    """
    keyed = write_shared(docs.select(F.col(id_col), row_key(id_col, text_col).alias("_ps_key"),
                                     fingerprint_column(text_col, shingle).alias("fp")), "fingerprints")
    fps = write_shared(keyed.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct-fingerprints")
    roots = link(fps.select("fp"), max_bits, entry_limit)
    # Most fingerprints link to none: only linked ones need their component's least id.
    linked = write_shared(fps.join(roots, fps["fp"] == roots["node"]).select("fp", "least", "root"), "linked")
    least = write_shared(linked.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    found = linked.join(least, "root").select("fp", "root", "component_id")
    labels = (fps.join(found, "fp", "left")
              .select("fp", F.coalesce("root", "fp").alias("root"),
                      F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id")))
    # Written, so that the join comes straight from two shuffles and a hot fingerprint can be split.
    return keyed.join(write_shared(labels, "labels"), "fp").select(id_col, "_ps_key", "fp", "root", "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """The row with the smallest id of each component (ties: the smallest row key), all columns kept."""
    rows = near_duplicates(docs, shingle, max_bits, id_col, text_col)
    # Ids sort before null; rows of one id are told apart by their key.
    best = rows.groupBy("root").agg(F.min(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"),
                                                   F.col("_ps_key").alias("key"))).alias("best"))
    keyed = docs.withColumn("_ps_key", row_key(id_col, text_col))
    kept = keyed.join(best.select(F.col("best.key").alias("_ps_key")), "_ps_key", "left_semi")
    return kept.dropDuplicates(["_ps_key"]).drop("_ps_key")
