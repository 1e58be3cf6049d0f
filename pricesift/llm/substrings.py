"""Exact substring deduplication on windows of ``window`` consecutive words.

Every window gets a Rabin-Karp hash (a polynomial over 64-bit word hashes, taken
from prefix sums), and repeated hashes are found by counting in Spark. Two steps
settle most windows without a row of their own:

* A window can only repeat where its *anchor* repeats: the gram of ``gram`` words
  inside it with the smallest hash, a choice that depends on the window's words
  alone. Anchors stand at about two in ``window - gram + 2`` positions; they are
  counted first, and windows whose anchor occurs once are settled.
* Neighbouring windows that share an anchor form a run, hashed as one (the words that
  the run spans, and the anchor's place in it). A run that repeats settles all of
  its windows. Only the windows of the other runs, and of one witness for each
  repeated run whose anchor such a run shares, are hashed and counted one by one.

Windows are counted by window hash and anchor hash together (128 bits). Repeated
windows are merged into maximal removal intervals.

Equal texts collapse first, with map-side combination: one copy stands for all,
compressed for its one shuffle, and a text held by several rows has all of its
windows repeated. Counting uses
the least and greatest occurrence, never a list of occurrences, so a passage
that a third of the rows share costs a few partial aggregates; joins on hashes
are plain shuffled joins that Spark splits when skewed.

Defined cases: a null text has no words; a text shorter than a window loses
nothing; repeated rows are copies of each other and lose every window; an empty
table gives no rows; extra columns are kept by ``remove_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_shared
from .common import byte_words, texts

#: Odd multipliers of the two polynomials (both 5 modulo 8) and of the mixing step.
WINDOW_BASE, GRAM_BASE, MIX = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xBF58476D1CE4E5B9
_SLAB = 1 << 18  # windows whose anchors are sought at once


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Window and anchor hashes of one text; the power tables grow with the longest text seen."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram, self.room = window, gram, 0

    def _grow(self, n: int) -> None:
        if n > self.room:
            self.room = max(1024, 2 * n)
            self.tables = {b: (_powers(b, self.room), _powers(pow(b, -1, 1 << 64), self.room))
                           for b in (WINDOW_BASE, GRAM_BASE)}

    def _rolling(self, ids: np.ndarray, base: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = (t[:len(ids)] for t in self.tables[base])
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(ids * down, dtype=np.uint64)))
        n = len(ids) - length + 1
        return (sums[length:] - sums[:n]) * up[:n], sums

    def runs(self, anchors: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor position, run hash) of each run of windows that share an anchor."""
        first = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
        last = np.concatenate((first[1:], [len(anchors)])) - 1
        span = (sums[last + self.window] - sums[first]) * self.tables[WINDOW_BASE][0][first]
        place = (anchors[first] - first) * 65_536 + (last - first)
        return anchors[first], span + place.astype(np.uint64) * np.uint64(MIX)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(window hashes, anchor position of each window, gram hashes, prefix sums)."""
        ids = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        self._grow(len(ids))
        windows, sums = self._rolling(ids, WINDOW_BASE, self.window)
        grams, _ = self._rolling(ids, GRAM_BASE, self.gram)
        order = (grams ^ (grams >> np.uint64(31))) * np.uint64(MIX)
        order ^= order >> np.uint64(29)
        width = self.window - self.gram + 1
        views = np.lib.stride_tricks.sliding_window_view(order, width)
        anchors = np.concatenate([views[a:a + _SLAB].argmin(axis=1) + np.arange(a, min(a + _SLAB, len(views)))
                                  for a in range(0, len(views), _SLAB)])
        return windows, anchors, grams, sums


def text_keys(text_col: str) -> list[Column]:
    """Two independent 64-bit hashes that name a text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


def _longs(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns]


def _anchor_rows(window: int, gram: int):
    """(k1, k2, text) -> (k1, k2, pos, gram, run): the anchors of each text, once per task for equal texts."""
    names = ["k1", "k2", "pos", "gram", "run"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = Hasher(window, gram), set()
        for batch in batches:
            held, size = [], 0
            for k1, k2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch, 2), strict=True):
                words = byte_words(text)
                if len(words) < window or (k1, k2) in seen:
                    continue
                seen.add((k1, k2))
                _, anchors, grams, sums = hasher(words)
                at, run = hasher.runs(anchors, sums)
                held.append((np.full(len(at), k1), np.full(len(at), k2), at.astype(np.int32), grams[at], run))
                size += len(at)
                if size > 100_000:
                    yield _batch(held, names)
                    held, size = [], 0
            if held:
                yield _batch(held, names)
    return rows


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, text) -> (k1, k2, n, blob): each text of a task once, compressed; its further copies without."""
    pack, seen = zstandard.ZstdCompressor(level=3), set()
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        blobs = []
        for key, text in zip(keys, texts(batch, 2), strict=True):
            blobs.append(None if key in seen else pack.compress((text or "").encode("utf-8", "surrogatepass")))
            seen.add(key)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([1] * len(keys), pa.int64()),
                                          pa.array(blobs, pa.binary())], names=["k1", "k2", "n", "blob"])


def _unpacked(blobs: pa.Array) -> Iterator[list[bytes]]:
    """The words of compressed texts."""
    unpack = zstandard.ZstdDecompressor()
    for blob in blobs:
        yield unpack.decompress(blob.as_py()).split()


def _batch(held: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(_longs(*map(np.concatenate, zip(*held, strict=True))), names=names)


def _owned(anchors: np.ndarray, positions: pa.ListScalar) -> np.ndarray:
    """Starts of the windows whose anchor is at one of the positions."""
    flag = np.zeros(anchors[-1] + 1, bool)
    flag[positions.values.to_numpy(zero_copy_only=False)] = True
    return np.flatnonzero(flag[anchors])


def _window_rows(window: int, gram: int):
    """(k1, k2, blob, anchor positions) -> (k1, k2, start, hash, gram) of their windows."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, names = Hasher(window, gram), ["k1", "k2", "start", "hash", "gram"]
        for batch in batches:
            held, size = [], 0
            at = batch.column(3)
            for i, (k1, k2, words) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                                    _unpacked(batch.column(2)), strict=True)):
                windows, anchors, grams, _ = hasher(words)
                start = _owned(anchors, at[i])
                held.append((np.full(len(start), k1), np.full(len(start), k2), start.astype(np.int32),
                             windows[start], grams[anchors[start]]))
                size += len(start)
                if size > 100_000:
                    yield _batch(held, names)
                    held, size = [], 0
            if held:
                yield _batch(held, names)
    return rows


def merge(starts: np.ndarray, window: int) -> np.ndarray:
    """Maximal (start, end) intervals covered by windows at the given sorted starts."""
    if not len(starts):
        return np.empty((0, 2), np.int64)
    first = np.concatenate(([True], starts[1:] > starts[:-1] + window))
    last = np.concatenate((first[1:], [True]))
    return np.stack((starts[first], starts[last] + window), axis=1)


def _kept_rows(window: int, gram: int):
    """(k1, k2, blob, copies, whole, starts) -> (k1, k2, n_words, n_removed, kept_text, spans)."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(window, gram)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            whole, starts = batch.column(4), batch.column(5)
            copies = batch.column(3).to_pylist()
            out: list[list] = [[], [], [], []]
            for i, words in enumerate(_unpacked(batch.column(2))):
                found = [np.empty(0, np.int64)]
                if copies[i] > 1:  # every window starts in the copies too
                    found.append(np.arange(max(0, len(words) - window + 1)))
                elif whole[i].is_valid or starts[i].is_valid:
                    if whole[i].is_valid and len(whole[i].values):
                        found.append(_owned(hasher(words)[1], whole[i]))
                    if starts[i].is_valid:
                        found.append(starts[i].values.to_numpy(zero_copy_only=False))
                cuts = merge(np.unique(np.concatenate(found)), window)
                cuts = cuts.tolist()
                kept, at = [], 0
                for a, b in cuts:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                out[0].append(len(words))
                out[1].append(len(words) - len(kept))
                out[2].append(b" ".join(kept).decode("utf-8", "surrogatepass"))
                out[3].append([{"start": a, "end": b} for a, b in cuts])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                 pa.array(out[2], pa.string()), pa.array(out[3], span)],
                names=["k1", "k2", "n_words", "n_removed", "kept_text", "spans"])
    return rows


def cleaned_texts(docs: DataFrame, window: int = 35, gram: int = 8, text_col: str = "text") -> DataFrame:
    """(k1, k2, n_words, n_removed, kept_text, spans), one row per distinct text."""
    keyed = docs.select(*text_keys(text_col), F.col(text_col).alias("text"))
    anchors = write_shared(keyed.mapInArrow(_anchor_rows(window, gram), "k1 long, k2 long, pos int, gram long, run long"), "anchors")

    def counted(df: DataFrame, keys: list[str], place: str) -> DataFrame:
        """Least and greatest occurrence of each key."""
        spot = F.xxhash64("k1", "k2", place)
        return df.groupBy(*keys).agg(F.min(spot).alias("lo"), F.max(spot).alias("hi"))

    # Counts are written before they are joined: both sides of a join then come straight
    # from a shuffle, which is what lets Spark split a gram that very many texts share.
    grams = write_shared(counted(anchors, ["gram"], "pos").where("lo <> hi").select("gram"), "repeated-grams")
    known = write_shared(anchors.join(grams, "gram").select("k1", "k2", "pos", "gram", "run"), "repeated-anchors")
    runs = counted(known, ["gram", "run"], "pos")
    single = runs.where("lo = hi").select("gram").distinct().withColumn("single", F.lit(True))
    judged = known.join(write_shared(runs.join(single, "gram", "left"), "runs"), ["gram", "run"])
    whole = F.col("lo") != F.col("hi")
    witness = F.col("single") & (F.xxhash64("k1", "k2", "pos") == F.col("lo"))  # of a run, or the run's only one
    places = judged.groupBy("k1", "k2").agg(F.collect_set(F.when(whole, F.col("pos"))).alias("whole"),
                                            F.collect_set(F.when(witness, F.col("pos"))).alias("open"))
    places = write_shared(places, "places")
    unique = (keyed.mapInArrow(_packed_rows, "k1 long, k2 long, n long, blob binary")
              .groupBy("k1", "k2").agg(F.max("blob").alias("blob"), F.sum("n").alias("copies")))
    windows = (unique.join(places.where(F.size("open") > 0).select("k1", "k2", "open"), ["k1", "k2"])
               .select("k1", "k2", "blob", "open")
               .mapInArrow(_window_rows(window, gram), "k1 long, k2 long, start int, hash long, gram long"))
    starts = (windows.join(counted(windows, ["hash", "gram"], "start").where("lo <> hi").select("hash", "gram"), ["hash", "gram"])
              .groupBy("k1", "k2").agg(F.collect_set("start").alias("starts")))
    return (unique.join(places.select("k1", "k2", "whole"), ["k1", "k2"], "left").join(starts, ["k1", "k2"], "left")
            .select("k1", "k2", "blob", "copies", "whole", "starts")
            .mapInArrow(_kept_rows(window, gram), "k1 long, k2 long, n_words long, n_removed long, kept_text string, "
                                                  "spans array<struct<start:long,end:long>>"))


def remove_repeats(docs: DataFrame, window: int = 35, text_col: str = "text") -> DataFrame:
    """``docs`` with its texts cut down to the words that no repeated window covers."""
    out = cleaned_texts(docs, window, text_col=text_col).select(
        F.col("k1").alias("_ps_k1"), F.col("k2").alias("_ps_k2"), F.col("kept_text").alias("_ps_kept"))
    k1, k2 = text_keys(text_col)
    joined = docs.withColumn("_ps_k1", k1).withColumn("_ps_k2", k2).join(out, ["_ps_k1", "_ps_k2"])
    return joined.withColumn(text_col, F.col("_ps_kept")).select(*docs.columns)
