"""Hierarchical multi-length packing of tokenised documents.

Each task packs its own share of the documents in a stream, with a bounded
buffer, so nothing is shuffled and memory does not depend on the input:

1. A document becomes token ids plus an end id; full windows of the longest tier
   are cut from its front at once.
2. The rest is routed to the shortest tier (a power of two) that holds it.
3. Tiers are packed from the longest to the shortest: the longest waiting piece
   opens a window of its tier, whose gap takes the longest piece that fits, again
   and again, down through the shorter tiers; where none fits, the shortest
   piece is cut to close the gap and its tail waits on.
4. Windows are therefore full; what a task has left at its end goes into windows
   of falling powers of two, so no padding is needed anywhere.
5. Windows of one tier are dealt to step groups of ``step_tokens`` tokens each:
   every step has one shape and equal work.

Tokens come from white-space separated chunks (see ``chunk_ids``): the tokenizer's
splitting never crosses ASCII white space, so the ids of a text are those of its chunks
in order (the equality with whole-text encoding is tested).

Defined cases: a null or empty text is a document of the end id alone; repeated rows
are packed as separate documents; an empty table gives no rows; other columns are
ignored. ``sequence_id`` is the task's number times 2**32 plus a counter.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .chunk_ids import WordEncoder, blocks, encoder

TIERS = (256, 512, 1024, 2048)
_BUFFER_TOKENS = 1 << 19


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class Packer:
    """Packs the pieces of one task; ``emit`` gets (piece, sequence, offset, tier, step)."""

    def __init__(self, tiers: tuple[int, ...], step_tokens: int, first_sequence: int, emit):
        self.tiers, self.step_tokens, self.next, self.emit = tiers, step_tokens, first_sequence, emit
        self.pool: list[tuple[int, int, tuple]] = []  # (length, arrival, piece), shortest first
        self.waiting, self.arrived, self.made = 0, 0, dict.fromkeys(tiers, 0)

    def add(self, doc, ids: np.ndarray) -> None:
        top, at = self.tiers[-1], 0
        while len(ids) - at >= top:
            self._window(top, [(doc, at, ids[at:at + top], len(ids))])
            at += top
        if at < len(ids):
            self._wait((doc, at, ids[at:].copy(), len(ids)))
        if self.waiting > _BUFFER_TOKENS:
            self.pack()

    def _wait(self, piece: tuple) -> None:
        self.arrived += 1
        insort(self.pool, (len(piece[2]), self.arrived, piece), key=lambda p: p[:2])
        self.waiting += len(piece[2])

    def _take(self, i: int) -> tuple:
        n, _, piece = self.pool.pop(i)
        self.waiting -= n
        return piece

    def _cut(self, piece: tuple, room: int) -> tuple:
        """The head of a piece; its tail waits on, in the tier of its own length."""
        doc, at, ids, total = piece
        if len(ids) > room:
            self._wait((doc, at + room, ids[room:], total))
        return (doc, at, ids[:room], total)

    def _window(self, tier: int, pieces: list[tuple]) -> None:
        step = self.made.get(tier, 0) * tier // self.step_tokens
        self.made[tier] = self.made.get(tier, 0) + 1
        offset = 0
        for p in pieces:
            self.emit(p, self.next, offset, tier, step)
            offset += len(p[2])
        self.next += 1

    def pack(self, last: bool = False) -> None:
        """Fill windows while the waiting pieces can fill the longest; at the end, all of them."""
        while self.waiting >= self.tiers[-1] or (last and self.waiting):
            piece = self._take(len(self.pool) - 1)
            tier = next(t for t in self.tiers if t >= len(piece[2]))
            tier = min(tier, 1 << ((self.waiting + len(piece[2])).bit_length() - 1))
            pieces = [self._cut(piece, tier)]
            gap = tier - len(pieces[0][2])
            while gap:
                fits = bisect_right(self.pool, gap, key=lambda p: p[0])
                pieces.append(self._cut(self._take(max(0, fits - 1)), gap))
                gap -= len(pieces[-1][2])
            self._window(tier, pieces)


def pack(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 1, tiers: tuple[int, ...] = TIERS,
         step_tokens: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text",
         with_ids: bool = False) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group[, ids])."""
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(tiers):
        raise ValueError("tiers are rising powers of two")
    path = tokenizer_path or default_tokenizer()
    kind = docs.schema[id_col].dataType
    fields = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([T.StructField(id_col, kind), *[T.StructField(f, T.LongType()) for f in fields],
                           T.StructField("tier", T.IntegerType()), T.StructField("step_group", T.LongType()),
                           *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out = encoder(WordEncoder, path), []
        held = 0  # tokens in out
        kind = None

        def emit(piece, sequence, offset, tier, step):
            nonlocal held
            out.append((*piece, sequence, offset, tier, step))
            held += len(piece[2])

        def flush() -> pa.RecordBatch:
            nonlocal held
            doc, at, ids, total, sequence, offset, tier, step = zip(*out, strict=True)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            columns = [pa.array(doc, kind), pa.array(at, pa.int64()), pa.array(sizes),
                       pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(total, pa.int64()),
                       pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()),
                       pa.array(tier, pa.int32()), pa.array(step, pa.int64())]
            if with_ids:
                ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32))))
            out.clear()
            held = 0
            return pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

        packer = Packer(tiers, step_tokens, TaskContext.get().partitionId() << 32, emit)
        for batch in batches:
            kind = batch.schema.field(0).type
            for at, texts in blocks(batch.column(1)):
                ids, sizes = encode.texts(texts)
                ids = np.insert(ids, np.cumsum(sizes), end_id)
                ends = np.cumsum(sizes + 1).tolist()
                for doc, begin, end in zip(batch.column(0).slice(at, len(texts)).to_pylist(), [0, *ends], ends, strict=False):
                    packer.add(doc, ids[begin:end])
                    if len(out) >= 10_000 or held >= 1 << 21:
                        yield flush()
        packer.pack(last=True)
        if out:
            yield flush()

    return docs.select(id_col, text_col).mapInArrow(rows, schema)
