"""Token ids on disk: independent zstandard frames with a seek table at the end of a shard.

``write_tokens`` sorts the documents by id (range partitions, one shard a task), encodes
them, ends each with ``end_id`` and writes the ids, little-endian unsigned 32-bit, into
frames of ``frame_ids`` ids that decompress on their own. A shard is

    skippable frame   JSON header: format, id width, ids a frame, vocabulary file
    frames            zstandard, one after the other
    skippable frame   seek table: for each frame its compressed size, its size and the low
                      half of its XXH64; then the number of frames, a flag byte and a magic

which is the public seekable layout, so that ``zstd -d`` decompresses a shard as well. The
index, a table (doc_id, shard, first, n_tokens), says where a document lies. ``read_tokens``
takes any rows of the index, reads the seek table, decompresses the frames that hold the
wanted ids and checks their sums; a frame that does not match raises. ``with_starts`` adds
the number of ids of all documents before a document, over all shards.

Files go to a folder under the shared checkpoint folder through ``pyarrow.fs``. Their names
hold the task attempt, and only shards named in the written index are read, so a task that
is run again does no harm. A task holds one frame and one block of texts at a time.

Defined cases: a null or empty text is the end id alone; null ids come first; rows of equal
id are separate documents, ordered by their texts' hash and then by their place in the
input; an empty table gives no shard and no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir, write_shared
from .chunk_ids import ByteEncoder, blocks, encoder

FRAME_IDS, LEVEL = 1 << 16, 3
# Fixed values of the public seekable zstandard layout.
SKIPPABLE_HEADER, SKIPPABLE_TABLE, SEEKABLE_MAGIC, HAS_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class ShardWriter:
    """Writes ids to one shard, frame by frame."""

    def __init__(self, out, frame_ids: int, about: dict):
        self.out, self.frame_ids, self.written = out, frame_ids, 0
        self.held, self.n_held, self.table = [], 0, []
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)
        header = json.dumps({"format": "token-frames-1", "id_bytes": 4, "frame_ids": frame_ids, **about}, sort_keys=True).encode()
        out.write(struct.pack("<II", SKIPPABLE_HEADER, len(header)) + header)

    def add(self, ids: np.ndarray) -> None:
        self.written += len(ids)
        while self.n_held + len(ids) >= self.frame_ids:
            room = self.frame_ids - self.n_held
            self._frame(ids[:room])
            ids = ids[room:]
        if len(ids):
            self.held.append(ids.copy())
            self.n_held += len(ids)

    def _frame(self, last: np.ndarray) -> None:
        raw = np.concatenate([*self.held, last]).astype("<u4", copy=False).tobytes()
        packed = self.packer.compress(raw)
        self.out.write(packed)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.n_held = [], 0

    def close(self) -> None:
        if self.n_held:
            self._frame(np.empty(0, "<u4"))
        table = b"".join(struct.pack("<III", *row) for row in self.table)
        footer = struct.pack("<IBI", len(self.table), HAS_CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_TABLE, len(table) + len(footer)) + table + footer)
        self.out.close()


class ShardReader:
    """Ids of a shard by place; keeps the frame read last."""

    def __init__(self, file):
        self.file, end = file, file.size()
        if end < 25:
            raise ValueError("a shard is too short to have a seek table")
        file.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        size = n * 12 + 9
        if magic != SEEKABLE_MAGIC or flags != HAS_CHECKSUMS or end < size + 8:
            raise ValueError("a shard has no seek table at its end")
        file.seek(end - size - 8)
        if struct.unpack("<II", file.read(8)) != (SKIPPABLE_TABLE, size):
            raise ValueError("a shard's seek table is damaged")
        rows = np.frombuffer(file.read(n * 12), "<u4").reshape(n, 3).astype(np.int64)
        self.sizes, self.raw_sizes, self.sums = rows.T if n else np.zeros((3, 0), np.int64)
        file.seek(0)
        magic, size = struct.unpack("<II", file.read(8))
        if magic != SKIPPABLE_HEADER:
            raise ValueError("a shard has no header")
        self.about = json.loads(file.read(size))
        self.offsets = 8 + size + np.cumsum(self.sizes) - self.sizes
        self.at, self.ids, self.unpacker, self.frames_read = -1, None, zstandard.ZstdDecompressor(), 0

    def frame(self, k: int) -> np.ndarray:
        if k != self.at:
            if not 0 <= k < len(self.sizes):
                raise ValueError("a shard ends before the wanted ids")
            self.file.seek(int(self.offsets[k]))
            raw = self.unpacker.decompress(self.file.read(int(self.sizes[k])), max_output_size=int(self.raw_sizes[k]))
            if len(raw) != self.raw_sizes[k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} of a shard does not match its checksum")
            self.at, self.ids, self.frames_read = k, np.frombuffer(raw, "<u4"), self.frames_read + 1
        return self.ids

    def read(self, first: int, n: int) -> np.ndarray:
        """Ids ``first`` to ``first + n``."""
        size, parts = self.about["frame_ids"], []
        while n:
            ids = self.frame(first // size)[first % size:first % size + n]
            if not len(ids):
                raise ValueError("a shard ends before the wanted ids")
            parts.append(ids)
            first, n = first + len(ids), n - len(ids)
        return np.concatenate(parts) if parts else np.empty(0, "<u4")


def new_folder(spark: SparkSession) -> str:
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    store, base = fs.FileSystem.from_uri(path)
    store.create_dir(base)
    return path


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str | None = None, end_id: int = 0, frame_ids: int = FRAME_IDS,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents in the order of their ids; the written index (id, shard_no, shard, first, n_tokens)."""
    path = tokenizer_path or default_tokenizer()
    about = {"vocabulary": path.rsplit("/", 1)[-1], "end_id": end_id}
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("shard_no", T.IntegerType()),
                           T.StructField("shard", T.StringType()), T.StructField("first", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, store_and_base, out, name = TaskContext.get(), fs.FileSystem.from_uri(folder), None, ""
        encode = encoder(ByteEncoder, path)
        for batch in batches:
            for at, texts in blocks(batch.column(1)):
                if out is None:
                    store, base = store_and_base
                    name = f"{base}/shard-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.zst"
                    out = ShardWriter(store.open_output_stream(name, compression=None), frame_ids, about)
                ids, sizes = encode.texts(texts)
                first, n = out.written, len(sizes)
                ended = np.insert(ids, np.cumsum(sizes), end_id).astype("<u4", copy=False)
                out.add(ended)
                sizes = sizes + 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), pa.array(np.full(n, task.partitionId(), np.int32)), pa.array([name] * n, pa.string()),
                     pa.array(first + np.cumsum(sizes) - sizes, pa.int64()), pa.array(sizes, pa.int64())], names=[f.name for f in schema.fields])
        if out is not None:
            out.close()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["_ps_id", "_ps_hash", "_ps_place"]
    keyed = docs.select(F.col(id_col).alias("_ps_id"), F.col(text_col).alias("_ps_text"), F.xxhash64(text_col).alias("_ps_hash"),
                        F.monotonically_increasing_id().alias("_ps_place"))
    sorted_docs = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("_ps_id", "_ps_text")
    return write_shared(sorted_docs.mapInArrow(rows, schema), "token-index")


def with_starts(index: DataFrame) -> DataFrame:
    """Adds ``start``: the ids of all documents before. The shards' sizes, one row a shard file, are summed up in the driver."""
    spark, before, at = index.sparkSession, [], 0
    for shard_no, n in sorted(map(tuple, index.groupBy("shard_no").agg(F.sum("n_tokens")).collect())):
        before.append((shard_no, at))
        at += n
    offsets = F.broadcast(spark.createDataFrame(before, "shard_no int, _ps_before long"))  # one row a shard file
    return index.join(offsets, "shard_no").withColumn("start", F.col("_ps_before") + F.col("first")).drop("_ps_before")


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Index rows with their ids, a few million ids at a time; a shard is opened once per run of its rows."""
    store, _ = fs.FileSystem.from_uri(folder)
    name, reader = None, None
    for batch in batches:
        shards, firsts, sizes = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("shard", "first", "n_tokens"))
        held, size, began = [], 0, 0
        for i, (shard, first, n) in enumerate(zip(shards, firsts, sizes, strict=True)):
            if shard != name:
                name, reader = shard, ShardReader(store.open_input_file(shard))
            held.append(reader.read(first, n))
            size += n
            if size >= 1 << 21 or i + 1 == batch.num_rows:
                yield batch.slice(began, len(held)), held
                held, size, began = [], 0, i + 1


def read_tokens(index: DataFrame, folder: str) -> DataFrame:
    """Any rows of the index with their ``ids``. Rows of one shard that stand together share its frames."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids in _read(batches, folder):
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).view("<i4")))
            yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "ids"])

    return index.mapInArrow(rows, T.StructType([*index.schema, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def read_digests(index: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) as read back: the ids are counted and summed where they are read."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids in _read(batches, folder):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(list(map(len, ids)), pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = T.StructType([index.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32")]])
    return index.select("doc_id", "start", "shard", "first", "n_tokens").mapInArrow(rows, schema)
