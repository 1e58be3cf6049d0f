import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from helpers import empty_docs, odd_docs, odd_texts, sentence
from pyarrow import fs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pricesift.llm import chunk_ids as C
from pricesift.llm import token_store as S

TOK = Tokenizer.from_file(S.default_tokenizer())
PLAIN = Tokenizer.from_file(S.default_tokenizer())
PLAIN.encode_special_tokens = True
HARD = ["a<|endoftext|>b  <|endoftext|>", "é ́x Σ ΑΣ İ ﬁ", "\x1c\x85a b it's 12,5 x\x1c  y\x85  z", "\x0b\x0c a", "", " ", "don't 've's''t  ", "a.b...c, (d) x²½",
        "日本語 テキスト 한국어", " nbsp em  x", "A" * 500, "a \n b\n\n c", "\n x\t y  z    q", " lead", "  two", "trail  ", "ÿ × ÷ ª É.À, ß", "x\n y\n  z", "<|endoftext|>"]


def whole(text, end=0):
    return [*TOK.encode(text or "", add_special_tokens=False).ids, end]


@pytest.mark.parametrize("plain", [False, True])
@pytest.mark.parametrize("entries", [100_000, 3])
def test_chunked_ids_equal_whole_text_ids(plain, entries):
    rng = random.Random(1)
    texts = HARD + [sentence(rng, 40, 10**6).title() + rng.choice(HARD) + rng.choice(["\n", " ", "  "]) + sentence(rng, 5) for _ in range(200)]
    e = C.ByteEncoder(S.default_tokenizer(), plain)
    e.of_chunk.entries = e.of_word.entries = entries
    for part in (texts, texts[50:], texts[::3]):
        ids, sizes = e.texts(pa.array(part, C.TEXT))
        ends = np.cumsum(sizes)
        for t, a, b in zip(part, ends - sizes, ends, strict=True):
            assert ids[a:b].tolist() == (PLAIN if plain else TOK).encode(t, add_special_tokens=False).ids, repr(t)


def written(spark, docs, **kw):
    folder = S.new_folder(spark)
    return folder, S.with_starts(S.write_tokens(docs, folder, **kw))


def test_round_trip_in_order_of_ids(spark):
    rng = random.Random(4)
    texts = {i: sentence(rng, rng.choice([0, 1, 40, 700, 9000]), 5000) for i in rng.sample(range(10**6), 150)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    folder, index = written(spark, docs, frame_ids=1000)
    at = 0
    rows = {r.doc_id: r for r in S.read_tokens(index, folder).collect()}
    digests = {r.doc_id: r for r in S.read_digests(index, folder).collect()}
    assert index.select("shard").distinct().count() > 1 and max(r.n_tokens for r in rows.values()) > 5000
    for i in sorted(texts):
        ids = whole(texts[i])
        assert rows[i].ids == ids and rows[i].start == at == digests[i].start and rows[i].n_tokens == len(ids)
        assert digests[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and digests[i].n_tokens == len(ids)
        at += len(ids)


def test_a_shard_is_plain_zstandard_and_a_document_reads_its_frames_only(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * 50) for i in range(400)], "doc_id long, text string")
    folder, index = written(spark, docs, frame_ids=512)
    store, _ = fs.FileSystem.from_uri(folder)
    want = index.where("doc_id = 217").first()
    raw = store.open_input_file(want.shard).read()
    inner = index.where(F.col("shard") == want.shard).orderBy("first").collect()
    ids = [x for r in inner for x in whole(f"w{r.doc_id} " * 50)]
    data, rest = b"", raw[8 + struct.unpack("<I", raw[4:8])[0]:]
    while rest[:4] == b"\x28\xb5\x2f\xfd":
        d = zstandard.ZstdDecompressor().decompressobj()
        data += d.decompress(rest)
        rest = d.unused_data
    assert np.frombuffer(data, "<u4").tolist() == ids and struct.unpack("<I", raw[-4:])[0] == 0x8F92EAB1
    reader = S.ShardReader(store.open_input_file(want.shard))
    assert reader.read(want.first, want.n_tokens).tolist() == whole("w217 " * 50)
    assert reader.frames_read <= want.n_tokens // 512 + 2 < len(reader.sizes) and reader.about["vocabulary"] == "byte_bpe_50k.json"


def test_damage_is_found(tmp_path):
    ids = np.arange(5000, dtype="<u4")
    path = tmp_path / "a.zst"
    writer = S.ShardWriter(open(path, "wb"), 1000, {})
    writer.add(ids)
    writer.close()
    raw = path.read_bytes()

    def read(data, first=0, n=5000):
        path.write_bytes(data)
        return S.ShardReader(fs.LocalFileSystem().open_input_file(str(path))).read(first, n)

    assert read(raw).tolist() == ids.tolist() and read(raw, 4990, 10).tolist() == list(range(4990, 5000))
    swapped = bytearray(raw)
    swapped[-13] ^= 1  # the last frame's sum in the table
    assert read(bytes(swapped), 0, 3000).tolist() == list(range(3000))
    for bad, args in ((bytes(swapped), (4500, 10)), (raw[:-1], ()), (raw[:20], ()), (b"", ()), (raw, (4990, 11))):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            read(bad, *args)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    folder, index = written(spark, docs, frame_ids=4096)
    rows = sorted(S.read_tokens(index, folder).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows[:-1]]]).tolist()
    assert [r.doc_id for r in rows] == sorted([r.doc_id for r in docs.collect()], key=lambda x: (x is not None, x))
    assert sorted((str(r.doc_id), r.ids) for r in rows) == sorted((str(r.doc_id), whole(r.text)) for r in docs.collect())
    folder, index = written(spark, empty_docs(spark))
    assert S.read_digests(index, folder).count() == 0 and len(odd_texts()) > 10


def test_one_hot_id_is_spread(spark):
    docs = spark.range(600).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    folder, index = written(spark, docs)
    assert index.select("shard").distinct().count() > 1
    assert sorted(r.start for r in S.read_digests(index, folder).collect()) == [len(whole("same text")) * i for i in range(600)]
