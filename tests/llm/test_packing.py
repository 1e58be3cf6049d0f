import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import empty_docs, odd_docs, odd_texts, sentence
from tokenizers import Tokenizer

from pricesift.llm import chunk_ids as C
from pricesift.llm import packing as P

TOK = Tokenizer.from_file(P.default_tokenizer())
HARD = ["a<|endoftext|>b  <|startoftext|>", "é ́x Σ ΑΣ İstanbul ﬁ", "\x1c\x85a b it's 12,5", "\x0b\x0c a", "", "don't 've's''t", "a.b...c, (d) x²½",
        "日本語 テキスト 한국어", " nbsp em", "A" * 500, "word.,", "É" * 300, "<|x|>", "éá ñ"]


def whole(text):
    return [*TOK.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("entries", [100_000, 3])
def test_chunked_ids_equal_whole_text_ids(entries):
    rng = random.Random(2)
    texts = HARD + [sentence(rng, 50, 10**6).title() + rng.choice(HARD) + rng.choice(["\n", "  ", "É.À, ß "]) for _ in range(60)]
    e = C.WordEncoder(P.default_tokenizer(), False)
    e.of_chunk.entries = e.of_word.entries = entries
    for part in (texts, texts[30:], texts[::3]):
        ids, sizes = e.texts(pa.array(part, C.TEXT))
        ends = np.cumsum(sizes)
        for t, i, j in zip(part, ends - sizes, ends, strict=True):
            assert ids[i:j].tolist() == whole(t)[:-1], t


def check(rows, texts):
    """Every id in exactly one piece, gapless sequences, power-of-two lengths."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for doc, text in texts.items():
        ids, at = np.array(whole(text), "<u4"), 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == pieces[0].tier <= 2048 and at & (at - 1) == 0
    return by_seq


def test_round_trip_tiers_and_steps(spark):
    rng = random.Random(7)
    texts = {i: sentence(rng, rng.choice([1, 5, 30, 100, 400, 900, 3000]), 5000) for i in range(400)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    by_seq = check(P.pack(docs, step_tokens=8192).collect(), texts)
    steps = defaultdict(int)
    for s, pieces in by_seq.items():
        steps[s >> 32, pieces[0].tier, pieces[0].step_group] += pieces[0].tier
    last = {(t, tier): max(g for a, b, g in steps if (a, b) == (t, tier)) for t, tier, _ in steps}
    assert all(n == 8192 for (t, tier, g), n in steps.items() if g < last[t, tier]) and max(steps.values()) <= 8192
    assert sum(p[0].tier < 256 for p in by_seq.values()) <= 3 * 8  # only what a task has left at its end
    assert any(p[0].tier == 2048 and len(p) > 1 for p in by_seq.values())  # long windows filled from shorter pieces


def test_odd_rows(spark):
    docs = odd_docs(spark).dropDuplicates(["doc_id"])
    rows = P.pack(docs, with_ids=True).collect()
    check(rows, {r.doc_id: r.text for r in docs.collect()})
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    twice = odd_docs(spark)
    assert sum(r.length for r in P.pack(twice).collect()) == sum(len(whole(r.text)) for r in twice.collect())
    assert P.pack(empty_docs(spark)).count() == 0 and len(odd_texts()) > 10
