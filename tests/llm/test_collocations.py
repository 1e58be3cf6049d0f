import random
import re
from collections import Counter

import pytest
from helpers import empty_docs, odd_docs, sentence

from pricesift.llm import collocations as C


def plain_mine(rows, support, top=2000):
    """Count everything; rows are (lang, text)."""
    f, n = Counter(), Counter()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = [x for x in re.split(r"[\x20\x09]", piece) if x]
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i:i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    often = {k: a for k, a in f.items() if a >= support}
    longer = {(lang, w[i:j]) for (lang, w), b in often.items() for i in range(len(w)) for j in range(i + 1, len(w) + 1)
              if (i, j) != (0, len(w)) and b >= f[lang, w[i:j]]}
    out = []
    for (lang, w), a in often.items():
        if len(w) < 2 or (lang, w) in longer:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(r[0], i + 1, *r[1:]) for i, r in enumerate(mine)]
    return sorted(ranked)


def mine(docs, **kw):
    return sorted(tuple(r) for r in C.mine(docs, **kw).collect())


def texts(rng, n):
    idioms = [sentence(rng, k, 50) for k in (2, 3, 5, 7)]
    out = []
    for i in range(n):
        parts = [rng.choice([sentence(rng, rng.randrange(12), 40), rng.choice(idioms).title(), "the end", "zu\tEnde  gehen"]) for _ in range(rng.randrange(9))]
        out.append((["en", "de", None, "und"][i % 4], rng.choice([", ", " ", "\n", ". "]).join(parts)))
    return out


@pytest.mark.parametrize(("support", "share", "lowering", "top"), [(3, 4, 0.5, 2000), (10, 8, 0.4, 2000), (5, 50, 5.0, 7)])
def test_equals_plain_count(spark, support, share, lowering, top):
    rows = texts(random.Random(support), 300)
    rows += [("en", "rare words stand in one document only. " * 30), ("fr", "x " * 500)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string").repartition(4)
    assert mine(docs, support=support, top=top, sample_share=share, lowering=lowering) == plain_mine(rows, support, top)


def test_expansion_pass_closes_a_failed_border(spark):
    rows = texts(random.Random(1), 200) + [("en", "one long idiom that stays " * 40)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    want = {(lang, w): None for lang, w in ()}
    full = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,\n]", (text or "").lower()):
            w = piece.split()
            full.update((lang or "und", " ".join(w[i:i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    want = {k: a for k, a in full.items() if a >= 6}
    for share, lowering in ((1, 0.1), (1000, 1.0), (3, 3.0)):
        found, _, passes = C.frequent_phrases(docs, 6, share, lowering)
        assert {(r.lang, r.phrase): r.f for r in found.collect()} == want
        assert passes == (1 if share == 1 else 2)


def test_small_blocks_slabs_and_crowded_bits_change_nothing(spark, monkeypatch):
    rows = texts(random.Random(2), 120) + [("en", "a b c d e, " * 900)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    want = plain_mine(rows, 4)
    monkeypatch.setattr(C, "BLOCK_BYTES", 200)
    assert mine(docs, support=4) == want
    monkeypatch.setattr(C, "MIN_BITS", 64)
    monkeypatch.setattr(C, "MAX_BITS", 64)
    assert len(C.bit_table(spark.createDataFrame([("en", "a b")], "lang string, phrase string"))) == 1
    assert mine(docs, support=4) == want
    text = "a b. c d, " * 50 + "no end " * 100
    assert b"".join(C._slabs(text, 30)) == text.encode() and 700 <= max(map(len, C._slabs(text, 30))) < 740


def test_exact_beyond_64_bits(spark):
    frequent = spark.createDataFrame([("en", "a", 1, 3 * 10**12), ("en", "b", 1, 10**12 + 1), ("en", "a b", 2, 10**12)], C.PHRASES)
    totals = spark.createDataFrame([("en", 9 * 10**14)], "lang string, n long")
    row = C.scored(frequent, totals).first()
    assert row.score == 1000 * 10**12 * 9 * 10**14 // (3 * 10**12 * (10**12 + 1))


def test_odd_rows(spark):
    docs = odd_docs(spark)
    assert mine(docs, support=2) == plain_mine([(r.lang, r.text) for r in docs.collect()], 2)
    assert mine(empty_docs(spark)) == []
    assert mine(spark.createDataFrame([(None, None), ("en", ""), ("en", " .. ")], "lang string, text string"), support=1) == []


def test_border_is_summed_by_hash_before_it_is_counted(spark):
    rng = random.Random(4)
    rows = [("en", sentence(rng, 400, 60) + ". " + "two words " * 5) for _ in range(40)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    words = C.bit_table(C.counted(docs, C.Gate(None, (1,)), 30).where("n_words = 1"))
    border = {(r.lang, r.phrase): r.f for r in C.counted(docs, C.Gate(words, (2, 3)), 1).collect()}
    often = {k: f for k, f in border.items() if f >= 30}
    sums = C.may_reach(docs, C.Gate(words, (2, 3)), 30)
    assert [f.dataType.simpleString() for f in sums.schema] == ["bigint"]
    reach = C.bit_table(sums)
    left = {(r.lang, r.phrase): r.f for r in C.counted(docs, C.Gate(words, (2, 3), reach=reach), 1).collect()}
    assert often.items() <= left.items() and len(left) <= len(often) + 5 < len(border) / 20
    assert mine(docs, support=30) == plain_mine(rows, 30)


def test_block_sums_hold_bits_and_counts():
    table = C.np.full(1, ~C.np.uint64(0))
    packed = C.np.concatenate(list(C.sum_block("en", [b"a b a b a"], C.Gate(table, (2,)))))
    assert sorted((packed & C.np.uint64(C._COUNT_MASK)).tolist()) == [2, 2]
    hashes = C._phrase_hashes(["en", "en"], ["a b", "b a"])
    assert sorted((packed >> C.np.uint64(C._COUNT_BITS)).tolist()) == sorted(C._summed_by(hashes).tolist())
