import hashlib
import random
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pytest
import sentencepiece
from helpers import empty_docs, key, odd_docs, sentence
from test_token_store import HARD
from tokenizers import Tokenizer

from pricesift.llm import alignment as A
from pricesift.llm.chunk_ids import byte_letters

PATHS = A.default_tokenizers()
TOK = Tokenizer.from_file(PATHS[0])
TOK.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
BYTE_OF = {c: b for b, c in byte_letters().items()}


def a_tokens(text):
    ids = TOK.encode(" " + text, add_special_tokens=False).ids
    return ids, [bytes(BYTE_OF[c] for c in TOK.id_to_token(i)) for i in ids]


def b_tokens(text):
    ids = PIECES.encode(text, num_threads=1)
    return ids, [bytes([int(PIECES.id_to_piece(i)[3:5], 16)]) if PIECES.is_byte(i) else PIECES.id_to_piece(i).replace("▁", " ").encode() for i in ids]


def plain_groups(text):
    """Whole texts, sets of ends."""
    if not text:
        return []
    (a, x), (b, y) = a_tokens(text), b_tokens(text)
    if not b"".join(x) == b"".join(y) == (" " + text).encode():
        return []
    ends = [[*accumulate(map(len, said))] for said in (x, y)]
    cuts = set(ends[0]) & set(ends[1])
    out = [([], [])]
    for side, ids in enumerate((a, b)):
        at = 0
        for i, e in zip(ids, ends[side], strict=True):
            while len(out) <= at:
                out.append(([], []))
            out[at][side].append(i)
            at += e in cuts
    return out


def plain_align(rows):
    groups = [plain_groups(t) for _, t in rows]
    count = Counter(p for g in groups for p in {(i, j) for x, y in g for i in x for j in y})
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    out = []
    for (doc, _), g in zip(rows, groups, strict=True):
        links = [(i, j) for x, y in g for i in x for j in y]
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((doc, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links),
                    hashlib.sha256(said.encode()).hexdigest() if g else "", sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links)))
    return sorted(out, key=key)


@pytest.mark.parametrize("seed", range(30))
def test_divide_and_conquer_equals_common_ends(seed):
    rng = random.Random(seed)
    end = rng.choice([1, 2, 9, 60, 400])
    draw = lambda p: sorted({x for x in range(1, end) if rng.random() < p} | {end})
    a, b = draw(rng.choice([0, .1, .5, 1])), draw(rng.choice([0, .1, .5, 1]))
    if seed % 5 == 0:  # no common end but the last
        a, b = [x for x in a if x % 2 or x == end], [x for x in b if not x % 2 or x == end]
    cuts = sorted(set(a) & set(b))
    want = [(sum(x <= low for x in a), sum(x <= high for x in a), sum(x <= low for x in b), sum(x <= high for x in b))
            for low, high in zip([0, *cuts], cuts, strict=False)]
    assert A.shared_groups(a, b) == want
    many = A.shared_groups_of_many(np.array(a), np.array(b), np.array([0, len(a)]), np.array([0, len(b)]))
    assert list(zip(*(x.tolist() for x in many), strict=True)) == want


@pytest.mark.parametrize("few", [1, 64])
def test_many_lists_at_once(few, monkeypatch):
    monkeypatch.setattr(A, "FEW", few)
    rng = random.Random(few)
    lists, want, base = [], [], 0
    flat, starts = ([], []), ([0], [0])
    for _ in range(500):
        end = rng.choice([1, 2, 5, 30])
        lists = [sorted({x for x in range(1, end) if rng.random() < rng.choice([.1, .5, 1])} | {end}) for _ in range(2)]
        want += [(i + starts[0][-1], j + starts[0][-1], k + starts[1][-1], m + starts[1][-1]) for i, j, k, m in A.shared_groups(*lists)]
        for side in (0, 1):
            flat[side].extend(base + x for x in lists[side])
            starts[side].append(len(flat[side]))
        base += end
    found = A.shared_groups_of_many(*map(np.array, flat), *map(np.array, starts))
    assert list(zip(*(x.tolist() for x in found), strict=True)) == want


def test_no_end_is_looked_at_twice():
    class Seen(list):
        looks = 0

        def __getitem__(self, i):
            Seen.looks += 1
            return super().__getitem__(i)

    for b in ([*range(2, 40_001, 2)], [1, *range(2, 40_001, 2)], [*range(2, 40_000, 2), 39_999, 40_000]):
        Seen.looks = 0
        assert len(A.shared_groups(Seen([*range(1, 40_000, 2), 40_000]), b)) == len({*range(1, 40_000, 2), 40_000} & set(b))
        assert Seen.looks <= 3 * 20_001


def align(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(map(tuple, A.align(docs, **kw).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum").collect()), key=key)


def test_equals_plain_version_on_whole_texts(spark):
    rng = random.Random(5)
    mixed = [rng.choice(HARD) + rng.choice([" ", "\n", "  "]) + sentence(rng, 30, 300).title() + rng.choice([" ", "", "  "]) + rng.choice(HARD) for _ in range(60)]
    texts = [*HARD, *mixed, "<s> <unk> <0x41> </s>", "a▁b plain", "▁", "x" * 3000, "é" * 700, "12345678901234567890" * 20]
    rows = [(i, t) for i, t in enumerate(texts)]
    assert align(spark, rows) == align(spark, rows, entries=50) == plain_align(rows)


def test_sf_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = A.align(docs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum").collect()
    assert sorted(map(tuple, got), key=key) == plain_align(rows)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = sorted(map(tuple, A.align(docs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum").collect()), key=key)
    assert got == plain_align([(r.doc_id, r.text) for r in docs.collect()])
    assert A.align(empty_docs(spark)).count() == 0
    none = spark.createDataFrame([(1, None), (2, ""), (None, None)], "doc_id long, text string")
    assert [tuple(r)[1:] for r in A.align(none).collect()] == [(0, 0, 0, 0, "", 0, 0)] * 3
