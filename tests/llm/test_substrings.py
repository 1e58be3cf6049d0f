import hashlib
import random
from collections import Counter

from helpers import empty_docs, odd_docs, sentence, word_list
from pyspark.sql import functions as F

from pricesift.llm import substrings


def plain(texts, window):
    counts = Counter()
    for t in texts:
        w = word_list(t)
        counts.update(tuple(w[i:i + window]) for i in range(len(w) - window + 1))
    out = []
    for t in texts:
        w = word_list(t)
        hit = [False] * len(w)
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i:i + window])] > 1:
                hit[i:i + window] = [True] * window
        out.append(" ".join(x for x, h in zip(w, hit, strict=True) if not h))
    return out


def passages(seed, n):
    """Texts that share passages cut at random places, with a few words changed."""
    rng = random.Random(seed)
    pool = [sentence(rng, 90, 3000) for _ in range(5)]
    out = []
    for _ in range(n):
        parts = [sentence(rng, rng.randrange(30), 3000)]
        for _ in range(rng.randrange(1, 4)):
            w = rng.choice(pool).split()
            a = rng.randrange(40)
            w = w[a:a + rng.randrange(20, 60)]
            if rng.random() < 0.4:
                w[rng.randrange(len(w))] = "edit"
            parts += [" ".join(w), sentence(rng, rng.randrange(20), 3000)]
        out.append(" \n".join(parts))
    return out


def test_random_passages_equal_brute_force(spark):
    for seed in range(3):
        texts = passages(seed, 60) + ["ab " * 100, "cd ef " * 60]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
        for window in (35, 12):
            got = {r.doc_id: r.text for r in substrings.remove_repeats(docs, window).collect()}
            want = plain(texts, window)
            assert [got[i] for i in range(len(texts))] == want


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = docs.collect()
    got = substrings.remove_repeats(docs)
    assert got.columns == docs.columns
    want = plain([r.text for r in rows], 35)
    assert sorted(hashlib.sha256(t.encode()).hexdigest() for t in want) == sorted(
        r.h for r in got.select(F.sha2("text", 256).alias("h")).collect())
    assert substrings.remove_repeats(empty_docs(spark)).count() == 0
