import random
import zlib

import numpy as np
from helpers import empty_docs, odd_docs, sentence

from pricesift.llm import quality_fm as M


def random_model(seed=1):
    rng = np.random.default_rng(seed)
    size = (1 << M.BITS) + M.N_STRUCTURE
    return M.Model(0.3, rng.normal(size=size).astype(np.float32), rng.normal(size=(size, M.FACTORS)).astype(np.float32),
                   np.zeros(M.N_STRUCTURE), np.ones(M.N_STRUCTURE))


def test_linear_time_score_equals_the_sum_over_pairs():
    model = random_model()
    texts = ["a b c a", "one two three four five six", "", None, "x " * 40 + "y!"]
    place, value, starts = model.rows([M.hashed_words(t) for t in texts], np.array([M.structure(t, None) for t in texts]))
    got, _ = model.raw(place, value, starts)
    for r in range(len(texts)):
        p, v = place[starts[r]:starts[r + 1]], value[starts[r]:starts[r + 1]].astype(float)
        pairs = sum(float(model.v[p[i]] @ model.v[p[j]]) * v[i] * v[j] for i in range(len(p)) for j in range(i))
        assert abs(got[r] - (model.w0 + float(model.w[p] @ v) + pairs)) < 1e-2 * max(1, abs(got[r]))


def test_interactions_are_learnt_that_a_linear_model_cannot():
    rng = random.Random(0)
    texts, labels = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join(["alpha" if a else "beta"] * 3 + ["gamma" if b else "delta"] * 3))
        labels.append(float(a == b))  # neither word alone says anything
    words, stats = [M.hashed_words(t) for t in texts], np.array([M.structure(t, None) for t in texts])
    model = M.fit(words[:1000], stats[:1000], np.array(labels[:1000]), epochs=40)
    assert np.mean((model.score(texts[1000:], [None] * 500) >= 0.5) == np.array(labels[1000:])) > 0.95


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, (sentence(rng, 60) if i % 3 else " ".join(f"{w}!!" for w in sentence(rng, 60).upper().split())), "en", "s", None) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = M.train(docs, labels, max_train=300)
    got = M.score(docs, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 80 and np.mean([(r.score >= 0.3) == (r.doc_id % 3 > 0) for r in held]) > 0.97
    odd = odd_docs(spark)
    scores = M.score(odd, model).collect()
    assert len(scores) == odd.count() and all(0 <= r.score <= 1 for r in scores)
    same = [r.score for r in scores if r.doc_id == 5]
    assert len(same) == 3 and len(set(same)) == 1
    assert M.score(empty_docs(spark), model).count() == 0
    flat = M.train(docs, labels.limit(0))
    assert {round(r.score, 6) for r in M.score(odd, flat).collect()} == {0.5}
