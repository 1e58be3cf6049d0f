"""Quality classifier: a factorisation machine on hashed words and structure statistics.

    y(x) = w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

The pairwise interactions of all features cost time linear in the features by the
sum-of-squares identity. Features are the distinct words of a text (hashed into
``2**BITS`` places, term counts of unit length), standardised structure ratios, and the
``n_chars`` column as metadata; labels, language, source and id are never features.

The model is fitted by Adam on the logistic loss over at most ``max_train`` labelled
rows (a documented bound; the rows with the smallest id hashes), gathered as feature
arrays of at most ``2**BITS`` entries each. Scoring is an Arrow function over all
documents, without a shuffle.

Defined cases: a null or empty text has structure features only (and so the score of
an empty text); null ``n_chars`` is the text's length; null labels are ignored, a
document labelled more than once counts as 0 if any label is 0; repeated rows get equal scores; without both
classes among the labels every score is the smoothed share of label 1; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import measure

BITS, FACTORS = 14, 8
DIGITS, MARKS = b"0123456789", b".,;:?\"'()-"


def structure(text: str | None, n_chars: float | None) -> list[float]:
    """Structure statistics and metadata of one text."""
    n_words, chars, symbols, lines, dup_lines, repeats, capitals, bangs, echoes = measure(text)
    raw = (text or "").encode("utf-8", "surrogatepass")
    known = len(text or "") if n_chars is None or n_chars != n_chars else max(0.0, n_chars)
    per_char, per_word = 1 / max(chars, 1), 1 / max(n_words, 1)
    some = lambda marks: len(raw) - len(raw.translate(None, marks))
    return [np.log1p(n_words), np.log1p(known), np.log1p(lines), chars * per_word, symbols * per_char,
            dup_lines / max(lines, 1), repeats * per_word, capitals * per_char, bangs * per_word, echoes * per_word,
            some(DIGITS) * per_char, some(MARKS) * per_char, raw.count(b"|") * per_word, float(n_words == 0)]


N_STRUCTURE = len(structure("", 0))


def hashed_words(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a text's distinct words; words that share a place stay apart."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    counts = Counter(words)
    places = np.fromiter((xxhash.xxh32_intdigest(w) for w in counts), np.int64, len(counts)) & ((1 << BITS) - 1)
    values = np.fromiter(counts.values(), np.float32, len(counts))
    return places, values / max(np.sqrt(values @ values), 1.0)


@dataclass
class Model:
    w0: float
    w: np.ndarray  # words, then structure statistics
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def rows(self, words: list[tuple[np.ndarray, np.ndarray]], stats: np.ndarray):
        """Flat (place, value, row starts); each row ends with its standardised statistics."""
        z = np.clip((stats - self.mean) / self.scale, -5, 5).astype(np.float32) / np.float32(np.sqrt(N_STRUCTURE))
        own = np.arange(1 << BITS, (1 << BITS) + N_STRUCTURE)
        place = np.concatenate([x for p, _ in words for x in (p, own)])
        value = np.concatenate([x for (_, v), s in zip(words, z, strict=True) for x in (v, s)]).astype(np.float32)
        sizes = np.array([len(p) + N_STRUCTURE for p, _ in words])
        return place, value, np.concatenate(([0], np.cumsum(sizes)))

    def raw(self, place: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vx = self.v[place] * value[:, None]
        total = np.add.reduceat(vx, starts[:-1])
        squares = np.add.reduceat(np.einsum("ij,ij->i", vx, vx), starts[:-1])
        linear = np.add.reduceat(self.w[place] * value, starts[:-1])
        return self.w0 + linear + 0.5 * ((total * total).sum(axis=1) - squares), total

    def score(self, texts: list[str | None], n_chars: list[float | None]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        y, _ = self.raw(*self.rows([hashed_words(t) for t in texts], np.array([structure(*x) for x in zip(texts, n_chars, strict=True)])))
        return 1 / (1 + np.exp(-y.astype(np.float64)))


def fit(words: list[tuple[np.ndarray, np.ndarray]], stats: np.ndarray, labels: np.ndarray,
        epochs: int = 20, batch: int = 128, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Model:
    """Adam on the logistic loss; one pass costs time linear in the features."""
    rng, size = np.random.default_rng(seed), (1 << BITS) + N_STRUCTURE
    share = (labels.sum() + 1) / (len(labels) + 2)
    model = Model(float(np.log(share / (1 - share))), np.zeros(size, np.float32),
                  np.zeros((size, FACTORS), np.float32), np.zeros(N_STRUCTURE), np.ones(N_STRUCTURE))
    if len(np.unique(labels)) < 2:
        return model
    model.v = rng.normal(0, 0.05, (size, FACTORS)).astype(np.float32)
    model.mean, model.scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-3)
    moments = [np.zeros((size, FACTORS + 1), np.float32), np.zeros((size, FACTORS + 1), np.float32)]
    bias = [0.0, 0.0]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            pick = order[at:at + batch]
            place, value, starts = model.rows([words[i] for i in pick], stats[pick])
            y, total = model.raw(place, value, starts)
            g = ((1 / (1 + np.exp(-y)) - labels[pick]) / len(pick)).astype(np.float32)
            row = np.repeat(np.arange(len(pick)), np.diff(starts))
            gx = g[row] * value
            gv = gx[:, None] * (total[row] - model.v[place] * value[:, None])
            grad = np.stack([np.bincount(place, x, size) for x in (gx, *gv.T)], axis=1).astype(np.float32)
            grad[:, 0] += decay * model.w
            grad[:, 1:] += decay * model.v
            step += 1
            now = rate * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            moments[0] = 0.9 * moments[0] + 0.1 * grad
            moments[1] = 0.999 * moments[1] + 0.001 * grad * grad
            move = now * moments[0] / (np.sqrt(moments[1]) + 1e-8)
            model.w -= move[:, 0]
            model.v -= move[:, 1:]
            gb = float(g.sum())
            bias = [0.9 * bias[0] + 0.1 * gb, 0.999 * bias[1] + 0.001 * gb * gb]
            model.w0 -= now * bias[0] / (np.sqrt(bias[1]) + 1e-8)
    return model


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """The fold that is never learnt from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def train(docs: DataFrame, labels: DataFrame, max_train: int = 4000, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on at most ``max_train`` labelled rows outside the held-out fold."""
    marks = (labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
             .groupBy(F.col("doc_id").alias("_ps_id")).agg(F.min(label_col).alias("_ps_label"))
             .orderBy(F.xxhash64("_ps_id"), "_ps_id").limit(max_train))
    length = F.col("n_chars") if "n_chars" in docs.columns else F.char_length(text_col)

    @F.pandas_udf("places array<int>, word_values array<float>, stats array<double>")
    def features(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, sizes in batches:
            words = [hashed_words(t) for t in texts]
            yield pd.DataFrame({"places": [p.tolist() for p, _ in words], "word_values": [v.tolist() for _, v in words],
                                "stats": [structure(t, n) for t, n in zip(texts, sizes, strict=True)]})

    # The marks are bounded by max_train, so sending them to every task is safe.
    sample = (docs.select(F.col(id_col).alias("_ps_id"), F.col(text_col).alias("_ps_text"), length.cast("double").alias("_ps_chars"))
              .join(F.broadcast(marks), "_ps_id").dropDuplicates(["_ps_id"])
              .select("_ps_id", F.col("_ps_label").cast("double").alias("label"), features("_ps_text", "_ps_chars").alias("f"))
              .select("_ps_id", "label", "f.*").orderBy(F.xxhash64("_ps_id"), "_ps_id").toPandas())
    words = [(np.asarray(p, np.int64), np.asarray(v, np.float32)) for p, v in zip(sample["places"], sample["word_values"], strict=True)]
    stats = np.array(sample["stats"].tolist(), float).reshape(len(sample), N_STRUCTURE)
    return fit(words, stats, sample["label"].to_numpy(float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score) of every row."""
    length = F.col("n_chars") if "n_chars" in docs.columns else F.char_length(text_col)

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, sizes in batches:
            parts = [model.score(list(texts[i:i + 500]), list(sizes[i:i + 500])) for i in range(0, len(texts), 500)]
            yield pd.Series(np.concatenate(parts) if parts else np.empty(0))

    return docs.select(id_col, held_out(id_col).alias("held_out"), run(F.col(text_col), length.cast("double")).alias("score"))
