"""Fixtures for the corpus operators: odd rows and plain reference versions."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns named like the operators' own.
CLASHES = ["count", "key", "fp", "root", "a", "b", "k1", "k2", "gram", "start", "pos", "words", "said", "token", "spans",
           "stratum", "counts", "levels", "quality", "label", "score", "tier", "ids", "copies", "matches", "found", "refers_to"]


def word_list(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_texts(seed=3):
    rng = random.Random(seed)
    base, shared = sentence(rng, 120), sentence(rng, 50)
    near = base.split()
    near[60] = "changed"
    return [None, "", "   \n\t ", "one", "two words", base, base, " ".join(near), sentence(rng, 60) + " " + shared,
            shared + " " + sentence(rng, 70), "élan été vital Ünïcode x \U0001F600 end", "same " * 80,
            "line a\nline a\n\nline b\nline a", sentence(rng, 20_000), "x" * 300_000, "É" * 1000, "a\x00b c\x0bd\x0ce\rf"]


def odd_docs(spark, clash=True, texts=None):
    rows = [(i, t, ["en", "fr", None][i % 3], f"s{i % 2}", len(t) if t else None) for i, t in enumerate(texts or odd_texts())]
    rows += [(None, "no id here at all", "en", None, 3), (None, None, None, None, None), rows[5], rows[5], rows[0]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if clash:
        for name in CLASHES:
            df = df.withColumn(name, __import__("pyspark.sql.functions", fromlist=["lit"]).lit("extra"))
    return df


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((x is not None, x) for x in row)
