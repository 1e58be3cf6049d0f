import hashlib
import random

from pyspark.sql import functions as F

from pricesift.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, part string, segments string, blocks string"


def test_round_trip_of_odd_turns(spark):
    rng = random.Random(2)
    bits = ["<|im_end|>", "<|im_start|>", "<|", "\\", "\\\\", "|>", "\n", "<\\|im_next|>", "a", "é", "\U0001F600", "$1", "", "<"]
    roles = ["user", "assistant", "system", "odd\nrole\\n<|", None, ""]
    rows = []
    for c in range(30):
        for t in range(rng.randrange(1, 9) if c else 300):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(roles[:3]) if c % 2 else rng.choice(roles),
                         rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randrange(12)))]), "x", "y", "z"))
    rows += [(None, 1, "user", "no id", "x", "y", "z"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = chat.format_conversations(df, chunk=16)
    out = out.select("conv_id", chat.formatted_text().alias("f"), chat.loss_text().alias("loss"))
    got = {r.conv_id: r for r in out.withColumn("turns", chat.read_back(F.col("f"))).collect()}
    want = {}
    for c, t, role, text, *_ in rows:
        want.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns = sorted(turns, key=lambda x: (x[0], x[1].encode(), x[2].encode()))
        assert [(x.role, x.text) for x in got[c].turns] == [(r, t) for _, r, t in turns]
        assert got[c].loss == "".join(t for _, r, t in turns if r == "assistant")
        runs = sum(i == 0 or turns[i - 1][1] != turns[i][1] for i in range(len(turns)))
        assert got[c].f.count("<|im_start|>") == runs == got[c].f.count("<|im_end|>\n")


def test_empty_and_long(spark):
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    long = spark.createDataFrame([(1, 0, "assistant", "<|" * 200_000, "", "", "")], SCHEMA)
    r = chat.format_conversations(long).select(F.sha2(chat.loss_text(), 256).alias("h")).first()
    assert r.h == hashlib.sha256(b"<|" * 200_000).hexdigest()
