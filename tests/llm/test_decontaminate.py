import random
import re

from helpers import empty_docs, odd_docs, sentence

from pricesift.llm import decontaminate


def words(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(text, items, window=13):
    w, hit, names = words(text), set(), set()
    for name, item in items:
        v = words(item)
        for s in range(max(1, len(v) - window + 1) if v else 0):
            win = v[s:s + window]
            for p in range(len(w) - len(win) + 1):
                if w[p:p + len(win)] == win:
                    hit.update(range(p, p + len(win)))
                    names.add("" if name is None else str(name))
    return len(w), len(hit), sorted(names)


def held_against_plain(docs, bench, **options):
    items = [(r.item_id, r.text) for r in bench.collect()]
    rows = decontaminate.find(docs, bench, **options).collect()
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_hit, r["items"]) for r in rows)
    want = sorted((r.doc_id is not None, r.doc_id or 0, *plain(r.text, items)) for r in docs.collect())
    assert got == want


def test_random_items_in_blocks(spark):
    rng = random.Random(4)
    items = [sentence(rng, n, 50) for n in (1, 2, 5, 12, 13, 14, 40)] + ["İstanbul K ſ Été", None, "", "!!!"]
    texts = []
    for _ in range(40):
        body = sentence(rng, 30, 50).split()
        at = rng.randrange(len(body))
        item = rng.choice(items[:8]).split()
        texts.append(" ".join(body[:at] + item[rng.randrange(3):] + body[at:]).upper() if rng.random() < 0.3
                     else ", ".join(body[:at] + item + body[at:]))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(None, items[5]), (3, items[3])], "item_id long, text string")
    held_against_plain(docs, bench)
    held_against_plain(docs, bench, block_windows=7, block_words=9)


def test_odd_rows(spark):
    rng = random.Random(3)
    docs = odd_docs(spark)
    held = docs.collect()[0]
    passage = next(r.text for r in docs.collect() if r.doc_id == 8)
    bench = spark.createDataFrame([(1, " ".join(passage.split()[:20])), (2, "one"), (3, None)], "item_id long, text string")
    held_against_plain(docs, bench)
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and held is not None and rng
    ids = [r.doc_id for r in kept.collect()]
    assert 8 not in ids and 3 not in ids and ids.count(5) == 3 and ids.count(None) == 2
    none = bench.limit(0)
    assert decontaminate.drop_contaminated(docs, none).count() == docs.count()
    assert decontaminate.find(empty_docs(spark), bench).count() == 0
