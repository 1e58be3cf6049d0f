"""The pipeline and the registration, on a small fixture held against plain versions of every stage."""
import os
import subprocess
import sys
from collections import defaultdict

import numpy as np
from helpers import odd_texts, sentence
from test_decontaminate import plain as plain_contamination
from test_packing import whole
from test_quality_rules import plain_measure
from test_secret_scan import plain_base
from test_simhash import plain_components, plain_fingerprint
import random

import corpus_pipeline
from pricesift.llm import secret_scan

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def fixture(spark, folder, empty=False):
    rng = random.Random(9)
    passage = sentence(rng, 30, 500)
    texts = odd_texts() + [sentence(rng, 40, 9000) + " token = 04dbebab91ab85687d33eeaaf9ac699e1188f962 " + sentence(rng, 40, 9000),
                           sentence(rng, 50, 9000) + " " + passage + " " + sentence(rng, 50, 9000),
                           sentence(rng, 900, 9000) + " " + passage, sentence(rng, 200, 9000)]
    texts.append(texts[-1].replace(texts[-1].split()[100], "other", 1))
    rows = [(i, t, "en", "s0", len(t) if t else None, "extra") for i, t in enumerate(texts)]
    rows += [(None, texts[-2], "fr", None, None, "x"), rows[5], rows[5]]
    docs = spark.createDataFrame([] if empty else rows, "doc_id long, text string, lang string, source string, n_chars long, fp string")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(5)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, [(1, passage)]


def plain_pipeline(rows, items):
    good = [r for r in rows if (m := plain_measure(r[1]))[0] >= 10 and 100 * m[5] <= 20 * m[0]]
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    fps = [signed(plain_fingerprint(r[1])) for r in good]
    roots = plain_components(fps, 4)
    groups = defaultdict(list)
    for r, f in zip(good, fps, strict=True):
        groups[roots[f]].append(r)
    one = [min(g, key=lambda r: (r[0] is None, r[0])) for g in groups.values()]
    clean = [r for r in one if not ((n := plain_contamination(r[1], items))[1] > 0 and 20 * n[1] >= n[0])]
    return {r[0]: secret_scan.masked(r[1], secret_scan.scan(r[1]), "[SECRET]") for r in clean}


def test_pipeline_equals_plain_stages(spark, tmp_path):
    rows, items = fixture(spark, tmp_path)
    want = plain_pipeline(rows, items)
    got = defaultdict(dict)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id][r.start] = r.ids
    assert set(got) == set(want) and len(want) >= 5
    for doc, pieces in got.items():
        assert np.concatenate([pieces[s] for s in sorted(pieces)]).tolist() == whole(want[doc])
    assert any("[SECRET]" in t for t in want.values()) and not any(plain_base(t) for t in want.values())


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    fixture(spark, tmp_path, empty=True)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registration():
    import __spark_entry__ as e
    names = {*e.queries()}
    assert {f"op{n}_" for n in range(1, 14)} <= {x.split("_")[0] + "_" for x in names} and "pipeline" in names
    assert len(corpus_pipeline.STAGES) == 5
    code = ("import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; "
            "assert e.queries() and not [q for q in e.queries() if q.startswith('op1') or q == 'pipeline']")
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0
