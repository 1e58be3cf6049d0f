from helpers import empty_docs, odd_docs, sentence
import random

from pricesift.llm import licenses as L


def scan(text):
    return [(m["license"], text[m["start"]:m["end"]], m["differences"]) for m in L.Scanner(L.TEMPLATES).scan(text)]


def test_every_template_is_found_in_prose_with_its_exact_span():
    rng = random.Random(1)
    for name, wordings in L.TEMPLATES.items():
        for t in wordings:
            text = sentence(rng, 80) + "\n" + t + "\n" + sentence(rng, 80)
            got = scan(text)
            assert [g[0] for g in got] == [name], (name, t)
            assert got[0][1].split() == t.rstrip(".:,\")").split() or got[0][1] in t and len(got[0][1]) > 0.9 * len(t) - 5
            assert got[0][2] == []


def test_wording_differences_are_exact_and_deciding_words_decide():
    mit = L.TEMPLATES["MIT"][2]
    changed = mit.replace("deal in the Software", "deal in the Program").replace("furnished", "provided")
    (got,) = scan("x " + changed)
    assert got[0] == "MIT" and got[2] == ["software>program", "furnished>provided"]
    assert scan("Licensed under the Apache License, Version 1.1.") == []
    assert scan("Licensed under CC BY-NC 4.0.")[0][0] == "CC-BY-NC-4.0" and scan("Licensed under CC BY 4.0.")[0][0] == "CC-BY-4.0"
    assert scan("my driving license expired and the copyright is mine") == []
    assert scan(mit.replace("without restriction", "with restriction")) == []


def test_case_junk_and_many_notices():
    assert scan("LICENSED!! UNDER!! THE!! APACHE!! LICENSE,!! VERSION!! 2.0.!!")[0][0] == "Apache-2.0"
    text = "Released under the MIT License. " * 50 + "Licensed under CC BY 4.0."
    assert [g[0] for g in scan(text)] == ["MIT"] * 50 + ["CC-BY-4.0"]


def test_short_notices_are_found_whatever_long_templates_save():
    """The short wordings between legal prose, of whose bytes long templates save more."""
    rng = random.Random(3)
    legal = [w for i in (2, 0) for t in ("GPL-3.0-or-later", "ISC", "MIT", "BSD-3-Clause") for w in L.TEMPLATES[t][i if t == "MIT" else 0].split()]
    for name, wordings in L.TEMPLATES.items():
        for t in (t for t in wordings if len(t) < 60):
            for _ in range(10):
                around = [" ".join(rng.choice(["the", "of", "to", "and", *legal[:90]]) for _ in range(90)) for _ in range(2)]
                got = scan(f"{around[0]} zebra. {t} Zebra {around[1]}")
                assert (name, t.rstrip(".")) in [g[:2] for g in got], (name, t, around)


def test_neighbouring_notices_are_all_found_in_any_order():
    short = [(n, t) for n, all_wordings in L.TEMPLATES.items() for t in all_wordings]
    for n1, t1 in short:
        for n2, t2 in short:
            text = f"{t1} Parts are {t2}"
            assert [g[0] for g in scan(text)] == [n1, n2], text
    assert [g[0] for g in scan("Licensed under CC BY 4.0. Released under the MIT License.")] == ["CC-BY-4.0", "MIT"]
    # templates without any cue word, before and after a cue
    own = L.Scanner({"A": ["alpha beta gamma delta"], "B": ["one two three four five six seven eight"], "wide": ["zulu " * 40]})
    for text in ("alpha beta gamma delta license one two three four five six seven eight", "license one two three four five six seven eight alpha beta gamma delta",
                 "license license alpha beta gamma delta one two three four five six seven eight license", "license alpha beta gamma delta " + "x " * 500 + "license"):
        assert sorted(m["license"] for m in own.scan(text)) == ["A", "B"][:1 + ("one" in text)], text


def test_spdx_tags_and_or_later_notices():
    for name in ("MIT", "Apache-2.0", "GPL-2.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-SA-4.0"):
        assert scan(f"# SPDX-License-Identifier: {name}\nimport os") == [(name, f"SPDX-License-Identifier: {name}", [])]
    assert scan("SPDX-License-Identifier: GPL-2.0-without") == []
    later = ("This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as "
             "published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version.")
    for what, kind, version, name in (("program", "", "2", "GPL-2.0-or-later"), ("program", "", "3", "GPL-3.0-or-later"),
                                      ("library", "Lesser ", "2.1", "LGPL-2.1-or-later"), ("library", "Lesser ", "3", "LGPL-3.0-or-later"),
                                      ("program", "Affero ", "3", "AGPL-3.0-or-later")):
        assert [g[0] for g in scan(later.format(what, kind, version))] == [name]
    assert scan(later.format("program", "", "1")) == []


def test_template_saves_more_bytes_than_others():
    s = L.Scanner(L.TEMPLATES)
    said = L._words("foo bar " + L.TEMPLATES["ISC"][0] + " baz")
    saved, best = s.ranked(said)[0]
    assert s.names[best][0] == "ISC" and saved > 50


def test_odd_rows(spark):
    docs = odd_docs(spark, texts=[None, "", "Released under the MIT License.", "license " * 3000, "x" * 200_000, "copyright"])
    out = L.scan_licenses(docs)
    rows = out.collect()
    assert len(rows) == docs.count()
    assert {r.doc_id: [m.license for m in r.matches] for r in rows if r.doc_id is not None} == {0: [], 1: [], 2: ["MIT"], 3: [], 4: [], 5: []}
    assert L.scan_licenses(empty_docs(spark)).count() == 0
