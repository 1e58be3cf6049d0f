"""License scan by conditional compression.

A candidate block is the text around a cue ("licen", "copyright", ...), wide enough for
the longest template. The block is compressed with Zstandard alone and once with each
template as a raw-content dictionary; a template that the block repeats saves many
bytes. Templates are confirmed by wording in the order of the bytes saved, until one
passes: template and block are aligned word by word, and a winner may lack or
change at most ``tolerance`` of its words, none of them a *deciding* word (a number,
version or negation, or one that the template lists). Templates of whose words the
block lacks too many to pass at any place are left out beforehand. The exact wording
differences are part of the result. The text before a confirmed passage is judged
again without it; a passage that begins after the cue is left to the next cue near it.
Further cues inside a confirmed passage are not tried again.

Blocks are bounded by the templates, so memory is, too; equal blocks of a task are
judged once. Texts without any cue are ruled out by substring search.

Defined cases: a null or empty text has no license; repeated rows get equal results;
an empty table gives no rows; other columns are ignored. Spans are code points, end
exclusive.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUES = re.compile(r"licen[sc]|copyright|permission is|redistribution and use|public domain|creative commons|warrant(?:y|ies)|spdx", re.I | re.A)
CUE_WORDS = ("licen", "copyright", "permission is", "redistribution", "public domain", "creative commons", "warrant", "spdx")
WORD = re.compile(r"[A-Za-z0-9]+(?:[.'-][A-Za-z0-9]+)*")
LEVEL = 3

#: Public license wordings by SPDX identifier.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3."],
    "GPL-3.0-or-later": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ],
    "GPL-2.0-or-later": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
        "later version.",
    ],
    "LGPL-2.1-or-later": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version.",
    ],
    "LGPL-3.0-or-later": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version.",
    ],
    "AGPL-3.0-or-later": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version.",
    ],
    "GPL-2.0-only": ["This work is licensed under the GNU General Public License, version 2."],
    "LGPL-3.0-only": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0-only": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
        "Released under the BSD 3-Clause License.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
}
for _name in (*TEMPLATES, "BSD-2-Clause"):
    TEMPLATES.setdefault(_name, []).append(f"SPDX-License-Identifier: {_name}")
#: Words that tell licenses apart: never missing or changed in a winner.
DECIDING = frozenset("""mit apache gnu gpl lesser affero mozilla bsd cc by by-nc by-sa by-nd attribution attribution-sharealike
attribution-noncommercial noncommercial sharealike no not non without either later any free""".split())


def _words(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text)]


def _decides(word: str) -> bool:
    return word in DECIDING or any(c.isdigit() for c in word)


class Scanner:
    """Judges blocks against a set of templates."""

    def __init__(self, templates: dict[str, list[str]], tolerance: float = 0.1):
        self.tolerance = tolerance
        self.names = [(name, wording) for name, all_wordings in templates.items() for wording in all_wordings]
        self.words = [[w for w, _, _ in _words(t)] for _, t in self.names]
        self.bags = [Counter(w) for w in self.words]
        self.radius = max((len(t) for _, t in self.names), default=0) * 5 // 4
        options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.alone = zstandard.ZstdCompressor(**options)
        self.given = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(
            " ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), **options) for w in self.words]
        self.judge = lru_cache(maxsize=20_000)(self._judge)

    def possible(self, said: list[tuple[str, int, int]]) -> list[int]:
        """Templates that may be confirmed: the words that the block lacks are lost wherever it is aligned."""
        have, out = Counter(w for w, _, _ in said), []
        for i, bag in enumerate(self.bags):
            lost = {w: n - have[w] for w, n in bag.items() if n > have[w]}
            if sum(lost.values()) <= self.tolerance * len(self.words[i]) and not any(map(_decides, lost)):
                out.append(i)
        return out

    def ranked(self, said: list[tuple[str, int, int]], among: list[int] | None = None) -> list[tuple[int, int]]:
        """(bytes saved, template) from the largest saving; words alone are compressed, in lower case."""
        raw = " ".join(w for w, _, _ in said).encode()
        plain = len(self.alone.compress(raw))
        saved = [(plain - len(self.given[i].compress(raw)), i) for i in (range(len(self.given)) if among is None else among)]
        return sorted(saved, key=lambda s: (-s[0], -len(self.words[s[1]]), s[1]))

    def confirm(self, template: int, said: list[tuple[str, int, int]]) -> tuple[int, int, list[str]] | None:
        """(start, end, differences) where the block words say the template, or None."""
        want, have = self.words[template], [w for w, _, _ in said]
        matcher = SequenceMatcher(None, want, have, autojunk=False)
        blocks = [b for b in matcher.get_matching_blocks() if b.size]
        if not blocks:
            return None
        # The longest common run anchors the passage; the rest must lie around it.
        core = max(blocks, key=lambda b: b.size)
        lo = max(0, core.b - core.a - 2)
        hi = min(len(have), core.b - core.a + len(want) + 2)
        diffs, changed, first, last = [], 0, None, None
        for op, a1, a2, b1, b2 in SequenceMatcher(None, want, have[lo:hi], autojunk=False).get_opcodes():
            if op == "equal":
                first = b1 if first is None else first
                last = b2
                continue
            lost, new = want[a1:a2], have[lo + b1:lo + b2]
            if op == "insert" and (a1 in (0, len(want))):
                continue  # words before or after the passage
            if any(map(_decides, lost)):
                return None
            inner = new if 0 < a1 and a2 < len(want) else []
            if set(inner) & DECIDING:
                return None
            changed += max(len(lost), len(inner))
            diffs.append(f"{' '.join(lost)}>{' '.join(inner)}")
        if first is None or changed > self.tolerance * len(want):
            return None
        return said[lo + first][1], said[lo + last - 1][2], diffs

    def _judge(self, block: str) -> tuple[str, int, int, int, tuple[str, ...]] | None:
        """(license, start, end, bytes saved, differences) of the best confirmed template."""
        said = _words(block)
        for saved, template in self.ranked(said, self.possible(said)):
            if found := self.confirm(template, said):
                return self.names[template][0], found[0], found[1], saved, tuple(found[2])
        return None

    def scan(self, text: str | None) -> list[dict]:
        if not text or not any(c in text.lower() for c in CUE_WORDS):
            return []
        out, at = [], 0
        cues = list(CUES.finditer(text))
        for i, cue in enumerate(cues):
            later = cues[i + 1].start() if i + 1 < len(cues) else len(text) + self.radius
            while at <= cue.start():
                a, b = max(at, cue.start() - self.radius), min(len(text), cue.end() + self.radius)
                found = self._passages(text, a, b, cue.start(), later - self.radius)
                if not found:
                    break
                out += found
                at = found[-1]["end"]
        return out

    def _passages(self, text: str, a: int, b: int, cue: int, later: int) -> list[dict]:
        """Passages of text[a:b] by place, the best one first cut out; one that begins after
        the cue and from ``later`` on is left to the next cue, whose block holds it whole."""
        found = self.judge(text[a:b])
        if not found:
            return []
        name, start, end, saved, diffs = found
        start, end = a + start, a + end
        out = self._passages(text, a, start, cue, later)
        if start <= cue or start < later:
            out.append({"license": name, "start": start, "end": end, "saved": saved, "differences": list(diffs)})
        return out + self._passages(text, end, b, cue, later) if end <= cue or end < later else out


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, tolerance: float = 0.1,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, matches array<struct<license, start, end, saved, differences>>) of every row."""
    chosen = templates or TEMPLATES

    @F.pandas_udf("array<struct<license:string,start:long,end:long,saved:long,differences:array<string>>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(chosen, tolerance)
        for s in batches:
            yield pd.Series([scanner.scan(t) for t in s], dtype="object")

    return docs.select(id_col, run(F.col(text_col)).alias("matches"))
