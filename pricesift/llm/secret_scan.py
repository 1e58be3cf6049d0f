"""Secret scan: base patterns plus a guess-cost estimate of credential-context values.

Base spans (whole matches, code points, end exclusive) come from three patterns.
The method adds values that stand in a credential context (``pwd: x``, ``Bearer x``,
``scheme://user:x@host`` and the like) when they would be expensive to guess: a
dynamic programme finds the cheapest segmentation of the value into known words,
dates, repeats, keyboard walks and brute-force spans, in bits, and the value is a
secret from ``min_bits`` on. Words are ranked by a public vocabulary of some 30,000 whole
words, so prose after a key word ("the token: description of ...") is cheap. So ``password is hunter`` stays, a random value goes. A
value that lies wholly in a base span is held already; one that sticks out is judged.

Values are handled in one left-to-right pass whatever their length: a word, date or
walk is found from its first character, a repeat from its unit of at most
``REPEAT_UNIT`` characters. Texts without any key word are ruled out by substring
search before a pattern runs.

Defined cases: a null text is empty and has no spans; repeated rows get equal
results; an empty table gives no rows; other columns are kept by ``redact``, which
replaces each run of overlapping spans and updates ``n_chars`` where there is one.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from datetime import date
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["assign", "access", "hex", "guess"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 12, 18, 16
ASSIGN_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Credential contexts beyond the base pattern; the group that matched is the value, up to
#: white space or the closing quote. Keys are ASCII, values are any text.
CONTEXTS = [
    re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|(?:api|access|private|client|auth)[_-]?(?:key|secret|token))"""
               r"""["']?\x20*(?:[:=]|=>|\x20is\x20)\x20*"""
               r"""(?:"(?=(?u:[^\s"]{8}|[^\s"]*\\"))((?u:\\\S|[^\s"\\])+)|'(?=(?u:[^\s']{8}|[^\s']*\\'))((?u:\\\S|[^\s'\\])+)|((?u:[^\s"']\S{7,})))""", re.I | re.A),
    re.compile(r"\b(?:bearer|basic)\x20+([A-Za-z0-9+/_.=~-]{8,})", re.I | re.A),
    re.compile(r"[a-z][a-z0-9+.-]{1,15}://(?u:[^\s:/@]*):((?u:[^\s/@]{8,}))@", re.I | re.A),
]
CONTEXT_KEYS = ("pass", "pwd", "secret", "token", "credential", "key", "bearer", "basic", "://")
TRAILING = "\"'`,;.)]}>!?”’»…。"

#: Words that guessers try first, most common first.
COMMON = """password qwerty admin welcome login master dragon monkey letmein football baseball shadow sunshine princess
iloveyou trustno superman batman michael jordan hunter ranger george thomas robert daniel andrew charlie jessica ashley
nicole matthew joshua amanda summer winter spring autumn january february march april june july august september october
november december monday tuesday wednesday thursday friday saturday sunday secret token access private public client server
database default changeme example sample test testing user guest root system manager service account company internet
computer network security temp demo hello world love money happy freedom whatever flower cookie banana orange apple cheese
chicken pepper ginger tigger soccer hockey killer silver golden diamond purple yellow green black white blue the and this
that your from with have""".split()
KEYBOARD = ["1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./"]
LEET = str.maketrans("4@8301!5$7+", "aabeoiisstt")
REPEAT_UNIT = 8
JOIN_BITS = 1.0
DATE = re.compile(r"(\d{1,2})([-/._ ]?)(\d{1,2})\2(\d{4}|\d{2})|(\d{4})([-/._ ]?)(\d{1,2})\6(\d{1,2})")
YEAR = re.compile(r"(?:19|20)\d\d")


def _neighbours() -> set[str]:
    pairs = set()
    for row, keys in enumerate(KEYBOARD):
        for i, k in enumerate(keys):
            near = [keys[i - 1] if i else "", keys[i + 1] if i + 1 < len(keys) else ""]
            if row + 1 < len(KEYBOARD):
                below = KEYBOARD[row + 1]
                near += [below[j] for j in (i - 1, i) if 0 <= j < len(below)]
            pairs |= {k + n for n in near if n} | {n + k for n in near if n}
    return pairs


ADJACENT = _neighbours()


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@cache
def word_ranks(vocabulary: str | None = None) -> tuple[dict[str, int], int]:
    """Ranks of words and the longest length: the fixed ones, then the whole words of a public
    vocabulary (some 30,000), whose ids follow the frequency of their making."""
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    whole = (t.removesuffix("</w>") for t in sorted(ids, key=ids.get) if t.endswith("</w>"))
    words = dict.fromkeys([*COMMON, *(w for w in whole if len(w) >= 3 and w.isascii() and w.isalpha())])
    return {w: i + 1 for i, w in enumerate(words)}, max(map(len, words))


def _char_bits(value: str) -> float:
    """Bits of one brute-forced character, by the alphabets that the value uses."""
    size = (10 * any(c.isdigit() for c in value) + 26 * any("a" <= c <= "z" for c in value)
            + 26 * any("A" <= c <= "Z" for c in value) + 33 * any(not c.isalnum() for c in value)
            + 100 * any(c.isalnum() and not c.isascii() for c in value))
    return math.log2(max(size, 10))


def _segments(value: str, brute: float) -> list[list[tuple[int, float]]]:
    """For each start: (end, bits) of words, dates, repeats and walks that begin there."""
    low = "".join(x if len(x := c.lower()) == 1 else c for c in value)  # place by place
    plain = low.translate(LEET)
    out: list[list[tuple[int, float]]] = [[] for _ in value]
    n, walk = len(value), 0
    ranks, longest = word_ranks()
    for i in range(n):
        for j in range(i + 3, min(n, i + longest) + 1):
            for text, extra in ((low[i:j], 0.0), (plain[i:j], 1.0)):
                if text in ranks:
                    cased = 0.0 if value[i:j] == low[i:j] else 1.0
                    out[i].append((j, math.log2(ranks[text]) + extra + cased))
                    break
        if value[i].isdigit():
            if (m := DATE.match(value, i)) and _is_date(m):
                out[i].append((m.end(), math.log2(365 * 120) + (2.0 if m[2] or m[6] else 0.0)))
            if m := YEAR.match(value, i):
                out[i].append((m.end(), math.log2(200)))
        if i == walk:  # the longest walk from here; a later walk starts where it ends
            j = i + 1
            while j < n and (low[j - 1:j + 1] in ADJACENT or abs(ord(low[j]) - ord(low[j - 1])) == 1):
                j += 1
            if j - i >= 3:
                out[i].append((j, math.log2(95 * 8) + math.log2(j - i)))
            walk = j
        for unit in range(1, REPEAT_UNIT + 1):
            if value[i:i + unit] != value[i + unit:i + 2 * unit] or i + 2 * unit > n:
                continue
            if i >= unit and value[i - unit:i] == value[i:i + unit]:
                continue  # inside a repeat that began earlier
            j = i + 2 * unit
            while value[j:j + unit] == value[i:i + unit]:
                j += unit
            if j - i >= 3:
                out[i].append((j, unit * brute + math.log2((j - i) / unit)))
    return out


def _is_date(m: re.Match) -> bool:
    d, mo, y = (m[1], m[3], m[4]) if m[1] else (m[8], m[7], m[5])
    year = int(y) if len(y) == 4 else 2000 + int(y)
    for day, month in ((int(d), int(mo)), (int(mo), int(d))):
        try:
            return 1900 <= date(year, month, day).year <= 2050
        except ValueError:
            pass
    return False


def guess_bits(value: str) -> float:
    """Bits of the cheapest segmentation; each segment after the first adds ``JOIN_BITS``."""
    if not value:
        return 0.0
    brute = _char_bits(value)
    segments = _segments(value, brute)
    best = [math.inf] * (len(value) + 1)  # cheapest way to have guessed this many characters
    best[0] = 0.0
    run = math.inf  # the same, while inside a brute-force span
    for i in range(len(value)):
        base = best[i] + (JOIN_BITS if i else 0.0)
        run = min(run, base) + brute
        best[i + 1] = min(best[i + 1], run)
        for end, bits in segments[i]:
            best[end] = min(best[end], base + bits)
    return best[-1]


def base_spans(text: str, low: str) -> list[tuple[int, int, str]]:
    out = []
    if any(k in low for k in ASSIGN_KEYS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    if _HEX_RUN in text.encode("utf-8", "surrogatepass").translate(_HEX_MAP):
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= HEX_MIN]
    return out


_HEX_MAP = bytes(ord("x") if chr(c) in "0123456789abcdef" else ord(" ") for c in range(256))
_HEX_RUN = b"x" * HEX_MIN


def scan(text: str | None, min_bits: float = 40.0) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every span, by start and then kind."""
    if not text:
        return []
    low = text.lower()
    spans = base_spans(text, low)
    if any(k in low for k in CONTEXT_KEYS):
        held = sorted((a, b) for a, b, _ in spans)
        added = set()
        for pattern in CONTEXTS:
            for m in pattern.finditer(text):
                value = m[m.lastindex].rstrip(TRAILING)
                a, b = m.start(m.lastindex), m.start(m.lastindex) + len(value)
                if len(value) >= 8 and not any(x <= a and b <= y for x, y in held) and guess_bits(value) >= min_bits:
                    added.add((a, b, "guess"))
        spans += added
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def spans_column(text_col: str, min_bits: float = 40.0) -> Column:
    """array<struct<kind, start, end>> of a text column."""
    @F.pandas_udf("array<struct<kind:string,start:long,end:long>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([[{"kind": k, "start": a, "end": b} for a, b, k in scan(t, min_bits)] for t in s], dtype="object")

    return run(F.col(text_col))


def masked(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    """The text with every run of overlapping spans replaced once."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", mark: str = "[SECRET]",
           min_bits: float = 40.0) -> DataFrame:
    """``docs`` with secrets replaced by ``mark``; texts without any stay as they are."""
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([masked(t, x, mark) if t and (x := scan(t, min_bits)) else t for t in s], dtype="object")

    new = docs.withColumn("_ps_new", run(F.col(text_col)))
    if length_col in docs.columns:
        new = new.withColumn(length_col, F.when(F.col("_ps_new") == F.col(text_col), F.col(length_col))
                             .when(F.col("_ps_new").isNull(), F.col(length_col))
                             .otherwise(F.char_length("_ps_new").cast(docs.schema[length_col].dataType)))
    return new.withColumn(text_col, F.col("_ps_new")).select(*docs.columns)
