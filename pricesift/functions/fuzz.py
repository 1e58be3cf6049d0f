"""Indel-based string ratios over whole batches of pairs.

``ratio = round(100 * 2 * LCS / (len a + len b))`` with half-even rounding; equal
strings score 100, an empty side scores 0. All pairs of a batch advance together:
strings become padded code arrays, and the bit-parallel LCS keeps one or more
64-bit words per pair, so one numpy operation moves every pair one character on.
Token parts are native Spark columns (``functions.text``); the scalar forms below
serve tests and single values.
"""

from __future__ import annotations

import copy
import re

import numpy as np

_CHUNK = 4096  # pairs that advance together
_WINDOWS = 1 << 16  # substring windows compared at once
_MASKS = 1 << 23  # places of a table of character masks at most


def _lcs_codes(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """LCS lengths of padded code arrays; the pads of both sides never match."""
    n, words = len(a), max(1, -(-a.shape[1] // 64))
    kind = np.uint8 if max(a.max(initial=0), b.max(initial=0)) < 254 else np.uint32  # narrow codes compare faster
    top = np.iinfo(kind).max
    wide = np.full((n, 64 * words), top, kind)
    wide[:, :a.shape[1]] = np.where(np.arange(a.shape[1]) < la[:, None], a, top)
    steps = np.where(np.arange(b.shape[1]) < lb[:, None], b, top - 1).astype(kind).T.copy()
    free = np.full((n, words), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for j in range(int(lb.max(initial=0))):
        same = np.packbits(wide == steps[j][:, None], axis=1, bitorder="little").view("<u8")
        taken = free & same
        if words == 1:
            grown = free + taken
        else:
            grown, carry = np.empty_like(free), np.zeros(n, np.uint64)
            for w in range(words):
                part = free[:, w] + taken[:, w]
                grown[:, w] = part + carry
                carry = ((part < free[:, w]) | (grown[:, w] < part)).astype(np.uint64)
        free = grown | (free & ~same)
    return np.bitwise_count(~free).sum(axis=1).astype(np.int64)


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    width = max(1, int(lengths.max(initial=0)))
    return np.array(strings, dtype=f"U{width}").view(np.uint32).reshape(len(strings), width), lengths


def _by_length(a: list[str], b: list[str]):
    """Index chunks of pairs of like size, so one long string pads few others."""
    order = np.argsort(np.fromiter((max(len(x), len(y)) for x, y in zip(a, b, strict=True)), np.int64, len(a)), kind="stable")
    for at in range(0, len(order), _CHUNK):
        yield order[at:at + _CHUNK]


def lcs_lens(a: list[str], b: list[str]) -> np.ndarray:
    out = np.zeros(len(a), np.int64)
    for pick in _by_length(a, b):
        (x, lx), (y, ly) = _codes([a[i] for i in pick]), _codes([b[i] for i in pick])
        out[pick] = _lcs_codes(x, lx, y, ly) if x.shape[1] >= y.shape[1] else _lcs_codes(y, ly, x, lx)
    return out


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """0..100 per pair."""
    total = np.fromiter((len(x) + len(y) for x, y in zip(a, b, strict=True)), np.int64, len(a))
    raw = 2.0 * lcs_lens(a, b) / np.maximum(total, 1)
    return np.where(total == 0, 100.0, np.rint(100 * raw))


def partial_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """Best ratio of the shorter string against every window of its length in the longer one."""
    out = np.zeros(len(a))
    for pick in _by_length(a, b):
        pairs = [(a[i], b[i]) if len(a[i]) <= len(b[i]) else (b[i], a[i]) for i in pick]
        (short, ls), (long, ll) = _codes([s for s, _ in pairs]), _codes([t for _, t in pairs])
        best = np.zeros(len(pick))
        counts = np.where(ls > 0, ll - ls + 1, 0)
        groups = np.concatenate(([0], np.cumsum(counts)))
        for lo in range(0, int(groups[-1]), _WINDOWS):
            at = np.arange(lo, min(lo + _WINDOWS, int(groups[-1])))
            pair = np.searchsorted(groups, at, side="right") - 1
            start = at - groups[pair]
            take = np.minimum(start[:, None] + np.arange(short.shape[1]), long.shape[1] - 1)
            n = _lcs_codes(short[pair], ls[pair], long[pair[:, None], take], ls[pair])
            np.maximum.at(best, pair, 2.0 * n / (2 * ls[pair]))
        score = np.where(best > 0.995, 100.0, np.rint(100 * best))
        out[pick] = np.where((ls == 0) & (ll == 0), 100.0, score)
    return out


def blend(ts: np.ndarray, tset: np.ndarray, part: np.ndarray) -> np.ndarray:
    """F6 weights: 0.4 token-sort + 0.4 token-set + 0.2 partial."""
    return (ts * 0.4 + tset * 0.4 + part * 0.2) / 100.0


def similarity_batch(clean: tuple[list, list], sort: tuple[list, list], sect: list, c1: list, c2: list,
                     floor: float | None = None) -> np.ndarray:
    """F6 of a batch from its token parts.

    With ``floor``, pairs that cannot exceed it any more drop out before the next
    ratio is computed and get 0: first on the token-sort ratio, then with token-set.
    """
    n = len(sect)
    ts, tset, part = ratios(*sort), np.full(n, 100.0), np.full(n, 100.0)

    def alive() -> np.ndarray:
        return np.arange(n) if floor is None else np.flatnonzero(blend(ts, tset, part) > floor)

    at = alive()
    pick = lambda x, i: [x[k] for k in i]
    s, x, y = pick(sect, at), pick(c1, at), pick(c2, at)
    lead = [np.fromiter(map(len, t), np.int64, len(at)) for t in (s, x, y)]  # the shared words lead both sides
    best = np.maximum(np.maximum(*(_percent(lead[0], lead[0] + n) for n in lead[1:])), ratios(x, y))
    tset[at] = np.where([bool(p) and bool(q) for p, q in zip(x, y, strict=True)], best, 0.0) if len(at) else best
    gone = np.ones(n, bool)
    at = np.intersect1d(at, alive())
    gone[at] = False
    part[at] = partial_ratios(pick(clean[0], at), pick(clean[1], at))
    return np.where(gone, 0.0, blend(ts, tset, part))


# --- one table of names, many pairs of it -------------------------------------------------
class Names:
    """Code arrays of names from their F6 parts (``functions.text.name_parts``), made once for all pairs that they form.

    A token set is kept as one string, each of its tokens behind a space, with the token of every character.
    """

    def __init__(self, clean: list[str], key: list[str], tokens: list[list[str]]):
        self.strings = clean
        self.clean, self.n_clean = self._narrow(clean)
        self.key, self.n_key = self._narrow(key)
        self.set, self.n_set = self._narrow(["".join(f" {t}" for t in ts) for ts in tokens])
        ids: dict[str, int] = {}
        width = max(1, max(map(len, tokens), default=1))
        self.token = np.full((len(tokens), width), -1, np.int32)
        self.weight = np.zeros((len(tokens), width), np.int32)
        self.owner = np.zeros(self.set.shape, np.int16)  # the token of a character
        for i, ts in enumerate(tokens):
            sizes = [len(t) + 1 for t in ts]
            self.token[i, :len(ts)] = [ids.setdefault(t, len(ids)) for t in ts]
            self.weight[i, :len(ts)] = sizes
            self.owner[i, :sum(sizes)] = np.repeat(np.arange(len(ts)), sizes)
        self.marks_clean, self.marks_key = _Marks(self.clean, self.n_clean), _Marks(self.key, self.n_key)
        self.marks_set = _Marks(self.set, self.n_set)
        bits = np.uint64(1) << np.arange(min(self.set.shape[1], 64), dtype=np.uint64)
        self.token_bits = np.zeros(self.token.shape, np.uint64)  # where a token stands in a set of up to 64 characters
        if self.marks_set.masks is not None:
            row, place = np.nonzero(np.arange(self.set.shape[1]) < self.n_set[:, None])
            np.bitwise_or.at(self.token_bits, (row, self.owner[row, place]), bits[place])
        self.longest = np.maximum(np.maximum(self.n_clean, self.n_key), self.n_set)

    def only(self, picked: np.ndarray) -> Names:
        """The names of the given row numbers."""
        out = copy.copy(self)
        out.strings = [self.strings[i] for i in picked]
        for c in ("clean", "n_clean", "key", "n_key", "set", "n_set", "token", "token_bits", "weight", "owner", "longest"):
            setattr(out, c, getattr(self, c)[picked])
        out.marks_clean, out.marks_key, out.marks_set = (m.only(picked) for m in (self.marks_clean, self.marks_key, self.marks_set))
        return out

    @staticmethod
    def _narrow(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes, lengths = _codes(strings)
        return (codes.astype(np.uint8) if codes.max(initial=0) < 254 else codes), lengths

    def similar(self, a: np.ndarray, b: np.ndarray, floor: float) -> np.ndarray:
        """Whether F6 of the names ``a`` and ``b`` (row numbers) exceeds ``floor``; pairs of like length advance together."""
        out = np.zeros(len(a), bool)
        order = np.argsort(np.maximum(self.longest[a], self.longest[b]), kind="stable")
        for at in range(0, len(order), _CHUNK):
            pick = order[at:at + _CHUNK]
            out[pick] = self._similar(a[pick], b[pick], floor)
        return out

    def _similar(self, a: np.ndarray, b: np.ndarray, floor: float) -> np.ndarray:
        out, at = np.zeros(len(a), bool), np.arange(len(a))
        total = self.n_key[a] + self.n_key[b]
        ts = np.where(total == 0, 100.0, _percent(self.marks_key.lcs(a, b), total))
        live = blend(ts, 100.0, 100.0) > floor
        at, ts = at[live], ts[live]
        least, most = self._windows(a[at], b[at])
        live = blend(ts, 100.0, most) > floor
        at, ts, least, most = at[live], ts[live], least[live], most[live]
        tset = self._token_sets(a[at], b[at])
        sure = blend(ts, tset, least) > floor
        out[at[sure]] = True
        open_ = np.flatnonzero(~sure & (blend(ts, tset, most) > floor))
        if len(open_):
            out[at[open_]] = blend(ts[open_], tset[open_], self.partial(a[at[open_]], b[at[open_]])) > floor
        return out

    def _windows(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of F5: a window of the longer text keeps all of the common subsequence but what lies outside of it."""
        na, nb = self.n_clean[a], self.n_clean[b]
        short, gap = np.minimum(na, nb), np.abs(na - nb)
        common = self.marks_clean.lcs(a, b)
        none = (na == 0) & (nb == 0)
        return tuple(np.where(none, 100.0, _best_window(n, short)) for n in (np.maximum(common - gap, 0), common))

    def partial(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """F5 of the names ``a`` and ``b``."""
        best = self.marks_clean.best_windows(a, b)
        if best is None:
            return partial_ratios([self.strings[i] for i in a], [self.strings[i] for i in b])
        na, nb = self.n_clean[a], self.n_clean[b]
        return np.where((na == 0) & (nb == 0), 100.0, _best_window(best, np.minimum(na, nb)))

    def bounds(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """F6 of the names ``a`` and ``b`` lies between the two last; the first two are its token-sort and token-set ratios."""
        ts, tset, least, most = (np.zeros(len(a)) for _ in range(4))
        order = np.argsort(np.maximum(self.longest[a], self.longest[b]), kind="stable")
        for at in range(0, len(order), _CHUNK):
            pick = order[at:at + _CHUNK]
            x, y = a[pick], b[pick]
            total = self.n_key[x] + self.n_key[y]
            ts[pick] = np.where(total == 0, 100.0, _percent(self.marks_key.lcs(x, y), total))
            tset[pick] = self._token_sets(x, y)
            least[pick], most[pick] = self._windows(x, y)
        return ts, tset, blend(ts, tset, least), blend(ts, tset, most)

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """F6 of the names ``a`` and ``b``."""
        ts, tset, least, most = self.bounds(a, b)
        open_ = np.flatnonzero(least < most)
        least[open_] = blend(ts[open_], tset[open_], self.partial(a[open_], b[open_]))
        return least

    def _token_sets(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """the shared words lead both sides, so only what follows them needs a common subsequence."""
        if not len(a):
            return np.zeros(0)
        wa, wb = self.weight[a], self.weight[b]
        ta, tb = np.where(wa > 0, self.token[a], -1), np.where(wb > 0, self.token[b], -2)
        same = ta[:, :, None] == tb[:, None, :]
        own_a, own_b = ~same.any(2), ~same.any(1)
        shared = np.maximum((wa * ~own_a).sum(1) - 1, 0)
        len_a, len_b = np.maximum(wa.sum(1) - 1, 0), np.maximum(wb.sum(1) - 1, 0)
        rest = self._rest_lcs(a, b, own_a, own_b)
        rest = np.where((shared == 0) & (rest > 0), rest - 1, rest)  # without shared words no space goes before the first one
        best = np.maximum(np.maximum(_percent(shared, shared + len_a), _percent(shared, shared + len_b)),
                          _percent(shared + rest, len_a + len_b))
        return np.where((len_a > 0) & (len_b > 0), best, 0.0)

    def _rest_lcs(self, a: np.ndarray, b: np.ndarray, own_a: np.ndarray, own_b: np.ndarray) -> np.ndarray:
        """The longest common subsequence of the tokens that only one side has."""
        na, nb = self.n_set[a], self.n_set[b]
        wide_a, wide_b = max(1, int(na.max())), max(1, int(nb.max()))
        if self.marks_set.masks is not None:
            mine = np.bitwise_or.reduce(np.where(own_a, self.token_bits[a], np.uint64(0)), axis=1)
            theirs = np.take_along_axis(own_b, self.owner[b, :wide_b].astype(np.int64), 1)
            return self.marks_set.lcs_of(a, np.where(theirs, self.marks_set.coded[b, :wide_b], 0), mine)
        rest_a = np.where(np.take_along_axis(own_a, self.owner[a, :wide_a].astype(np.int64), 1), self.set[a, :wide_a], 0)
        rest_b = np.where(np.take_along_axis(own_b, self.owner[b, :wide_b].astype(np.int64), 1), self.set[b, :wide_b], 1)
        return _lcs_codes(rest_a, na, rest_b, nb) if wide_a >= wide_b else _lcs_codes(rest_b, nb, rest_a, na)


class _Marks:
    """Where each character stands in each text, one 64-bit word per text and character: a step of the common
    subsequence is one look-up. Texts of more characters, or too many kinds of them, are compared as codes."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray):
        self.codes, self.lengths = codes, lengths
        inside = np.arange(codes.shape[1]) < lengths[:, None]
        kinds, coded = np.unique(codes[inside], return_inverse=True)
        self.width = len(kinds) + 1
        self.masks = None
        if codes.shape[1] <= 64 and len(codes) * self.width <= _MASKS:
            self.coded = np.zeros(codes.shape, np.int32)  # 0 past the end: no place has it
            self.coded[inside] = coded + 1
            self.masks = np.zeros(len(codes) * self.width, np.uint64)
            row, place = np.nonzero(inside)
            np.bitwise_or.at(self.masks, row * self.width + self.coded[row, place], np.uint64(1) << place.astype(np.uint64))

    def lcs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.masks is None or not len(a):
            return _lcs_of(self.codes, self.lengths, a, b)
        turn = self.lengths[a] < self.lengths[b]  # the shorter side makes the steps
        a, b = np.where(turn, b, a), np.where(turn, a, b)
        return self.lcs_of(a, self.coded[b, :int(self.lengths[b].max())])

    def lcs_of(self, a: np.ndarray, steps: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
        """The same of the texts ``a`` (of their places ``inside`` only) and of coded characters."""
        free = np.full(len(a), 0xFFFFFFFFFFFFFFFF, np.uint64)
        for at in (steps + (a * self.width)[:, None]).T.copy():
            taken = free & self.masks[at]
            if inside is not None:
                taken &= inside
            free = (free + taken) | (free ^ taken)
        return np.bitwise_count(~free).astype(np.int64)

    def only(self, picked: np.ndarray) -> _Marks:
        out = copy.copy(self)
        out.codes, out.lengths = self.codes[picked], self.lengths[picked]
        if self.masks is not None:
            out.coded, out.masks = self.coded[picked], self.masks.reshape(-1, self.width)[picked].ravel()
        return out

    def best_windows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
        """The longest common subsequence of the shorter text and a window of its length in the longer one."""
        if self.masks is None:
            return None
        turn = self.lengths[a] > self.lengths[b]
        a, b = np.where(turn, b, a), np.where(turn, a, b)
        size = self.lengths[a]
        counts = self.lengths[b] - size + 1
        upto = np.concatenate(([0], np.cumsum(counts)))
        out, at = np.zeros(len(a), np.int64), 0
        while at < len(a):
            to = max(at + 1, int(np.searchsorted(upto, upto[at] + _CHUNK, side="right")) - 1)
            pair = np.repeat(np.arange(at, to), counts[at:to])
            start = np.arange(len(pair)) - np.repeat(upto[at:to] - upto[at], counts[at:to])
            mask, text, left, last = a[pair] * self.width, b[pair], size[pair], self.coded.shape[1] - 1
            free = np.full(len(pair), 0xFFFFFFFFFFFFFFFF, np.uint64)
            for j in range(int(left.max(initial=0))):
                taken = free & self.masks[mask + np.where(j < left, self.coded[text, np.minimum(start + j, last)], 0)]
                free = (free + taken) | (free ^ taken)
            out[at:to] = np.maximum.reduceat(np.bitwise_count(~free).astype(np.int64), upto[at:to] - upto[at])
            at = to
        return out


def _percent(common: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.rint(100 * (2.0 * common / np.maximum(total, 1)))


def _best_window(common: np.ndarray, short: np.ndarray) -> np.ndarray:
    best = 2.0 * common / np.maximum(2 * short, 1)
    return np.where(best > 0.995, 100.0, np.rint(100 * best))


def _lcs_of(codes: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not len(a):
        return np.zeros(0, np.int64)
    na, nb = lengths[a], lengths[b]
    x, y = codes[a, :max(1, int(na.max()))], codes[b, :max(1, int(nb.max()))]
    return _lcs_codes(x, na, y, nb) if x.shape[1] >= y.shape[1] else _lcs_codes(y, nb, x, na)


# --- single values ---------------------------------------------------------------------
def lcs_len(a: str, b: str) -> int:
    return int(lcs_lens([a], [b])[0])


def ratio(a: str | None, b: str | None) -> int:
    return 0 if a is None or b is None else int(ratios([a], [b])[0])


def partial_ratio(a: str | None, b: str | None) -> int:
    return 0 if a is None or b is None else int(partial_ratios([a], [b])[0])


def words_of(text: str) -> list[str]:
    """Lower-case ASCII word runs: other ASCII parts words, anything beyond ASCII vanishes."""
    return re.sub(r"\W", " ", text.encode("ascii", "ignore").decode()).lower().split()


def token_sort_ratio(a: str | None, b: str | None) -> int:
    if a is None or b is None:
        return 0
    return ratio(" ".join(sorted(words_of(a))), " ".join(sorted(words_of(b))))


def set_parts(a: str, b: str) -> tuple[str, str, str]:
    """Shared words, and the shared words followed by each side's own."""
    x, y = set(words_of(a)), set(words_of(b))
    shared = sorted(x & y)
    return " ".join(shared), " ".join(shared + sorted(x - y)), " ".join(shared + sorted(y - x))


def token_set_ratio(a: str | None, b: str | None) -> int:
    if a is None or b is None:
        return 0
    sect, c1, c2 = set_parts(a, b)
    return int(max(ratios([sect, sect, c1], [c1, c2, c2]))) if c1 and c2 else 0


def clean_text(s: str) -> str:
    """punctuation to space, squeeze spaces, trim (input already lower-cased)."""
    return " ".join(re.sub(r"[^\w\s]", " ", s).split())


def name_similarity(name: str | None, query: str | None) -> float:
    """F6 on cleaned lower text; 0 when either side is missing."""
    if not name or not query:
        return 0.0
    a, b = clean_text(name.lower()), clean_text(query.lower())
    return (token_sort_ratio(a, b) * 0.4 + token_set_ratio(a, b) * 0.4 + partial_ratio(a, b) * 0.2) / 100.0
