"""Token ids of whole texts by their distinct chunks.

A splitting pattern of a public vocabulary never joins a character that isn't white space
with white space after it, so a text can be cut there: the ids of a text are those of its
chunks in order (tests hold this against encoding whole texts). Arrow splits a block of
texts, finds its distinct chunks and gathers their ids as bytes, so no Python object
exists per occurrence. Most chunks are a word and trailing punctuation, two units of the
pattern: unseen words go through the BPE model thousands at a time. Any other chunk is
cut into units, or, if it holds unusual characters, goes through the whole tokenizer.
Chunks and words seen before are kept per worker in bounded tables.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES, ENTRIES, TABLE_BYTES = 24 << 20, 1_500_000, 256 << 20
TEXT, IDS = pa.large_string(), pa.large_binary()
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"  # their class is the same in every Unicode version
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CUT = re.compile(r"(?<=\S) ")
_PLAIN = re.compile(rf"[\n -~{LETTERS}]*")
#: A blank at the start or after any white space: there a cut at every blank would be wrong.
_ODD_BLANK = "^ |[\x09-\x0d\x1c-\x1f \x85\xa0  -     　] "


def byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}


LETTER_OF = byte_letters()


def spelled(text: str) -> str:
    """A plain text in the byte-level alphabet."""
    text = text.replace(" ", LETTER_OF[32]).replace("\n", LETTER_OF[10])
    for c in () if text.isascii() else {c for c in text if "À" <= c <= "ÿ"}:
        text = text.replace(c, "".join(LETTER_OF[b] for b in c.encode()))
    return text


def strings(items: list[str]) -> pa.Array:
    return pa.array(items, TEXT)


def bytes_of(ids: list[list[int]]) -> pa.Array:
    """Rows of ids as little-endian unsigned 32-bit bytes."""
    return cut_ids(np.fromiter((i for row in ids for i in row), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)))


def cut_ids(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive runs of ``sizes`` ids, as bytes."""
    offsets = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))) * ids.itemsize
    return pa.LargeBinaryArray.from_buffers(IDS, len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids))])


def sizes_of(values: pa.Array) -> np.ndarray:
    return np.diff(np.frombuffer(values.buffers()[1], np.int64)[values.offset:values.offset + len(values) + 1])


def content(values: pa.Array) -> memoryview:
    """The bytes of all rows, one after the other."""
    offsets = np.frombuffer(values.buffers()[1], np.int64)
    return memoryview(values.buffers()[2] or b"")[int(offsets[values.offset]):int(offsets[values.offset + len(values)])]


class Memo:
    """A bounded table of what ``compute`` gave for strings; it is asked for unseen ones only."""

    def __init__(self, compute: Callable[[pa.Array], list[pa.Array]], entries: int = ENTRIES):
        self.compute, self.entries, self.keys, self.values = compute, entries, strings([]), None

    def __call__(self, wanted: pa.Array) -> list[pa.Array]:
        """Columns of ``compute`` for distinct strings. A full table stays as it is while it knows most of them."""
        at = pc.index_in(wanted, value_set=self.keys)
        if not at.null_count and self.values is not None:
            return [v.take(at) for v in self.values]
        unseen = at.is_null()
        new = wanted.filter(unseen)
        columns = self.compute(new)
        if self.values is None or 2 * len(new) > len(wanted) and self.full():
            self.keys, self.values = new, columns
        elif not self.full():
            place, mask = np.asarray(at.fill_null(0)).astype(np.int64), np.asarray(unseen)
            place[mask] = len(self.keys) + np.arange(len(new))
            self.keys = pa.concat_arrays([self.keys, new])
            self.values = [pa.concat_arrays([a, b]) for a, b in zip(self.values, columns, strict=True)]
            return [v.take(pa.array(place)) for v in self.values]
        if len(new) == len(wanted):
            return columns
        seen, order = at.drop_null(), np.empty(len(wanted), np.int64)
        mask = np.asarray(unseen)
        order[~mask], order[mask] = np.arange(len(seen)), len(seen) + np.arange(len(new))
        return [pa.concat_arrays([v.take(seen), c]).take(pa.array(order)) for v, c in zip(self.values, columns, strict=True)]

    def full(self) -> bool:
        return len(self.keys) >= self.entries or self.keys.nbytes + sum(v.nbytes for v in self.values) > TABLE_BYTES


@dataclass
class Chunks:
    """A block of texts as numbers of distinct chunks, in order; ``sizes`` has each text's number of chunks."""

    distinct: pa.Array
    numbers: pa.Array
    sizes: np.ndarray


def split_at_blanks(texts: pa.Array) -> Chunks:
    """Cut texts (no nulls) at blanks that follow a character other than white space; a chunk is what follows its blank."""
    odd = pc.match_substring_regex(texts, _ODD_BLANK)
    cut = pc.split_pattern(texts, " ")
    if odd.true_count:
        rare = pa.array([_CUT.split(t) for t in texts.filter(odd).to_pylist()], cut.type)
        cut = _merged(cut, odd, rare)
    return _numbered(cut)


def _merged(rows: pa.Array, mask: pa.Array, others: pa.Array) -> pa.Array:
    """``rows``, with the masked ones taken in order from ``others``."""
    m = np.asarray(mask)
    at = np.arange(len(rows))
    at[m] = len(rows) + np.arange(len(others))
    return pa.concat_arrays([rows, others]).take(pa.array(at))


def _numbered(rows: pa.Array) -> Chunks:
    coded = rows.flatten().dictionary_encode()
    return Chunks(coded.dictionary, coded.indices, np.diff(np.asarray(rows.offsets)).astype(np.int64))


def blocks(texts: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Runs of neighbouring texts (null: empty) of about ``block_bytes``, with the place of the first."""
    texts = pc.fill_null(texts.cast(TEXT), "")
    ends, at = np.cumsum(sizes_of(texts)), 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + block_bytes, "right")))
        yield at, texts.slice(at, end - at)
        at = end


def distinct(values: pa.Array) -> tuple[pa.Array, pa.Array]:
    coded = values.dictionary_encode()
    return coded.dictionary, coded.indices


class ChunkEncoder:
    """What is common to vocabularies: words with trailing punctuation, units, and the rest."""

    #: The vocabulary's splitting pattern for plain characters.
    units: re.Pattern

    def __init__(self, path: str, plain_specials: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already uses every core
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        added = [] if plain_specials else [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.of_chunk, self.of_word = Memo(self.new_chunks), Memo(self._words)
        self.of_unit: dict[str, bytes] = {}

    def flagged(self, test) -> np.ndarray:
        """For each id, whether its token passes ``test``."""
        flags = np.zeros(max(self.vocab.values(), default=0) + 1, bool)
        flags[[i for t, i in self.vocab.items() if test(t)]] = True
        return flags

    def whole(self, said: list[str]) -> list[list[int]]:
        """Ids of strings by the whole tokenizer."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(said, add_special_tokens=False)]

    def model_ids(self, spelled: str) -> np.ndarray:
        """Ids of many spelled units between line feeds, by the model alone."""
        return np.array(self.bare.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, "<u4")

    def _unit(self, unit: str) -> bytes:
        ids = self.of_unit.get(unit)
        if ids is None:
            ids = np.array([t.id for t in self.tokenizer.model.tokenize(spelled(unit))], "<u4").tobytes()
            if len(self.of_unit) >= 200_000:
                self.of_unit.clear()
            if len(unit) <= 64:
                self.of_unit[unit] = ids
        return ids

    def by_units(self, said: list[str]) -> list[bytes]:
        """Ids of any strings as they are."""
        out = [b"".join(map(self._unit, self.units.findall(self.folded(s)))) if _PLAIN.fullmatch(s) and not self.special.search(s) else None
               for s in said]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self.whole([said[i] for i in rest]), strict=True):
            out[i] = np.array(ids, "<u4").tobytes()
        return out

    def folded(self, text: str) -> str:
        return text

    def opened(self, chunk: str) -> str:
        """A chunk as it stands in a text."""
        return chunk

    def _words(self, words: pa.Array) -> list[pa.Array]:
        out = []
        for at in range(0, len(words), 5000):
            part = words.slice(at, 5000).to_pylist()
            ids, sizes = self.lettered(part)
            out.append(cut_ids(ids, sizes) if len(sizes) == len(part) else bytes_of(self.whole([self.opened(w) for w in part])))
        return [pa.concat_arrays(out) if out else pa.array([], IDS)]

    def new_chunks(self, chunks: pa.Array) -> list[pa.Array]:
        """Ids of distinct chunks, computed."""
        words = pc.utf8_rtrim(chunks, characters=_PUNCTUATION)
        simple = pc.match_substring_regex(words, f"^[{LETTERS}]+$")
        tails = pc.replace_substring_regex(chunks.filter(simple), f"^[{LETTERS}]+", "", max_replacements=1)
        words, w = distinct(self.folded_words(words.filter(simple)))
        tails, t = distinct(tails)
        tail_ids = pa.array(self.by_units(tails.to_pylist()), IDS)
        plain = pc.binary_join_element_wise(self.of_word(words)[0].take(w), tail_ids.take(t), pa.scalar(b"", IDS))
        rest = pa.array(self.by_units([self.opened(c) for c in chunks.filter(pc.invert(simple)).to_pylist()]), IDS)
        order, mask = np.empty(len(chunks), np.int64), np.asarray(simple)
        order[mask], order[~mask] = np.arange(len(plain)), len(plain) + np.arange(len(rest))
        return [pa.concat_arrays([plain, rest]).take(pa.array(order))]

    def folded_words(self, words: pa.Array) -> pa.Array:
        return words

    def gathered(self, c: Chunks, ids: pa.Array, numbers: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block, and each text's number of them."""
        taken = ids.take(numbers)
        ends = np.concatenate(([0], np.cumsum(sizes_of(taken) // 4)))
        return np.frombuffer(content(taken), "<u4"), np.diff(ends[np.concatenate(([0], np.cumsum(c.sizes)))])


class ByteEncoder(ChunkEncoder):
    """Byte-level BPE whose words hold the blank before them."""

    units = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+")

    def __init__(self, path: str, plain_specials: bool):
        super().__init__(path, plain_specials)
        self.blank = LETTER_OF[32]
        self.leads = self.flagged(lambda t: t.startswith(self.blank))

    def opened(self, chunk: str) -> str:
        return " " + chunk

    def lettered(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words after their blanks, told apart by the tokens that hold the blank."""
        ids = self.model_ids(self.blank + f"\n{self.blank}".join(spelled("\n".join(words)).split(LETTER_OF[10])))
        return ids, np.diff(np.flatnonzero(self.leads[ids]), append=len(ids))

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts (no nulls), and each text's number of them."""
        c = split_at_blanks(texts)
        numbers = np.array(c.numbers, np.int64)
        firsts = np.cumsum(c.sizes) - c.sizes  # every text has a first chunk, which no blank precedes
        heads, of_text = np.unique(numbers[firsts], return_inverse=True)
        numbers[firsts] = len(c.distinct) + of_text
        ids = pa.concat_arrays([*self.of_chunk(c.distinct), pa.array(self.by_units(c.distinct.take(pa.array(heads)).to_pylist()), IDS)])
        return self.gathered(c, ids, pa.array(numbers))


class WordEncoder(ChunkEncoder):
    """Lower-case BPE that drops white space and marks the ends of words."""

    units = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{LETTERS}]+|[0-9]|[^\s0-9{LETTERS}]+")

    def __init__(self, path: str, plain_specials: bool):
        super().__init__(path, plain_specials)
        self.ends = self.flagged(lambda t: t.endswith("</w>"))

    def folded(self, text: str) -> str:
        return text.lower()

    def folded_words(self, words: pa.Array) -> pa.Array:
        return pc.utf8_lower(words)

    def lettered(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, told apart by the tokens that end one."""
        ids = self.model_ids(spelled("\n".join(words)).replace(LETTER_OF[10], "\n"))
        return ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts (no nulls), and each text's number of them."""
        c = _numbered(pc.ascii_split_whitespace(texts))
        return self.gathered(c, self.of_chunk(c.distinct)[0], c.numbers)


_ENCODERS: dict[tuple, ChunkEncoder] = {}  # one per Python worker, kept from task to task


def encoder(kind: type[ChunkEncoder], path: str, plain_specials: bool = False) -> ChunkEncoder:
    key = (kind, path, plain_specials)
    if key not in _ENCODERS:
        _ENCODERS[key] = kind(path, plain_specials)
    return _ENCODERS[key]
