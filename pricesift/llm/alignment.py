"""Alignment of two tokenizers' tokens over the same bytes.

``shared_groups`` is the divide and conquer: of two rising lists of token ends it looks for
a common end near the middle by bisection, cuts there and goes on in both halves; an
interval without a common end inside is a leaf group. An end is looked at once, so a list
without common ends costs no more than one with many. ``TokenAligner`` applies it to texts:
a blank after a character other than white space starts a token of both vocabularies, so
it is a cut known without looking; the chunks between such cuts repeat, and each distinct
chunk is encoded and aligned once per worker (bounded table).

``align`` gives each document its groups and links and how common its links are:

1. Tasks align their documents block by block and write, for each block, the documents'
   counts, their distinct (A id, B id) pairs as packed numbers, and the block's distinct
   pairs with the number of its documents that hold them (counted before any shuffle).
2. Spark adds the blocks' numbers up: documents per pair, and the highest per A id.
3. The pairs a block asked for go back to it, and its documents' sums are taken there.

So neither links nor documents are shuffled one by one, a pair held by a third of all
documents is one row a block, and no vocabulary-wide table is collected or broadcast.

Defined cases: texts that are null, empty, or whose tokens do not spell blank + text (the
word-boundary mark U+2581 in a text) have no tokens: zeros and an empty string; special
tokens' strings are plain text; repeated rows are separate documents; null ids stay;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_shared
from .chunk_ids import IDS, LETTER_OF, TEXT, ByteEncoder, Memo, blocks, content, cut_ids, encoder, sizes_of, split_at_blanks

TEXT_BYTES, ENTRIES_IN_BLOCK, DOCUMENTS_IN_BLOCK, KNOWN_CHUNKS = 4 << 20, 4_000_000, 1 << 18, 400_000
FEW, LARGE_GROUP = 64, 64
FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def shared_groups(a_ends: list[int], b_ends: list[int]) -> list[tuple[int, int, int, int]]:
    """Leaf groups (a from, a to, b from, b to), in order, of two rising lists with equal last ends."""
    groups, todo = [], [(0, len(a_ends), 0, len(b_ends), 0, len(a_ends) - 1)]
    while todo:
        a0, a1, b0, b1, low, high = todo.pop()  # only the ends low to high - 1 of A may be common
        left = (low + high - 1) // 2
        right, last = left + 1, b1 - 1
        while left >= low or right < high:
            if left >= low:
                at = bisect_left(b_ends, a_ends[left], b0, last)
                if at < last and b_ends[at] == a_ends[left]:
                    todo += ((left + 1, a1, at + 1, b1, right, high), (a0, left + 1, b0, at + 1, low, left))
                    break
                left -= 1
            if right < high:
                at = bisect_left(b_ends, a_ends[right], b0, last)
                if at < last and b_ends[at] == a_ends[right]:
                    todo += ((right + 1, a1, at + 1, b1, right + 1, high), (a0, right + 1, b0, at + 1, low, left + 1))
                    break
                right += 1
        else:
            groups.append((a0, a1, b0, b1))
    return groups


def _spelling(tokens: pa.Array, per_chunk: np.ndarray, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each token ends, counted on over all chunks, and which chunks the tokens spell."""
    ends = np.cumsum(sizes_of(tokens))
    cuts = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(per_chunk)))]
    wanted = np.concatenate(([0], np.cumsum(sizes_of(chunks))))
    said, want = content(tokens), content(chunks)
    if len(said) == len(want) and (cuts == wanted).all() and said == want:
        return ends, np.ones(len(per_chunk), bool)
    fine = np.array([said[i:j] == want[k:m] for i, j, k, m in zip(cuts, cuts[1:], wanted, wanted[1:], strict=False)], bool)
    return ends + np.repeat(wanted[:-1] - cuts[:-1], per_chunk), fine


def shared_groups_of_many(a_ends: np.ndarray, b_ends: np.ndarray, a_starts: np.ndarray, b_starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """``shared_groups`` of many pairs of lists at once, each step for all of them.

    The lists stand one after the other, their ends counted on; ``a_starts`` and ``b_starts``
    (with a closing one) say where each begins. What a few long intervals have left is done
    one by one.
    """
    a0, a1, b0, b1 = a_starts[:-1], a_starts[1:], b_starts[:-1], b_starts[1:]
    low, high = a0, a1 - 1
    left = (low + high - 1) // 2
    right, found = left + 1, []
    turn = np.zeros(len(a0), bool)  # whose turn it is: the ends to the left or to the right of the middle
    while len(a0) >= FEW:
        at_left, at_right = left >= low, right < high
        leaf = ~(at_left | at_right)
        if leaf.any():
            found.append(np.stack([a0[leaf], a1[leaf], b0[leaf], b1[leaf]]))
            a0, a1, b0, b1, low, high, left, right, turn, at_left, at_right = (
                x[~leaf] for x in (a0, a1, b0, b1, low, high, left, right, turn, at_left, at_right))
        to_left = at_left & (~turn | ~at_right)
        looked = np.where(to_left, left, right)
        at = np.searchsorted(b_ends, a_ends[looked])
        hit = b_ends[np.minimum(at, len(b_ends) - 1)] == a_ends[looked]
        miss = ~hit
        halves = [[a0[hit], looked[hit] + 1, b0[hit], at[hit] + 1, low[hit], np.where(to_left, left, left + 1)[hit]],
                  [looked[hit] + 1, a1[hit], at[hit] + 1, b1[hit], np.where(to_left, right, right + 1)[hit], high[hit]]]
        left, right, turn = np.where(to_left, left - 1, left)[miss], np.where(to_left, right, right + 1)[miss], to_left[miss]
        new = [np.concatenate(x) for x in zip(*halves, strict=True)]
        middle = (new[4] + new[5] - 1) // 2
        a0, a1, b0, b1, low, high = (np.concatenate([x[miss], y]) for x, y in zip((a0, a1, b0, b1, low, high), new, strict=True))
        left, right = np.concatenate([left, middle]), np.concatenate([right, middle + 1])
        turn = np.concatenate([turn, np.zeros(len(middle), bool)])
    for i, j, k, m in zip(a0.tolist(), a1.tolist(), b0.tolist(), b1.tolist(), strict=True):
        found.append(np.array(shared_groups(a_ends[i:j].tolist(), b_ends[k:m].tolist()), np.int64).T + np.array([[i], [i], [k], [k]]))
    groups = np.concatenate(found, axis=1)
    return tuple(groups[:, np.argsort(groups[0])])


class TokenAligner:
    """Groups and links of texts under a byte-level BPE (A) and a sentencepiece model (B)."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        self.a = encoder(ByteEncoder, a_path, True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {c: bytes([b]) for b, c in LETTER_OF.items()}
        a_bytes = [b""] * (max(self.a.vocab.values()) + 1)
        for token, i in self.a.vocab.items():
            a_bytes[i] = b"".join(byte_of.get(c, b"") for c in token)
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                   for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        self.n_a, self.n_b = len(a_bytes), len(b_bytes)  # a pair is A id * n_b + B id
        if self.n_a * self.n_b >= 1 << 32:
            raise ValueError("the vocabularies are too large for pairs of 32 bits")
        self.a_bytes, self.b_bytes = pa.array(a_bytes, IDS), pa.array(b_bytes, IDS)
        said = [f"{i}{end}" for n, ends in ((self.n_a, ",|"), (self.n_b, ",;")) for end in ends for i in range(n)]
        self.said = pa.array(said, TEXT)  # ids inside a group, last A ids, B ids, last B ids
        self.blank = self.b.piece_to_id("▁")
        self.known = Memo(self._aligned, KNOWN_CHUNKS)

    def encoded(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A ids, B ids and their numbers per chunk."""
        a = self.a.new_chunks(chunks)[0]
        b = [x or [self.blank] for x in self.b.encode(chunks.to_pylist(), num_threads=1)]
        sizes = np.fromiter(map(len, b), np.int64, len(b))
        return np.frombuffer(content(a), "<u4").astype(np.int64), np.fromiter(chain.from_iterable(b), np.int64, int(sizes.sum())), sizes_of(a) // 4, sizes

    def _aligned(self, chunks: pa.Array) -> list[pa.Array]:
        """For distinct chunks: whether tokens spell them, the four figures, groups as text, pairs and how often each is linked."""
        a, b, of_a, of_b = self.encoded(chunks)
        spelled = pc.binary_join_element_wise(pa.scalar(" ", TEXT), chunks, pa.scalar("", TEXT)).cast(IDS)
        a_ends, a_fine = _spelling(self.a_bytes.take(pa.array(a)), of_a, spelled)
        b_ends, b_fine = _spelling(self.b_bytes.take(pa.array(b)), of_b, spelled)
        fine = a_fine & b_fine
        columns = [of_a, of_b, np.zeros(len(fine), np.int64), np.zeros(len(fine), np.int64)]
        texts, pairs, often = [pa.array([""], TEXT)], [pa.array([b""], IDS)], [pa.array([b""], IDS)]
        order = np.zeros(len(fine), np.int64)
        if fine.any():
            in_a, in_b = np.repeat(fine, of_a), np.repeat(fine, of_b)
            n_groups, n_links, *more = self._grouped(a[in_a], b[in_b], a_ends[in_a], b_ends[in_b], of_a[fine], of_b[fine])
            columns[2][fine], columns[3][fine] = n_groups, n_links
            for column, found in zip((texts, pairs, often), more, strict=True):
                column.append(found)
            order[fine] = 1 + np.arange(fine.sum())
        return [pa.array(fine), *map(pa.array, columns), *(pa.concat_arrays(x).take(pa.array(order)) for x in (texts, pairs, often))]

    def _grouped(self, a, b, a_ends, b_ends, of_a, of_b) -> tuple:
        """Groups and links of chunks that their tokens spell."""
        a_starts, b_starts = (np.concatenate(([0], np.cumsum(n))) for n in (of_a, of_b))
        a0, a1, b0, b1 = shared_groups_of_many(a_ends, b_ends, a_starts, b_starts)
        in_a, in_b, chunk = a1 - a0, b1 - b0, np.searchsorted(a_starts, a0, "right") - 1
        n_links = np.bincount(chunk, in_a * in_b, len(of_a)).astype(np.int64)
        # Texts: of each group its A ids, then its B ids; the last of each has its own ending.
        order = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[a1 - 1], last_b[b1 - 1] = self.n_a, self.n_b
        order[np.arange(len(a)) + np.repeat(b0, in_a)] = a + last_a
        order[np.arange(len(b)) + np.repeat(a1, in_b)] = 2 * self.n_a + b + last_b
        said = self.said.take(pa.array(order))
        ends = np.concatenate(([0], np.cumsum(sizes_of(said))))[a_starts + b_starts]
        texts = pa.LargeStringArray.from_buffers(len(of_a), pa.py_buffer(ends), pa.py_buffer(bytes(content(said))))
        # Pairs: all of small groups; the distinct ones of large groups, with their numbers.
        large = in_a * in_b > LARGE_GROUP
        sizes = np.where(large, 0, in_a * in_b)
        group = np.repeat(np.arange(len(sizes)), sizes)
        k = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        pairs = (a[a0[group] + k // in_b[group]] * self.n_b + b[b0[group] + k % in_b[group]]).astype("<u4")
        often, of_chunk = np.ones(len(pairs), "<u4"), chunk[group]
        if large.any():
            more = [self._tallied(a[i:j], b[m:n]) for i, j, m, n in zip(a0[large], a1[large], b0[large], b1[large], strict=True)]
            of_chunk = np.concatenate([of_chunk, np.repeat(chunk[large], [len(x) for x, _ in more])])
            by_chunk = np.argsort(of_chunk, kind="stable")
            pairs, often = (np.concatenate(x)[by_chunk].astype("<u4") for x in zip((pairs, often), *more, strict=True))
            of_chunk = of_chunk[by_chunk]
        held = np.bincount(of_chunk, minlength=len(of_a))
        return np.bincount(chunk, minlength=len(of_a)), n_links, texts, cut_ids(pairs, held), cut_ids(often, held)

    def _tallied(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of all links of a group, and how many links each has."""
        (x, n), (y, m) = (np.unique(v, return_counts=True) for v in (a, b))
        return (x[:, None] * self.n_b + y).ravel(), (n[:, None] * m).ravel()

    def texts(self, texts: pa.Array) -> tuple[list[np.ndarray], list[str], np.ndarray, np.ndarray, np.ndarray]:
        """For texts (no nulls): figures, hashes, and by (text, pair): place of the text, pair, number of links."""
        c = split_at_blanks(texts)
        fine, *figures, said, pairs, often = self.known(c.distinct)
        starts = np.cumsum(c.sizes) - c.sizes
        per_text = lambda column: np.add.reduceat(np.asarray(column.take(c.numbers)).astype(np.int64), starts)
        whole = (per_text(fine.cast(pa.int8())) == c.sizes) & (np.asarray(pc.binary_length(texts)) > 0)
        figures = [per_text(x) * whole for x in figures]
        said = said.take(c.numbers)
        ends, buffer = np.cumsum(np.concatenate(([0], sizes_of(said)))), content(said)
        cuts = ends[np.concatenate((starts, [len(c.numbers)]))].tolist()
        hashes = [hashlib.sha256(buffer[i:j - 1]).hexdigest() if ok else "" for i, j, ok in zip(cuts, cuts[1:], whole, strict=False)]
        place = np.repeat(np.where(whole, np.arange(len(whole)), -1), c.sizes)
        taken, times = pairs.take(c.numbers), np.frombuffer(content(often.take(c.numbers)), "<u4")
        key = (np.repeat(place, sizes_of(taken) // 4) << 32) | np.frombuffer(content(taken), "<u4")
        key, times = key[key >= 0], times[key >= 0]
        if (times == 1).all():
            key, counts = np.unique(key, return_counts=True)
        else:
            key, inverse = np.unique(key, return_inverse=True)
            counts = np.bincount(inverse, times, len(key)).astype(np.int64)
        return figures, hashes, key >> 32, key & 0xFFFFFFFF, counts


_ALIGNERS: dict[tuple[str, str], TokenAligner] = {}  # one per Python worker, kept from task to task


def aligner(paths: tuple[str, str]) -> TokenAligner:
    if paths not in _ALIGNERS:
        _ALIGNERS[paths] = TokenAligner(*paths)
    return _ALIGNERS[paths]


def _packed(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(c.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns))


def _unpacked(data: bytes, sizes: list[int]) -> list[np.ndarray]:
    """The columns of ``_packed`` (bytes of one rank stand together)."""
    raw, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), []
    for n in sizes:
        part, raw = raw[:4 * n], raw[4 * n:]
        out.append(np.ascontiguousarray(part.reshape(4, n).T).reshape(-1).view("<u4").astype(np.int64) if n else np.empty(0, np.int64))
    return out


class _Block:
    """The documents of a block so far."""

    def __init__(self):
        self.ids, self.figures, self.hashes, self.per_doc, self.pairs, self.often = [], [], [], [], [], []
        self.entries = 0

    def add(self, ids: pa.Array, figures, hashes, place, pairs, often) -> None:
        self.ids.append(ids)
        self.figures.append(np.stack(figures))
        self.hashes += hashes
        self.per_doc.append(np.bincount(place, minlength=len(ids)))
        self.pairs.append(pairs.astype("<u4"))
        self.often.append(often.astype("<u4"))
        self.entries += len(pairs)

    def row(self, number: int, schema: pa.Schema) -> pa.RecordBatch:
        ids, figures = pa.concat_arrays(self.ids), np.concatenate(self.figures, axis=1)
        pairs, at, n_docs = np.unique(np.concatenate(self.pairs), return_inverse=True, return_counts=True)
        per_doc = np.concatenate(self.per_doc)
        step = np.diff(at, prepend=0)
        step[(np.cumsum(per_doc) - per_doc)[per_doc > 0]] = at[(np.cumsum(per_doc) - per_doc)[per_doc > 0]]  # rising within a document
        links = _packed(per_doc, step, np.concatenate(self.often))
        one = lambda values, kind: pa.array([values], kind)
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
             *(one(f, pa.list_(pa.int64())) for f in figures), one(self.hashes, pa.list_(pa.string())),
             pa.array([self.entries], pa.int64()), pa.array([links], pa.binary()),
             one(pairs.astype(np.int64), pa.list_(pa.int64())), one(n_docs, pa.list_(pa.int64()))], schema=schema)


def aligned_blocks(docs: DataFrame, paths: tuple[str, str], id_col: str, text_col: str, entries: int = ENTRIES_IN_BLOCK) -> DataFrame:
    """One row per block of documents (see the module's text); a block ends at ``entries`` (document, pair) entries."""
    longs = T.ArrayType(T.LongType())
    fields = [("block", T.LongType()), ("ids", T.ArrayType(docs.schema[id_col].dataType)), *((f, longs) for f in FIGURES),
              ("groups_sha256", T.ArrayType(T.StringType())), ("entries", T.LongType()), ("links", T.BinaryType()),
              ("pairs", longs), ("n_docs", longs)]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align_texts, block = aligner(paths).texts, _Block()
        number, arrow = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            if arrow is None:
                lists = pa.list_(pa.int64())
                kinds = [pa.int64(), pa.list_(batch.schema.field(0).type), *[lists] * 4, pa.list_(pa.string()), pa.int64(), pa.binary(), lists, lists]
                arrow = pa.schema([pa.field(f[0], k) for f, k in zip(fields, kinds, strict=True)])
            for at, texts in blocks(batch.column(1), TEXT_BYTES):
                block.add(batch.column(0).slice(at, len(texts)), *align_texts(texts))
                if block.entries >= entries or len(block.hashes) >= DOCUMENTS_IN_BLOCK:
                    yield block.row(number, arrow)
                    number, block = number + 1, _Block()
        if block.ids:
            yield block.row(number, arrow)

    return docs.select(id_col, text_col).mapInArrow(rows, schema)


def pair_counts(written: DataFrame, n_b: int) -> DataFrame:
    """(pair, n_docs, best): documents that hold a pair linked; best if that is its A id's highest."""
    per_block = written.select(F.explode(F.arrays_zip("pairs", "n_docs")).alias("p"))
    counts = per_block.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.n_docs").alias("n_docs"))
    counts = write_shared(counts.withColumn("a", F.expr(f"pair div {n_b}")), "pair-counts")
    highest = counts.groupBy("a").agg(F.max("n_docs").alias("highest"))
    return counts.join(highest, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("highest")).alias("best"))


def align(docs: DataFrame, paths: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text",
          entries: int = ENTRIES_IN_BLOCK) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum), one row per document."""
    paths = paths or default_tokenizers()
    kind = docs.schema[id_col].dataType
    written = write_shared(aligned_blocks(docs, paths, id_col, text_col, entries), "aligned")
    import sentencepiece
    counts = pair_counts(written, sentencepiece.SentencePieceProcessor(model_file=paths[1]).get_piece_size())
    asked = written.select(F.col("block").alias("asking"), F.explode("pairs").alias("pair")).join(counts, "pair").select("asking", "pair", "n_docs", "best")
    out = T.StructType([T.StructField("doc_id", kind), *[T.StructField(f, T.LongType()) for f in FIGURES],
                        T.StructField("groups_sha256", T.StringType()), T.StructField("n_best", T.LongType()),
                        T.StructField("count_sum", T.LongType())])

    def summed(block: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("pair")
        n_docs, best = np.asarray(known["n_docs"].combine_chunks()), np.asarray(known["best"].combine_chunks())
        row = {c: block[c].combine_chunks()[0] for c in block.column_names}
        n, entries = len(row["ids"].values), row["entries"].as_py()
        per_doc, step, often = _unpacked(row["links"].as_py(), [n, entries, entries])
        doc = np.repeat(np.arange(n), per_doc)
        total = np.cumsum(step)
        first = (np.cumsum(per_doc) - per_doc)[per_doc > 0]
        place = total - np.repeat(total[first] - step[first], per_doc[per_doc > 0])
        at = lambda values: pa.array(np.bincount(doc, values, n).astype(np.int64))
        sums = np.zeros(n, np.int64)
        np.add.at(sums, doc, often * n_docs[place] if len(place) else often)
        return pa.Table.from_arrays([row["ids"].values, *(row[f].values for f in FIGURES), row["groups_sha256"].values,
                                     at(often * best[place] if len(place) else often), pa.array(sums)], names=out.names)

    rows = written.select("block", "ids", *FIGURES, "groups_sha256", "entries", "links")
    return rows.groupBy("block").cogroup(asked.groupBy("asking")).applyInArrow(summed, out)
