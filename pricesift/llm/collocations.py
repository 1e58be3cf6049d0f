"""Phrases whose words occur together more often than apart, mined after Toivonen.

1. Words, the first level of every negative border, are counted exactly. Then a sample of the
   documents (one in ``sample_share``, by a hash of the row) is mined level by level, from
   two of the frequent words to phrases of four, at a support lowered by ``lowering`` so
   that few phrases of full support are missed. The phrases found are the proposal.
2. Every phrase of two to five words whose first words and whose last words (one fewer each)
   are frequent words or proposed must be counted over all documents: these are the proposed
   phrases and their negative border. A border phrase that never occurs counts zero and needs
   no row. Nearly all of the border is rare, so it is counted after Park, Chen and Yu: a pass
   adds up occurrences by 40 bits of a phrase's hash, a number of eight bytes per phrase and
   block, and the next counts by the words themselves what may reach the support by these sums.
   Phrases of equal bits add up together, so a sum is never too small.
3. Phrases that reach the support without being proposed are border failures: longer
   phrases above them may have been left out. An expansion pass counts what the first
   left out and whose parts are each known to be frequent or were left out as well. That
   closes the border at once: of a frequent phrase all parts are frequent, so each was
   either counted by then or passes for that reason, and the phrase itself is counted.

Which phrases are proposed is told to the tasks by a bit table of bounded size
(``MAX_BITS``). A wrong yes only makes a task count a phrase too many; counts are exact and
by the words themselves. Tasks add up blocks of documents before the shuffle, so a phrase
that a third of all documents hold is one row a block.

Scores compare a phrase's count with those of its two parts, for the lowest-scoring cut,
in exact decimal arithmetic. A candidate inside a longer one that is as frequent is
dropped. ``mine`` returns the first ``top`` of each language.

Defined cases: null texts are empty; a null language is ``und``; repeated rows count again;
phrases never cross a piece; an empty table gives no rows; other columns are ignored. A very
long text is counted in slabs that end at a piece's end.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_shared

LONGEST, UNKNOWN_LANG = 5, "und"
BLOCK_BYTES = 32 << 20
MIN_BITS, MAX_BITS, BITS_PER_PHRASE = 1 << 16, 1 << 27, 16
#: Piece separators become line feeds, tabs blanks.
_MARKS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
_SEPARATOR = re.compile(r"[.,;:!?\x0A-\x0D]")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
PHRASES = "lang string, phrase string, n_words int, f long"


#: A packed number holds the upper 40 bits of a phrase's hash, and in the lower 24 how often it occurs in a block.
_COUNT_BITS = 24
_COUNT_MASK = (1 << _COUNT_BITS) - 1


class BitTable:
    """A set of 64-bit hashes: never a wrong no, seldom a wrong yes."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    @staticmethod
    def places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
        """Two bit numbers for each hash."""
        return [x & np.uint64(bits - 1) for x in (hashes, (hashes >> np.uint64(32)) * _FACTOR >> np.uint64(20))]

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in self.places(hashes, len(self.words) * 64):
            found &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def _longer(head: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of its first words and that of its last."""
    x = (head ^ (head >> np.uint64(29))) * _FACTOR + word
    return x ^ (x >> np.uint64(32))


def _word_hashes(lang: str, words: list[bytes]) -> list[int]:
    seed = xxhash.xxh32_intdigest(lang.encode())
    return [xxhash.xxh64_intdigest(w, seed=seed) for w in words]


def _phrase_hashes(langs: list[str], phrases: list[str]) -> np.ndarray:
    words = [_word_hashes(lang, phrase.encode().split(b" ")) for lang, phrase in zip(langs, phrases, strict=True)]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    out = np.fromiter((w[0] for w in words), np.uint64, len(words))
    for k in range(1, LONGEST):
        more = np.flatnonzero(sizes > k)
        out[more] = _longer(out[more], np.fromiter((words[i][k] for i in more), np.uint64, len(more)))
    return out


def _summed_by(hashes: np.ndarray) -> np.ndarray:
    """The part of a hash by which occurrences are added up."""
    return hashes >> np.uint64(_COUNT_BITS)


def _spread(sums: np.ndarray) -> np.ndarray:
    """64 bits for the 40 that sums go by, as a bit table takes them."""
    return _longer(sums, np.uint64(0))


def bit_table(phrases: DataFrame) -> np.ndarray:
    """The bits of (lang, phrase) rows, or of (hash) rows as ``may_reach`` gives them, set in tasks and put together part by part;
    at most ``MAX_BITS`` reach the driver."""
    n = phrases.count()
    hashed = phrases.columns == ["hash"]
    bits = MIN_BITS
    while bits < min(MAX_BITS, n * BITS_PER_PHRASE):
        bits *= 2
    part_words = 1 << 10

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = (_spread(batch.column(0).to_numpy().view(np.uint64)) if hashed
                      else _phrase_hashes(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            at = np.unique(np.concatenate(BitTable.places(hashes, bits)))
            word = (at >> np.uint64(6)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bits"])

    def part(rows: pa.Table) -> pa.Table:
        at = rows["word"].combine_chunks().to_numpy()
        out = np.zeros(part_words, np.int64)
        out[at % part_words] = rows["bits"].combine_chunks().to_numpy()
        return pa.table({"part": pa.array([int(at[0]) // part_words], pa.int64()), "bits": pa.array([out.tobytes()], pa.binary())})

    words = (phrases.select(*(["hash"] if hashed else ["lang", "phrase"])).mapInArrow(places, "word long, bits long")
             .groupBy("word").agg(F.bit_or("bits").alias("bits")).withColumn("part", F.expr(f"word div {part_words}")))
    table = np.zeros(bits // 64, np.uint64)
    for row in words.groupBy("part").applyInArrow(part, "part long, bits binary").collect():
        found = np.frombuffer(row["bits"], np.uint64)[:len(table)]
        table[row["part"] * part_words:row["part"] * part_words + len(found)] = found
    return table


class Gate:
    """Which phrases a pass counts, by the positions of a block's words.

    A phrase counts if its first and its last words (one fewer) are in ``proposed`` and were
    counted themselves; without a table every phrase does. ``before``: the table of an
    earlier pass; what that pass counted is left out, and parts that it did not count may be
    frequent and pass. ``reach``: the table of ``may_reach``; a phrase of two words or more counts
    only if it is in there too.
    """

    def __init__(self, proposed: np.ndarray | None, sizes: tuple[int, ...] = (1, 2, 3, 4, 5), before: np.ndarray | None = None,
                 reach: np.ndarray | None = None):
        self.proposed, self.sizes, self.before, self.reach = proposed, sizes, before, reach

    def phrases(self, at: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(starts, size, hashes) of the phrases that count. ``at``: numbers of words, negative between pieces."""
        starts = np.flatnonzero(at >= 0)
        if 1 in self.sizes:
            yield starts, 1, hashes[at[starts]]
        reach = BitTable(self.reach) if self.reach is not None else None
        proposed = BitTable(self.proposed) if self.proposed is not None else None
        before = BitTable(self.before) if self.before is not None else None

        def by_start(values) -> np.ndarray:
            out = np.zeros(len(at) + 1, bool)
            out[starts] = values
            return out

        words = at[starts]
        may = by_start(proposed.has(hashes)[words] if proposed else True)  # the phrase of the last size may be frequent
        was = by_start(before.has(hashes)[words]) if before else None  # it was proposed and counted in the earlier pass
        whole = np.zeros(len(at) + 1, np.uint64)
        whole[starts] = hashes[words]
        for size in range(2, max(self.sizes) + 1):
            starts = np.flatnonzero(may[:-1] & may[1:])
            starts = starts[starts + size <= len(at)]
            old = was[starts] & was[starts + 1] if before else np.zeros(len(starts), bool)
            longer = _longer(whole[starts], hashes[at[starts + size - 1]])
            if size in self.sizes:
                new = ~old & reach.has(_spread(_summed_by(longer))) if reach else ~old
                yield starts[new], size, longer[new]
            whole[starts] = longer
            known = proposed.has(longer) if proposed else np.ones(len(starts), bool)
            may = by_start(known | ~old if before else known)
            was = by_start(old & before.has(longer)) if before else None


def distinct_runs(at: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of ``size`` numbers at ``starts``, one a row, and how often each occurs."""
    code = at[starts].astype(np.int64)
    for k in range(1, size - 1):  # numbers of distinct runs, one longer each time
        _, code = np.unique(code << 32 | at[starts + k], return_inverse=True)
    if size > 1:
        code = code << 32 | at[starts + size - 1]
    if size <= 2:  # the code itself holds the numbers
        code, n = np.unique(code, return_counts=True)
        return np.stack([code >> 32, code & 0xFFFFFFFF] if size == 2 else [code], axis=1).astype(np.int32), n
    _, first, n = np.unique(code, return_index=True, return_counts=True)
    return np.stack([at[starts[first] + k] for k in range(size)], axis=1), n


def numbered_words(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """The words of texts as numbers (-1 between pieces and texts), and the distinct words."""
    data = b"\n".join(texts).lower().translate(_MARKS).replace(b"\n", b" \n ")
    said = pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, len(data)], np.int64)), pa.py_buffer(data))
    coded = pc.split_pattern(said, " ").flatten().dictionary_encode()
    words = coded.dictionary
    number = np.arange(len(words), dtype=np.int32)
    number[np.asarray(pc.equal(words, "\n"))] = -1
    number[np.asarray(pc.equal(words, ""))] = -2
    at = number[np.asarray(coded.indices)]
    return at[at != -2], words


def hashed_words(lang: str, texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """``numbered_words`` and the hashes of the distinct words."""
    at, words = numbered_words(texts)
    return at, words, np.array(_word_hashes(lang, words.cast(pa.large_binary()).to_pylist()), np.uint64)


def sum_block(lang: str, texts: list[bytes], gate: Gate) -> Iterator[np.ndarray]:
    """Packed numbers of the phrases that ``gate`` lets through; a count above the lower bits is held at their most."""
    at, _, hashes = hashed_words(lang, texts)
    for _, _, found in gate.phrases(at, hashes):
        sums, n = np.unique(_summed_by(found), return_counts=True)
        yield sums << np.uint64(_COUNT_BITS) | np.minimum(n, _COUNT_MASK).astype(np.uint64)


def count_block(lang: str, texts: list[bytes], gate: Gate) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(phrases, counts) of texts of one language, of the phrases that ``gate`` lets through;
    where words count, an empty phrase has the number of all words."""
    at, words, hashes = hashed_words(lang, texts)
    for starts, size, _ in gate.phrases(at, hashes):
        if size == 1:
            yield pa.array([""], pa.large_string()), np.array([len(starts)])
        if len(starts):
            rows, n = distinct_runs(at, starts, size)
            for k in range(0, len(n), 200_000):
                parts = [words.take(pa.array(part)) for part in rows[k:k + 200_000].T]
                yield (pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if size > 1 else parts[0]), n[k:k + 200_000]


def _slabs(text: str, size: int) -> Iterator[bytes]:
    """A text in parts of at least ``size`` that end at a piece's end."""
    at = 0
    while len(text) - at > size and (cut := _SEPARATOR.search(text, at + size)):
        yield text[at:cut.end()].encode("utf-8", "surrogatepass")
        at = cut.end()
    yield text[at:].encode("utf-8", "surrogatepass")


def _by_block(docs: DataFrame, lang_col: str, text_col: str, block, schema: str) -> DataFrame:
    """The batches that ``block`` (lang, texts) gives for blocks of the documents of one language."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = defaultdict(list), 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for part in _slabs(text.as_py() or "", BLOCK_BYTES):
                    held[lang].append(part)
                    size += len(part)
                    if size >= BLOCK_BYTES:
                        for held_lang, texts in held.items():
                            yield from block(held_lang, texts)
                        held.clear()
                        size = 0
        for lang, texts in held.items():
            yield from block(lang, texts)

    said = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN_LANG)).alias("lang"), F.col(text_col).alias("text"))
    return said.mapInArrow(rows, schema)


def may_reach(docs: DataFrame, gate: Gate, at_least: int, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(hash): the bits that sums go by of all phrases that ``gate`` lets through and that occur ``at_least`` times in
    ``docs``, and of some that occur less."""
    shared = docs.sparkSession.sparkContext.broadcast(gate)  # bit tables of at most MAX_BITS each

    def block(lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        for packed in sum_block(lang, texts, shared.value):
            yield pa.RecordBatch.from_arrays([pa.array(packed.view(np.int64))], names=["packed"])

    # The packed number alone is moved; it is taken apart behind the shuffle.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = F.shiftrightunsigned("packed", _COUNT_BITS)
    packed = _by_block(docs, lang_col, text_col, block, "packed long").repartition(n, bits)
    sums = packed.select(bits.alias("hash"), F.col("packed").bitwiseAND(F.lit(_COUNT_MASK)).alias("n")).groupBy("hash").agg(F.sum("n").alias("n"))
    return sums.where(F.col("n") >= min(at_least, _COUNT_MASK)).select("hash")


def counted(docs: DataFrame, gate: Gate, at_least: int, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, phrase, n_words, f) of the phrases that ``gate`` lets through and that occur ``at_least`` times in
    ``docs``; where words count also an empty phrase per language with the number of all words."""
    shared = docs.sparkSession.sparkContext.broadcast(gate)  # bit tables of at most MAX_BITS each

    def block(lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        for phrases, n in count_block(lang, texts, shared.value):
            key = pc.binary_join_element_wise(phrases, pa.scalar(lang, pa.large_string()), pa.scalar("\n", pa.large_string()))
            yield pa.RecordBatch.from_arrays([key.cast(pa.string()), pa.array(n)], names=["key", "f"])

    # Blocks are counted already, so a map-side sum would hold them in memory again for little; it follows the shuffle.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = _by_block(docs, lang_col, text_col, block, "key string, f long")
    sums = keyed.repartition(n, "key").groupBy("key").agg(F.sum("f").alias("f"))
    phrase = F.substring_index("key", "\n", 1)  # neither pieces nor words hold a line feed
    kept = sums.where((F.col("f") >= at_least) | F.col("key").startswith("\n"))
    return kept.select(F.expr("substring(key, instr(key, '\n') + 1)").alias("lang"), phrase.alias("phrase"),
                       F.when(phrase == "", 0).otherwise(F.size(F.split(phrase, " "))).alias("n_words"), "f")


def failures(frequent: DataFrame, proposed: np.ndarray) -> DataFrame:
    """Frequent phrases that were not proposed and could be part of a longer one."""
    shared = frequent.sparkSession.sparkContext.broadcast(proposed)  # MAX_BITS at most

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = BitTable(shared.value).has(_phrase_hashes(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            yield batch.filter(pa.array(~known))

    return frequent.where(F.col("n_words") < LONGEST).select("lang", "phrase", "n_words", "f").mapInArrow(rows, PHRASES)


def frequent_phrases(docs: DataFrame, support: int = 100, sample_share: int = 8, lowering: float = 0.4,
                     lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame, int]:
    """(lang, phrase, n_words, f) with f >= support, complete and exact; (lang, n) of all words; the number of full passes over phrases."""
    row = F.xxhash64(F.col(lang_col), F.col(text_col), F.monotonically_increasing_id())
    sample, low = docs.where(F.pmod(row, F.lit(sample_share)) == 0), max(2, round(support / sample_share * lowering))
    words = write_shared(counted(docs, Gate(None, (1,)), support, lang_col, text_col), "words")
    totals, words = words.where("n_words = 0").select("lang", F.col("f").alias("n")), words.where("n_words = 1")
    known = words
    for size in range(2, LONGEST):
        found = counted(sample, Gate(bit_table(known), (size,)), low, lang_col, text_col)
        known = known.unionByName(write_shared(found, f"sample-{size}"))
    proposed, sizes = bit_table(known), tuple(range(2, LONGEST + 1))
    reach = bit_table(write_shared(may_reach(docs, Gate(proposed, sizes), support, lang_col, text_col), "sums"))
    phrases = write_shared(counted(docs, Gate(proposed, sizes, reach=reach), support, lang_col, text_col), "phrases")
    frequent = words.unionByName(phrases)
    if failures(phrases, proposed).isEmpty():
        return frequent, totals, 1
    missed = counted(docs, Gate(bit_table(frequent), sizes, before=proposed), support, lang_col, text_col)
    return frequent.unionByName(write_shared(missed, "expansion")), totals, 2


def scored(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of phrases of two words or more, for the lowest-scoring cut."""
    words = F.split("phrase", " ")
    cuts = (frequent.where("n_words >= 2").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)))
            .select("lang", "phrase", F.col("f").alias("a"), "k", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("head"),
                    F.array_join(F.slice(words, F.col("k") + 1, F.col("n_words")), " ").alias("rest")))
    part = frequent.select("lang", "phrase", "f")
    cuts = (cuts.join(part.toDF("lang", "head", "l"), ["lang", "head"]).join(part.toDF("lang", "rest", "r"), ["lang", "rest"])
            .join(totals, "lang"))
    score = F.expr("(cast(1000 * a as decimal(18, 0)) * cast(n as decimal(19, 0))) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("c"))
    return lowest.select("lang", "phrase", "c.a", "c.l", "c.r", "c.n", "c.score")


def inside_longer(frequent: DataFrame) -> DataFrame:
    """(lang, phrase) of phrases inside a longer frequent one of the same count. One word more is enough:
    what lies between a phrase and a longer one counts no less than the longer."""
    words, most = F.split("phrase", " "), F.col("n_words") - 1
    parts = F.array(F.array_join(F.slice(words, F.lit(1), most), " "), F.array_join(F.slice(words, F.lit(2), most), " "))
    longer = frequent.where("n_words >= 3").select("lang", F.explode(parts).alias("phrase"), F.col("f").alias("longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return frequent.join(longer, ["lang", "phrase"]).where("100 * longer >= 100 * f").select("lang", "phrase")


def mine(docs: DataFrame, support: int = 100, top: int = 2000, lang_col: str = "lang", text_col: str = "text", **sampling) -> DataFrame:
    """Each language's first ``top`` phrases: (lang, rank, phrase, a, l, r, n, score)."""
    frequent, totals, _ = frequent_phrases(docs, support, lang_col=lang_col, text_col=text_col, **sampling)
    kept = scored(frequent, totals).join(inside_longer(frequent), ["lang", "phrase"], "left_anti")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
