"""Product matching: feature similarity (F10/F11), product ranking (T3),
duplicate tests (J7), near-duplicate grouping (J5) and similar-product groups (J6).

Near-duplicate grouping at scale
--------------------------------
1. Exact copies are one node: nodes are distinct (query, name, price).
2. Offers of one name form maximal runs of close prices (segments); segments of
   similar names link where their price intervals touch, without offer pairs.
3. Names are compared, never offers. A pair passes with a token-sort ratio of 63 when
   the other ratios are high, so names that share no word, or differ in half of their
   characters, may still be alike: no word or prefix key can rule a pair out without
   losing links. But a component needs a spanning forest only: names are compared where
   segments touch that are not joined yet, once for all queries that meet in a cell of
   bounded size, and no pair of names is ever moved.
4. Forests of the cells are joined by star contraction (``operators.components``).
   ``mode="components"`` groups by the components: the scale form.
5. ``mode="greedy"`` replays the reference's order-dependent first-fit grouping inside
   each component, exactly and without any cap. The replay is sequential by
   definition, so a component is one task's work: an operator for parity checks.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fuzz
from ..functions.features import feature_scores, product_features
from ..functions.text import (ascii_words, clean_text, name_parts, partial_ratio_udf, ratio_udf, similarity_of_parts,
                              token_sort_key, token_sort_ratio_udf)
from ..session import write_shared
from ..settings import DEFAULT, Settings
from .components import connected_components
from .normalize import stage
from .rank import row_number_by_range

BLOCK_NAMES = 256  # names of one block of a key's vocabulary
SET_ROWS = 50_000  # segments of a set of queries whose names are compared together, about
LINK_NAMES = 6144  # names of one block of a set's names
LINK_ROWS = 1 << 20  # segments of a set's share of queries
PAIRS_AT_ONCE = 1 << 21  # touching segments listed at once
NEW_AT_ONCE = 1 << 14  # of their name pairs, those compared before what is joined is looked at again
FIRST_COMPARED = 1 << 8  # the same, at first: a few links join most of what is alike
NEIGHBOURS = 8  # intervals next to one that are looked at first


def spread(df: DataFrame) -> DataFrame:
    """Round-robin over the shuffle partitions before a Python UDF.

    A distinct set of short strings is small in bytes, so AQE would coalesce it
    into a few tasks and the UDF would run on a few cores; an explicit partition
    count is kept by AQE.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def feature_score(f1: Column, f2: Column, fuzzy: Column, relevance: Column, settings: Settings = DEFAULT) -> Column:
    """F10 from two feature structs: .3 fuzzy + .25 brand + .2 model + .1 storage + .05 colour + .1 query relevance."""
    w, sc = settings.weights, feature_scores(f1, f2)
    model = F.when(f1["model"].isNull() | f2["model"].isNull(), F.lit(0.5)) \
        .otherwise(ratio_udf(F.lower(f1["model"]), F.lower(f2["model"])) / 100.0)
    return (fuzzy * w["fuzzy"] + sc["brand"] * w["brand"] + model * w["model"] + sc["storage"] * w["storage"]
            + sc["color"] * w["color"] + relevance * w["query_relevance"])


def feature_similarity(p1: Column, p2: Column, query: Column, settings: Settings = DEFAULT) -> Column:
    """F10 + F11 of two name columns in the context of a query."""
    fuzzy = token_sort_ratio_udf(F.lower(p1), F.lower(p2)) / 100.0
    lq = F.lower(query)
    rel = F.when(F.coalesce(F.length(query), F.lit(0)) == 0, F.lit(0.5)).otherwise(
        (partial_ratio_udf(lq, F.lower(p1)) / 100.0 + partial_ratio_udf(lq, F.lower(p2)) / 100.0) / 2.0)
    return feature_score(product_features(p1, query), product_features(p2, query), fuzzy, rel, settings)


def with_features(names: DataFrame, name: str) -> DataFrame:
    """Adds ``f`` (F8), ``k`` (token-sort key) and ``n`` (its length): computed once per name, not per pair."""
    k = token_sort_key(F.lower(F.col(name)))
    return stage(stage(names, "f", product_features(F.col(name))), "k", k).withColumn("n", F.length("k"))


def product_score(a: str, b: str, settings: Settings = DEFAULT) -> Column:
    """F10 without a query of the two sides ``f_a, k_a`` and ``f_b, k_b`` of a pair."""
    return feature_score(F.col(f"f{a}"), F.col(f"f{b}"), ratio_udf(f"k{a}", f"k{b}") / 100.0, F.lit(0.5), settings)


def rank_products(df: DataFrame, key: str, name: str, query: str) -> DataFrame:
    """relevance = partial ratio of the query against the name; rank desc, stable on name."""
    rel = partial_ratio_udf(F.lower(F.col(query)), F.lower(F.col(name))) / 100.0
    r = df.select(key, name, rel.alias("relevance"))
    return row_number_by_range(r, key, [F.col("relevance").desc(), F.col(name)]).select(key, name, "relevance", "rank")


def is_duplicate(sim: Column, p1: Column, p2: Column, settings: Settings = DEFAULT) -> Column:
    """Similarity >= .85, or >= .90 when both prices are positive and differ by > 15%."""
    both = (p1 > 0) & (p2 > 0)
    far = both & (F.abs(p1 - p2) / F.greatest(p1, p2) > settings.is_duplicate_price_variance)
    thr = F.when(far, settings.is_duplicate_threshold + 0.05).otherwise(settings.is_duplicate_threshold)
    return sim >= thr


def duplicate_pairs(products: DataFrame, key: str, name: str, price: str, settings: Settings = DEFAULT) -> DataFrame:
    """J7 over all name pairs of a key: (key, name_a, price_a, name_b, price_b, similarity) of the duplicates.

    A score of 0.85 (F10 without a query) needs two known, equal brands: an unknown one
    already costs 0.125 and a second loss follows from the query term. So the pairs are
    joined on (key, brand), and a lossless length bound follows from a token-sort ratio
    of at least 66.
    """
    v = with_features(products.select(key, F.col(name).alias("name"), F.col(price).alias("price")), "name")
    v = v.filter(F.col("f.brand").isNotNull()).withColumn("_key", F.struct(F.col(key), F.col("f.brand").alias("brand")))
    v = write_shared(v, "branded-names")
    la, lb = F.col("n_a"), F.col("n_b")
    p = (vocabulary_pairs(v, "_key", "name", ["price", "n", "f", "k"])
         .filter((F.least(la, lb) * 2 >= (la + lb) * 0.655) | ((la == 0) & (lb == 0))))
    scored = p.withColumn(key, F.col("_key")[key]).withColumn("similarity", product_score("_a", "_b", settings))
    return (scored.select(key, "name_a", "price_a", "name_b", "price_b", "similarity")
            .filter(is_duplicate(F.col("similarity"), F.col("price_a"), F.col("price_b"), settings)))


# --- duplicate edges -------------------------------------------------------------------
def _nodes(offers: DataFrame) -> DataFrame:
    """Distinct (query_id, name, price): exact copies are one node."""
    return offers.select("query_id", "product_name", "norm_price").distinct()


def vocabulary_pairs(vocabulary: DataFrame, key: str, name: str, extra: list[str] | None = None) -> DataFrame:
    """(key, name_a, name_b, extra_a, extra_b) of all name pairs a < b of a key of a written vocabulary.

    A key's names lie in as many blocks as its vocabulary fills, and each block meets all
    of them; a key of up to ``BLOCK_NAMES`` names is one block, whose names are not repeated.
    Both sides are dealt over an explicit count of partitions, which AQE keeps although the
    names are small in bytes, so a Python UDF on the pairs runs on every core.
    """
    extra = extra or []
    n = int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = vocabulary.groupBy(key).agg(F.ceil(F.count("*") / BLOCK_NAMES).alias("_blocks"))
    v = vocabulary.join(blocks, key)
    a = v.select(key, F.pmod(F.xxhash64(name), F.col("_blocks")).alias("_block"), F.col(name).alias("name_a"),
                 *[F.col(c).alias(f"{c}_a") for c in extra])
    b = v.select(key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)).alias("_block"),
                 F.col(name).alias("name_b"), *[F.col(c).alias(f"{c}_b") for c in extra])
    a, b = a.repartition(n, key, "_block"), b.repartition(n, key, "_block")
    return a.join(b, [key, "_block"]).filter(F.col("name_a") < F.col("name_b")).drop("_block")


def similar_names(offers: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Pairs of distinct names of the same query with name similarity above the threshold.

    Works on the name vocabulary of each query, never on offers. A lossless
    length bound on the token-sorted names (token-sort ratio >= 63 is needed)
    prunes pairs before the kernel.
    """
    v = stage(offers.select("query_id", "product_name").distinct(), "parts", name_parts("product_name"))
    v = write_shared(v.withColumn("n", F.length("parts.key")), "vocabulary")
    la, lb = F.col("n_a"), F.col("n_b")
    p = (vocabulary_pairs(v, "query_id", "product_name", ["n", "parts"])
         .filter(((la == 0) & (lb == 0)) | (F.least(la, lb) * 2 >= (la + lb) * 0.625)))
    floor = settings.duplicate_threshold
    scored = p.select("query_id", "name_a", "name_b",
                      similarity_of_parts(F.col("parts_a"), F.col("parts_b"), floor).alias("name_sim"))
    return scored.filter(F.col("name_sim") > floor)


def _close(p1: Column, p2: Column, settings: Settings) -> Column:
    return 1.0 - F.abs(p1 - p2) / F.greatest(p1, p2) > 1.0 - settings.price_variance_threshold


def chain_edges(offers: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Same-name edges: each price node to the next higher price of the same name when close."""
    w = Window.partitionBy("query_id", "product_name").orderBy("norm_price")
    return (_nodes(offers).withColumn("next_price", F.lead("norm_price").over(w))
            .filter(F.col("next_price").isNotNull() & _close(F.col("norm_price"), F.col("next_price"), settings)
                    & self_similar("product_name"))
            .select("query_id", F.col("product_name").alias("name_a"), F.col("norm_price").alias("price_a"),
                    F.col("product_name").alias("name_b"), F.col("next_price").alias("price_b")))


# --- greedy replay ---------------------------------------------------------------------
_GREEDY_OUT = T.StructType([
    T.StructField("offer_key", T.StringType()),
    T.StructField("group_no", T.LongType()),
])


def first_fit(names, prices, similar_to: dict, settings: Settings) -> list[int]:
    """Group numbers of offers in arrival order.

    A row joins the earliest group holding a member with a similar name and a close price. Groups are indexed by
    name -> sorted prices, so a row checks only groups that hold a similar name, and only the nearest price on each
    side (price similarity falls away from the price).
    """
    pv = settings.price_variance_threshold

    def close(a: float, b: float) -> bool:
        return 1.0 - abs(a - b) / max(a, b) > 1.0 - pv

    name_groups: dict = {}  # name -> ascending group ids holding it
    held: dict = {}         # (group, name) -> sorted prices
    n_groups = 0
    out = []
    for name, price in zip(names, prices, strict=True):
        similar = [nm for nm in similar_to.get(name, ()) if nm in name_groups]
        placed = -1
        for g in sorted({g for nm in similar for g in name_groups[nm]}):
            for nm in similar:
                ps = held.get((g, nm))
                if not ps:
                    continue
                i = bisect.bisect_left(ps, price)
                if (i < len(ps) and close(price, ps[i])) or (i > 0 and close(price, ps[i - 1])):
                    placed = g
                    break
            if placed >= 0:
                break
        if placed < 0:
            placed = n_groups
            n_groups += 1
        groups_of = name_groups.setdefault(name, [])
        if not groups_of or groups_of[-1] != placed:
            at = bisect.bisect_left(groups_of, placed)
            if at == len(groups_of) or groups_of[at] != placed:
                groups_of.insert(at, placed)
        bisect.insort(held.setdefault((placed, name), []), price)
        out.append(placed)
    return out


def _greedy_fn(settings: Settings):
    """First-fit replay of one component, in arrival order.

    Name similarity comes in as the component's precomputed pairs (plus self-similarity per name).
    """
    def fn(pdf: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame({"offer_key": pd.Series([], dtype=object), "group_no": pd.Series([], dtype="int64")})
        pdf = pdf.sort_values([c for c in pdf.columns if c.startswith("_arr")], kind="stable")
        similar_to: dict[str, set[str]] = {}
        for a, b in zip(pairs["name_a"], pairs["name_b"]):
            similar_to.setdefault(a, set()).add(b)
            similar_to.setdefault(b, set()).add(a)
        for nm, ok in zip(pdf["product_name"], pdf["_self"]):
            if ok:
                similar_to.setdefault(nm, set()).add(nm)
        return pd.DataFrame({"offer_key": pdf["offer_key"], "group_no": first_fit(pdf["product_name"], pdf["norm_price"], similar_to, settings)})
    return fn


def self_similar(name: str) -> Column:
    """A name is a duplicate of itself unless it has no ASCII word character
    (then the token-set part of the similarity is 0 and the score stays 0.6)."""
    return F.length(ascii_words(clean_text(F.col(name)))) > 0


def chain_segments(offers: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Same-name runs of close prices: (query_id, product_name, norm_price) -> seg.

    The segment's key holds the query, the run's number and the name itself.

    A running sum of "gap" flags along each name's sorted prices numbers the
    runs, so every same-name chain collapses to one segment without iteration.
    """
    n = _nodes(offers)
    w = Window.partitionBy("query_id", "product_name").orderBy("norm_price")
    prev = F.lag("norm_price").over(w)
    gap = F.when(prev.isNull() | ~_close(prev, F.col("norm_price"), settings) | ~self_similar("product_name"), 1) \
        .otherwise(0)
    seg_no = F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (n.withColumn("gap", gap).withColumn("seg_no", seg_no)
            .withColumn("seg", F.concat_ws("|", F.col("query_id").cast("string"), F.col("seg_no").cast("string"), "product_name"))
            .select("query_id", "product_name", "norm_price", "seg"))


_LINKS = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("whole", T.BooleanType())])


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of ``a`` and ``b``; a set's label is its smallest member."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def _reach(hi: np.ndarray, settings: Settings) -> np.ndarray:
    """The highest price that may be close to ``hi``, a little too high: pairs are tested by ``_near``."""
    return np.where(hi > 0, hi / (1.0 - settings.price_variance_threshold) * (1 + 1e-9), hi)


def _near(p: np.ndarray, q: np.ndarray, settings: Settings) -> np.ndarray:
    """Whether intervals touch: ``p`` is the end of the one that begins first, ``q`` the begin of the other."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return (q <= p) | (1.0 - np.abs(p - q) / np.maximum(p, q) > 1.0 - settings.price_variance_threshold)


def _touching(lo: np.ndarray, hi: np.ndarray, settings: Settings, label: np.ndarray | None = None):
    """Pairs i < j of intervals sorted by ``lo`` that overlap or whose ends are close, in bounded batches;
    with ``label``, of intervals that are not joined by then only."""
    n = len(lo)
    ends = np.searchsorted(lo, _reach(hi, settings), side="right")
    counts = np.maximum(ends - np.arange(n) - 1, 0)
    upto = np.concatenate(([0], np.cumsum(counts)))
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS_AT_ONCE, side="right")) - 1)
        i = np.repeat(np.arange(at, to), counts[at:to])
        j = i + 1 + np.arange(len(i)) - np.repeat(upto[at:to] - upto[at], counts[at:to])
        if label is not None:
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
        near = _near(hi[i], lo[j], settings)
        yield i[near], j[near]
        at = to


class _Compared:
    """Names that are compared in pairs, each pair once (as long as there are few names, or within one call)."""

    def __init__(self, table: fuzz.Names, empty: np.ndarray, floor: float, keep: bool):
        self.table, self.floor, self.n = table, floor, len(empty)
        self.empty = empty
        self.known = np.zeros(self.n * self.n, np.int8) if keep else None  # 1 similar, -1 not, 0 not compared yet

    def join(self, label: np.ndarray, i: np.ndarray, j: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        """Joins ``i`` and ``j`` where the names ``x`` and ``y`` are similar; pairs that are joined by then are not compared."""
        x, y = np.minimum(x, y), np.maximum(x, y)
        codes, keep, at = x * self.n + y, ~(self.empty[x] | self.empty[y]), FIRST_COMPARED
        while True:
            if self.known is not None:
                seen = self.known[codes]
                _merge(label, i[keep & (seen > 0)], j[keep & (seen > 0)])
                keep &= seen == 0
            keep &= label[i] != label[j]
            i, j, codes = i[keep], j[keep], codes[keep]
            if not len(i):
                return
            new = np.unique(codes[:at])
            at = min(4 * at, NEW_AT_ONCE)
            same = self.table.similar(new // self.n, new % self.n, self.floor)
            if self.known is not None:
                self.known[new] = np.where(same, 1, -1)
                keep = np.ones(len(i), bool)
            else:
                place = np.minimum(np.searchsorted(new, codes), len(new) - 1)
                told = new[place] == codes
                _merge(label, i[told & same[place]], j[told & same[place]])
                keep = ~told


    def pairs(self, lo: np.ndarray, hi: np.ndarray, name: np.ndarray, settings: Settings) -> list[tuple[int, int]]:
        """The similar pairs among the names of intervals (sorted by ``lo``) that touch, each once."""
        found, done = [], np.zeros(0, np.int64)
        for i, j in _touching(lo, hi, settings):
            x, y = np.minimum(name[i], name[j]), np.maximum(name[i], name[j])
            new = np.setdiff1d((x * self.n + y)[(x != y) & ~(self.empty[x] | self.empty[y])], done)
            done = np.union1d(done, new)
            found.append(new[self.table.similar(new // self.n, new % self.n, self.floor)])
        codes = np.concatenate(found) if found else done
        return list(zip((codes // self.n).tolist(), (codes % self.n).tolist(), strict=True))


def _forest(label: np.ndarray, lo: np.ndarray, hi: np.ndarray, name: np.ndarray, compared: _Compared, settings: Settings,
            block: np.ndarray | None = None) -> None:
    """Joins the intervals (sorted by ``lo``) of similar names that touch; with ``block``, of names of two blocks only."""
    def join(i, j):
        x, y = name[i], name[j]
        meet = x != y if block is None else block[x] != block[y]
        compared.join(label, i[meet], j[meet], x[meet], y[meet])

    for gap in range(1, min(NEIGHBOURS, len(lo) - 1) + 1):  # neighbours first: most of what is alike is joined by them
        i = np.arange(len(lo) - gap)
        i = i[_near(hi[i], lo[i + gap], settings)]
        join(i, i + gap)
    for i, j in _touching(lo, hi, settings, label):
        join(i, j)


def _link_cell(settings: Settings):
    """A spanning forest, per query, of the touching segments of similar names of one cell.

    Pairs of names are compared once for all queries of the cell, and only while
    segments of theirs that touch are not joined yet.
    """
    floor = settings.duplicate_threshold

    def fn(segs: pa.Table, names: pa.Table) -> pa.Table:
        out_a, out_b = [], []
        if segs.num_rows and names.num_rows:
            order = np.lexsort((segs["lo"].to_numpy(), segs["query_id"].to_numpy()))
            segs = segs.take(pa.array(order))
            queries, lo, hi = (segs[c].to_numpy() for c in ("query_id", "lo", "hi"))
            coded = pc.index_in(segs["product_name"], value_set=names["product_name"].combine_chunks())
            name, block = coded.to_numpy().astype(np.int64), names["block"].to_numpy()
            table = fuzz.Names(names["clean"].to_pylist(), names["key"].to_pylist(), names["tokens"].to_pylist())
            empty = names["empty"].to_numpy(zero_copy_only=False)
            compared = _Compared(table, names["empty"].to_numpy(zero_copy_only=False), floor, keep=True)
            across = len(np.unique(block)) > 1  # pairs inside a block are another cell's
            starts = np.flatnonzero(np.concatenate(([True], queries[1:] != queries[:-1])))
            for at, to in zip(starts, [*starts[1:], len(queries)], strict=True):
                label = np.arange(to - at)
                _forest(label, lo[at:to], hi[at:to], name[at:to], compared, settings, block if across else None)
                tied = np.flatnonzero(label != np.arange(to - at))
                out_a.append(tied + at)
                out_b.append(label[tied] + at)
        if not out_a:
            return pa.table({"a": pa.array([], pa.string()), "b": pa.array([], pa.string()), "whole": pa.array([], pa.bool_())})
        a, b = (segs["seg"].take(pa.array(np.concatenate(x))) for x in (out_a, out_b))
        whole = segs["blocks"].take(pa.array(np.concatenate(out_a))).to_numpy() == 1
        return pa.table({"a": a, "b": b, "whole": pa.array(whole)})
    return fn


def segment_labels(segs: DataFrame, settings: Settings = DEFAULT, names: int = LINK_NAMES, rows: int = LINK_ROWS) -> DataFrame:
    """(node, root): the component of each segment that touches another one of a similar name in its query.

    Queries that share their smallest name hash mostly share their names, too, and lie in
    one set, whose names are compared once for all of them. A set of more than ``rows`` segments is dealt
    by query, and one of more than ``names`` names by blocks of names that meet pairwise in
    cells, so a cell is bounded, whatever a query finds. A cell yields a forest; those of
    cells that hold all names of their queries are components already, others are joined.
    """
    iv = segs.groupBy("query_id", "product_name", "seg").agg(F.min("norm_price").alias("lo"), F.max("norm_price").alias("hi"))
    return interval_labels(iv.where("product_name IS NOT NULL AND lo IS NOT NULL"), settings, names, rows)


def interval_labels(iv: DataFrame, settings: Settings = DEFAULT, names: int = LINK_NAMES, rows: int = LINK_ROWS) -> DataFrame:
    """``segment_labels`` of segments (query_id, product_name, seg, lo, hi)."""
    n = int(iv.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    iv = write_shared(iv, "intervals")
    sets = max(4 * n, math.ceil(iv.count() / SET_ROWS))
    first = iv.groupBy("query_id").agg(F.pmod(F.min(F.xxhash64("product_name")), F.lit(sets)).alias("set"), F.count("*").alias("n"))
    deals = first.groupBy("set").agg(F.ceil(F.sum("n") / rows).alias("deals"))
    of_query = first.join(deals, "set").select("query_id", "set", F.pmod(F.xxhash64("query_id"), F.col("deals")).alias("deal"))
    iv = write_shared(iv.join(of_query, "query_id"), "dealt-intervals")
    held = iv.select("set", "deal", "product_name").distinct()
    blocks = held.groupBy("set", "deal").agg(F.ceil(F.count("*") / names).alias("blocks"))
    vocabulary = stage(spread(held.select("product_name").distinct()), "parts", name_parts("product_name"))
    vocabulary = vocabulary.select("product_name", "parts.clean", "parts.key", "parts.tokens", "parts.empty")
    texts = write_shared(held.join(vocabulary, "product_name").join(blocks, ["set", "deal"]), "set-names")
    keys = ["set", "deal", "cell"]

    def celled(df: DataFrame) -> DataFrame:
        """Each row once per cell that its block has part in; an explicit count is kept by AQE."""
        block, other = F.col("block"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
        met = df.withColumn("block", F.pmod(F.xxhash64("product_name"), F.col("blocks"))).withColumn("other", other)
        met = met.withColumn("cell", F.least(block, "other") * F.col("blocks") + F.greatest(block, "other")).drop("other")
        return met.repartition(2 * n, *keys)

    cells = celled(iv.join(texts.groupBy("set", "deal").agg(F.max("blocks").alias("blocks")), ["set", "deal"])).groupBy(*keys)
    links = write_shared(cells.cogroup(celled(texts).groupBy(*keys)).applyInArrow(_link_cell(settings), _LINKS), "links")
    joined = connected_components(links.where("NOT whole").select("a", "b"))
    return joined.unionByName(links.where("whole").select(F.col("a").alias("node"), F.col("b").alias("root")))


def dedup_groups(offers: DataFrame, arrival: list[str], mode: str = "greedy",
                 settings: Settings = DEFAULT, of_names: DataFrame | None = None) -> DataFrame:
    """Adds ``dup_group`` (a struct key) to every offer.

    ``mode="components"`` groups by connected component; ``"greedy"`` replays the
    reference's first-fit grouping inside each component. ``of_names`` holds columns per
    (query_id, product_name) that the offers get with their group: all that is known of a
    node is gathered on the nodes, and the offers themselves are joined once.
    """
    segs = write_shared(chain_segments(offers, settings), "segments")
    labels = segment_labels(segs, settings)
    node = ["query_id", "product_name", "norm_price"]
    own = (segs.join(labels.withColumnRenamed("node", "seg"), "seg", "left")
           .withColumn("component", F.coalesce("root", "seg")).drop("root", "seg"))
    if of_names is not None:
        own = own.join(of_names, ["query_id", "product_name"])
    if mode == "components":
        return offers.join(own, node).withColumn("dup_group", F.struct(F.col("component"), F.lit(0).cast("bigint").alias("group_no")))
    # A segment without cross-name edges holds one name whose close prices chain
    # together, and the greedy run still needs the order there, so every
    # component with more than one offer is replayed; single offers are groups.
    own = write_shared(own.join(offers.groupBy(*node).agg(F.count("*").alias("_n")), node), "nodes")
    sizes = own.groupBy("component").agg(F.sum("_n").alias("_size"))
    o = write_shared(offers.join(own.drop("_n").join(sizes, "component"), node), "components")  # read by three branches below
    alone = o.filter(F.col("_size") == 1).withColumn("group_no", F.lit(0).cast("bigint"))
    multi = o.filter(F.col("_size") > 1).withColumn("offer_key", F.to_json(F.struct(*arrival)))
    arr = [F.col(c).alias(f"_arr{i}") for i, c in enumerate(arrival)]
    rows = multi.select("component", "offer_key", *arr, "product_name", "norm_price",
                        self_similar("product_name").alias("_self"))
    comp_of = multi.select("query_id", F.col("product_name").alias("name_a"),
                           F.col("component").alias("comp_p")).distinct()
    pairs = similar_names(offers, settings).join(comp_of, ["query_id", "name_a"]).select(F.col("comp_p").alias("component"), "name_a", "name_b")
    g = (rows.groupBy("component").cogroup(pairs.groupBy("component"))
         .applyInPandas(_greedy_fn(settings), _GREEDY_OUT))
    replayed = multi.join(g, "offer_key").drop("offer_key")
    return (alone.unionByName(replayed)
            .withColumn("dup_group", F.struct(F.col("component"), F.col("group_no")))
            .drop("_size", "group_no"))


# --- similar-product groups (J6) ----------------------------------------------------------
_LEADER_OUT = T.StructType([T.StructField("item", T.StringType()), T.StructField("leader", T.StringType())])


def _leaders(names: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """First-fit leaders of one component's names, in order of first arrival."""
    near: dict[str, list[str]] = {}
    for a, b in zip(edges["name_a"], edges["name_b"], strict=True):
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    leader: dict[str, str] = {}
    for n in names.sort_values("order", kind="stable")["name"]:
        if n not in leader:
            leader[n] = n
            for m in near.get(n, ()):
                leader.setdefault(m, n)
    return pd.DataFrame({"item": list(leader), "leader": list(leader.values())})


def group_similar(items: DataFrame, key: str, name: str, arrival: list[str],
                  settings: Settings = DEFAULT) -> DataFrame:
    """First-fit groups whose members score >= 0.8 (F10, no query) against the group leader.

    A row's leader depends on its name and on the order in which names first arrive:
    no name scores higher against another than against itself, so a name that reaches
    the threshold with any other also reaches it with itself, and all its rows follow
    its first one. Names are therefore grouped once, per component of the graph of
    similar names, and joined back; a name below the threshold against itself has no
    similar names, and each of its rows leads its own group.

    F10 >= 0.8 needs equal or unknown brands and a token-sort ratio of at least 34,
    which gives a lossless length bound; both prune pairs before the kernel.
    ``leader_key`` is the leader's arrival key as JSON.
    """
    arr = F.struct(*[F.col(c) for c in arrival])
    v = write_shared(with_features(items.groupBy(key, name).agg(F.min(arr).alias("first")), name), "names")
    la, lb = F.col("n_a"), F.col("n_b")
    ba, bb = F.col("f_a.brand"), F.col("f_b.brand")
    p = (vocabulary_pairs(v, key, name, ["n", "f", "k"])
         .filter(ba.isNull() | bb.isNull() | (ba == bb))
         .filter((F.least(la, lb) * 2 >= (la + lb) * 0.33) | ((la == 0) & (lb == 0))))
    scored = p.select(key, "name_a", "name_b", product_score("_a", "_b", settings).alias("s"))
    good = write_shared(scored.filter(F.col("s") >= settings.group_threshold), "similar-products")

    def node(col: str):
        return F.concat_ws("|", F.col(key).cast("string"), col)

    labels = connected_components(good.select(node("name_a").alias("a"), node("name_b").alias("b")))
    rows = (v.withColumn("node", node(name)).join(labels, "node")
            .select("root", F.col("node").alias("name"), "first"))
    # Arrival as a rank inside the component is enough for the replay.
    rows = rows.select(F.col("root").alias("comp"), "name",
                       F.row_number().over(Window.partitionBy("root").orderBy("first", "name")).alias("order"))
    edges = (good.select(node("name_a").alias("name_a"), node("name_b").alias("name_b"))
             .join(labels.withColumnRenamed("node", "name_a"), "name_a").select(F.col("root").alias("comp_e"), "name_a", "name_b"))
    led = (rows.groupBy("comp").cogroup(edges.groupBy("comp_e")).applyInPandas(_leaders, _LEADER_OUT))
    firsts = v.select(node(name).alias("leader"), F.col("first").alias("_leader_first"))
    led = led.join(firsts, "leader").select(F.col("item").alias("_node"), "_leader_first")
    alone = product_score("", "", settings) < settings.group_threshold
    own = v.select(key, name, "first", alone.alias("_alone"))
    it = items.withColumn("_node", node(name)).join(own, [key, name]).join(led, "_node", "left")
    leader = F.when(F.col("_alone"), arr).otherwise(F.coalesce("_leader_first", "first"))
    return (it.withColumn("leader_key", F.to_json(F.struct(F.col(key), *[leader[c].alias(c) for c in arrival])))
            .drop("_node", "first", "_alone", "_leader_first"))
