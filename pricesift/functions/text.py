"""Text functions: native column expressions first, Arrow-batched UDFs for the
LCS-based ratios that have no built-in.

Native: ``clean_text`` (F1), ``token_sort_key`` (F3), token sets (F4),
``levenshtein_similarity`` (SQL-checkable sibling of F6), ``slug`` (F16),
``title_case`` (D7).
UDF (numpy over an Arrow batch): ``ratio_udf`` (F2), ``partial_ratio_udf`` (F5),
``token_sort_ratio_udf`` (F3), ``token_set_ratio_udf`` (F4), ``name_similarity_udf``
(F6); the token parts reach them as native columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import fuzz


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_text(x) -> Column:
    """lower, non-word -> space, squeeze, trim. (?U) keeps accented letters."""
    s = F.regexp_replace(F.lower(_c(x)), r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def ascii_words(x) -> Column:
    """Token processing of the ratio library: drop non-ASCII, non-word -> space."""
    s = F.regexp_replace(_c(x), r"[^\x00-\x7F]", "")
    return F.trim(F.lower(F.regexp_replace(s, r"(?U)\W", " ")))


def tokens(x) -> Column:
    return F.filter(F.split(ascii_words(x), r"\s+"), lambda t: t != "")


def token_sort_key(x) -> Column:
    """F3 key: processed tokens sorted and joined by one space."""
    return F.array_join(F.array_sort(tokens(x)), " ")


def token_set_parts(a, b) -> tuple[Column, Column, Column]:
    """F4 parts: sorted intersection, and intersection + each side's rest."""
    ta, tb = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    sect = F.array_join(F.array_sort(F.array_intersect(ta, tb)), " ")
    c1 = F.trim(F.concat_ws(" ", sect, F.array_join(F.array_sort(F.array_except(ta, tb)), " ")))
    c2 = F.trim(F.concat_ws(" ", sect, F.array_join(F.array_sort(F.array_except(tb, ta)), " ")))
    return sect, c1, c2


def levenshtein_similarity(a, b) -> Column:
    """1 - edit distance / longer length on cleaned text (0 when either is empty)."""
    ca, cb = clean_text(a), clean_text(b)
    longest = F.greatest(F.length(ca), F.length(cb))
    return F.when((F.coalesce(F.length(ca), F.lit(0)) == 0) | (F.coalesce(F.length(cb), F.lit(0)) == 0), F.lit(0.0)) \
        .otherwise(1.0 - F.levenshtein(ca, cb) / longest)


def with_levenshtein_similarity(df, a: str, b: str, out: str = "similarity"):
    """Same as ``levenshtein_similarity`` with both cleaned texts staged as columns."""
    d = df.withColumn("_ca", clean_text(a)).withColumn("_cb", clean_text(b))
    la, lb = F.length("_ca"), F.length("_cb")
    sim = F.when((F.coalesce(la, F.lit(0)) == 0) | (F.coalesce(lb, F.lit(0)) == 0), F.lit(0.0)) \
        .otherwise(1.0 - F.levenshtein("_ca", "_cb") / F.greatest(la, lb))
    return d.withColumn(out, sim).drop("_ca", "_cb")


def slug(x) -> Column:
    """F16: lower(replace(x, ' ', '_'))."""
    return F.lower(F.replace(_c(x), F.lit(" "), F.lit("_")))


def title_case(x) -> Column:
    """str.title(): a letter is upper-cased at the start or after any non-letter."""
    chars = F.split(F.lower(_c(x)), "")
    return F.array_join(F.transform(chars, lambda ch, i: (
        F.when(i == 0, F.upper(ch))
         .when(~F.element_at(chars, i).rlike(r"^\p{L}$"), F.upper(ch))
         .otherwise(ch))), "")


# --- Arrow-batched ratio UDFs (numpy over the whole batch, no call per row) --------------
def _both_known(fn, a: pd.Series, b: pd.Series) -> pd.Series:
    out = pd.Series(0.0, index=a.index)
    known = (a.notna() & b.notna()).to_numpy()
    if known.any():
        out[known] = fn(a[known].tolist(), b[known].tolist())
    return out


@F.pandas_udf(DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return _both_known(fuzz.ratios, a, b)


@F.pandas_udf(DoubleType())
def partial_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return _both_known(fuzz.partial_ratios, a, b)


@F.pandas_udf(DoubleType())
def _set_ratio_udf(sect: pd.Series, c1: pd.Series, c2: pd.Series) -> pd.Series:
    x, y, s = c1.tolist(), c2.tolist(), sect.tolist()
    best = np.maximum(np.maximum(fuzz.ratios(s, x), fuzz.ratios(s, y)), fuzz.ratios(x, y))
    return pd.Series(np.where((c1 != "") & (c2 != ""), best, 0.0))


def token_sort_ratio_udf(a, b) -> Column:
    return ratio_udf(token_sort_key(a), token_sort_key(b))


def token_set_ratio_udf(a, b) -> Column:
    known = _c(a).isNotNull() & _c(b).isNotNull()
    parts = [F.coalesce(p, F.lit("")) for p in token_set_parts(a, b)]
    return F.when(known, _set_ratio_udf(*parts)).otherwise(0.0)


def _similarity_udf(floor: float | None):
    @F.pandas_udf(DoubleType())
    def run(ca: pd.Series, cb: pd.Series, sa: pd.Series, sb: pd.Series, sect: pd.Series,
            c1: pd.Series, c2: pd.Series) -> pd.Series:
        return pd.Series(fuzz.similarity_batch((ca.tolist(), cb.tolist()), (sa.tolist(), sb.tolist()),
                                               sect.tolist(), c1.tolist(), c2.tolist(), floor))
    return run


def name_parts(text) -> Column:
    """What F6 needs of one text: cleaned text, its sorted distinct tokens, its token-sort key."""
    clean = clean_text(F.coalesce(_c(text), F.lit("")))
    return F.struct(clean.alias("clean"), F.array_sort(F.array_distinct(tokens(clean))).alias("tokens"),
                    token_sort_key(clean).alias("key"), (F.coalesce(F.length(_c(text)), F.lit(0)) == 0).alias("empty"))


def similarity_of_parts(a: Column, b: Column, floor: float | None = None) -> Column:
    """F6 of two ``name_parts``; with ``floor``, pairs that cannot exceed it may get 0.

    Both token lists are sorted, so their intersection and differences are, too.
    """
    sect = F.array_join(F.array_intersect(a["tokens"], b["tokens"]), " ")
    c1 = F.trim(F.concat_ws(" ", sect, F.array_join(F.array_except(a["tokens"], b["tokens"]), " ")))
    c2 = F.trim(F.concat_ws(" ", sect, F.array_join(F.array_except(b["tokens"], a["tokens"]), " ")))
    score = _similarity_udf(floor)(a["clean"], b["clean"], a["key"], b["key"], sect, c1, c2)
    return F.when(a["empty"] | b["empty"], 0.0).otherwise(score)


def name_similarity_udf(name, query, floor: float | None = None) -> Column:
    """F6 of two text columns. Where a text meets many others, stage its ``name_parts`` once instead."""
    return similarity_of_parts(name_parts(name), name_parts(query), floor)
