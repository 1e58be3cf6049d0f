"""Text cleaning, token keys, feature extraction, hints and fuzzy-ratio queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as FT
from ..functions.text import (clean_text, name_similarity_udf, partial_ratio_udf, ratio_udf, token_set_parts,
                              token_set_ratio_udf, token_sort_key, token_sort_ratio_udf)
from ..operators.match import feature_similarity, rank_products
from ..sources import tables as T
from . import sql_exprs as S
from .catalog import query


def _pairs(spark, sf):
    """Distinct (offer name, query) pairs: every string function runs once per pair."""
    from ..operators.match import spread
    return spread(T.offers_for_queries(spark, sf).select("query_id", "product_name", "query").distinct())


_PAIRS_SQL = "SELECT DISTINCT query_id, product_name, query FROM offers_q"


_sql_tokens = S.tokens


@query("clean_text", f"SELECT DISTINCT product_name, {S.clean_text('product_name')} AS clean FROM offers",
       ("offers",))
def clean_text_q(spark, sf):
    return T.offers(spark, sf).select("product_name").distinct().withColumn("clean", clean_text("product_name"))


@query("token_sort_key", f"""
SELECT DISTINCT product_name, array_to_string(list_sort({_sql_tokens('product_name')}), ' ') AS sort_key
FROM offers""", ("offers",))
def token_sort_key_q(spark, sf):
    return T.offers(spark, sf).select("product_name").distinct().withColumn("sort_key", token_sort_key("product_name"))


@query("token_sets", f"""
SELECT query_id, product_name, sect, trim(sect || ' ' || r1) AS combined_1, trim(sect || ' ' || r2) AS combined_2
FROM (SELECT query_id, product_name,
  array_to_string(list_sort(list_distinct(list_intersect(ta, tb))), ' ') AS sect,
  array_to_string(list_sort(list_distinct(list_filter(ta, lambda t: NOT list_contains(tb, t)))), ' ') AS r1,
  array_to_string(list_sort(list_distinct(list_filter(tb, lambda t: NOT list_contains(ta, t)))), ' ') AS r2
 FROM (SELECT query_id, product_name, {_sql_tokens('product_name')} AS ta, {_sql_tokens('query')} AS tb
       FROM ({_PAIRS_SQL})))""", ("offers_q",))
def token_sets(spark, sf):
    sect, c1, c2 = token_set_parts("product_name", "query")
    return _pairs(spark, sf).select("query_id", "product_name", sect.alias("sect"), c1.alias("combined_1"),
                                    c2.alias("combined_2"))


def _first_label_sql(text: str, table) -> str:
    whens = " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{lab}'" for lab, p in table)
    return f"(CASE {whens} END)"


def _product_features_sql(name: str, query: str) -> str:
    t = f"lower({name} || ' ' || coalesce({query}, ''))"
    st = FT.PRODUCT_STORAGE

    def when(p, val):
        return f"(CASE WHEN regexp_matches({t}, '{p}') THEN {val} END)"
    ram = when(FT.PRODUCT_RAM, f"regexp_extract({t}, '{FT.PRODUCT_RAM}', 1) || 'GB RAM'")
    cam = when(FT.CAMERA, f"regexp_extract({t}, '{FT.CAMERA}', 1) || 'MP'")
    disp = when(FT.DISPLAY, f"regexp_extract({t}, '{FT.DISPLAY}', 1) || '\"'")
    return (f"{_first_label_sql(t, FT.PRODUCT_BRANDS)} AS brand, "
            f"trim(nullif(regexp_extract({t}, '{FT.GENERIC_MODEL}', 1), '')) AS model, "
            f"{when(st, f'regexp_extract({t}, {chr(39)}{st}{chr(39)}, 1) || upper(regexp_extract({t}, {chr(39)}{st}{chr(39)}, 2))')} AS storage, "
            f"nullif(regexp_extract({t}, '{FT.PRODUCT_COLORS}', 1), '') AS color, "
            f"{_first_label_sql(t, FT.PRODUCT_CATEGORIES)} AS category, "
            f"array_to_string(list_filter([{ram}, {cam}, {disp}], lambda x: x IS NOT NULL), '|') AS key_specs")


@query("product_features", f"""
SELECT query_id, product_name, {_product_features_sql('product_name', 'query')} FROM ({_PAIRS_SQL})""",
       ("offers_q",))
def product_features(spark, sf):
    f = FT.product_features("product_name", "query")
    return _pairs(spark, sf).select("query_id", "product_name", f.alias("f")).select(
        "query_id", "product_name", "f.brand", "f.model", "f.storage", "f.color", "f.category",
        F.array_join("f.key_specs", "|").alias("key_specs"))


@query("feature_similarity_nofuzz", f"""
SELECT query_id, product_name,
 round(0.25 * (CASE WHEN b1 IS NULL OR b2 IS NULL THEN 0.5 WHEN b1 = b2 THEN 1.0 ELSE 0.0 END)
  + 0.1 * (CASE WHEN s1 IS NULL OR s2 IS NULL THEN 0.5 WHEN s1 = s2 THEN 1.0 ELSE 0.3 END)
  + 0.05 * (CASE WHEN c1 IS NULL OR c2 IS NULL THEN 0.8 WHEN c1 = c2 THEN 1.0 ELSE 0.6 END), 6) AS partial_score
FROM (SELECT a.query_id, a.product_name, a.brand AS b1, b.brand AS b2, a.storage AS s1, b.storage AS s2,
        a.color AS c1, b.color AS c2
      FROM (SELECT query_id, product_name, {_product_features_sql('product_name', "''")} FROM ({_PAIRS_SQL})) a
      JOIN (SELECT query_id, {_product_features_sql('query', "''")} FROM queries) b ON a.query_id = b.query_id)""",
       ("offers_q",))
def feature_similarity_nofuzz(spark, sf):
    p = _pairs(spark, sf)
    f1 = FT.product_features("product_name")
    f2 = FT.product_features("query")
    sc = FT.feature_scores(f1, f2)
    score = 0.25 * sc["brand"] + 0.1 * sc["storage"] + 0.05 * sc["color"]
    return p.select("query_id", "product_name", F.round(score, 6).alias("partial_score"))


def _query_features_sql(q: str) -> str:
    lq = f"lower({q})"

    def m(p):
        return f"regexp_matches({lq}, '{p}')"

    def ex(p, g=1):
        return f"regexp_extract({lq}, '{p}', {g})"

    def title(x):
        # str.title() on lower text: upper-case letters at the start or after a non-letter.
        return (f"array_to_string(list_transform(string_split({x}, ''), lambda ch, i: CASE WHEN i = 1 "
                f"OR NOT regexp_matches(substr({x}, i - 1, 1), '^[[:alpha:]]$') THEN upper(ch) ELSE ch END), '')")
    st_n = (f"(CASE WHEN {m(FT.QUERY_STORAGE)} THEN {ex(FT.QUERY_STORAGE)} "
            f"WHEN {m(FT.QUERY_STORAGE_WORDS)} THEN {ex(FT.QUERY_STORAGE_WORDS)} END)")
    st_u = (f"(CASE WHEN {m(FT.QUERY_STORAGE)} THEN upper({ex(FT.QUERY_STORAGE, 2)}) "
            f"WHEN {m(FT.QUERY_STORAGE_WORDS)} THEN (CASE WHEN {ex(FT.QUERY_STORAGE_WORDS, 2)} = 'terabyte' "
            f"THEN 'TB' ELSE 'GB' END) END)")
    mem = (f"(CASE WHEN {m(FT.QUERY_MEMORY)} THEN {ex(FT.QUERY_MEMORY)} "
           f"WHEN {m(FT.QUERY_MEMORY_WORDS)} THEN {ex(FT.QUERY_MEMORY_WORDS)} END)")
    color = f"(CASE WHEN {m(FT.QUERY_COLORS)} THEN {title(ex(FT.QUERY_COLORS))} END)"
    brand = (f"(CASE WHEN {m(FT.QUERY_BRANDS[0])} THEN {title(ex(FT.QUERY_BRANDS[0]))} "
             f"WHEN {m(FT.QUERY_BRANDS[1])} THEN {title(ex(FT.QUERY_BRANDS[1]))} END)")
    model = "(CASE " + " ".join(f"WHEN {m(p)} THEN {title(ex(p))}" for p in FT.QUERY_MODELS) + " END)"
    return (f"{st_n} || {st_u} AS storage, CASE WHEN {st_u} = 'TB' THEN CAST({st_n} AS BIGINT) * 1024 "
            f"ELSE CAST({st_n} AS BIGINT) END AS storage_gb, {mem} || 'GB' AS memory, "
            f"CAST({mem} AS BIGINT) AS memory_gb, {color} AS color, {brand} AS brand, {model} AS model")


QF_SQL = f"SELECT query_id, query, country, {_query_features_sql('query')} FROM queries"


@query("query_features", f"""
SELECT *, (CASE WHEN storage IS NULL THEN 0 ELSE 1 END) + (CASE WHEN storage_gb IS NULL THEN 0 ELSE 1 END)
 + (CASE WHEN memory IS NULL THEN 0 ELSE 1 END) + (CASE WHEN memory_gb IS NULL THEN 0 ELSE 1 END)
 + (CASE WHEN color IS NULL THEN 0 ELSE 1 END) + (CASE WHEN brand IS NULL THEN 0 ELSE 1 END)
 + (CASE WHEN model IS NULL THEN 0 ELSE 1 END) AS feature_count FROM ({QF_SQL})""", ("queries",))
def query_features_q(spark, sf):
    f = FT.query_features("query")
    return (T.queries(spark, sf).select("query_id", "query", "country", f.alias("f"))
            .select("query_id", "query", "country", "f.*", FT.feature_count(F.col("f")).alias("feature_count")))


def hints_sql(q: str, f: str) -> str:
    """F15 over a relation ``f`` with the query's features."""
    phone = " OR ".join(f"contains(lower({q}), '{w}')" for w in FT.PHONE_WORDS)
    return f"""array_to_string(list_filter([
  CASE WHEN len(list_filter(string_split_regex(trim({q}), '\\s+'), lambda t: t <> '')) < 2 THEN '{FT.HINT_VAGUE}' END,
  CASE WHEN {f}.brand IS NULL THEN '{FT.HINT_BRAND}' END,
  CASE WHEN {f}.storage IS NULL AND ({phone}) THEN '{FT.HINT_STORAGE}' END,
  CASE WHEN {f}.model IS NULL THEN '{FT.HINT_MODEL}' END], lambda x: x IS NOT NULL), ' | ')"""


@query("query_hints", f"SELECT query_id, {hints_sql('f.query', 'f')} AS hints FROM ({QF_SQL}) f", ("queries",))
def query_hints_q(spark, sf):
    q = T.queries(spark, sf)
    f = FT.query_features("query")
    return q.select("query_id", F.array_join(FT.query_hints("query", f), " | ").alias("hints"))


# --- fuzzy ratios (Arrow UDFs; the SQL computes the same LCS with 128-bit integers) ------
_PARTS_SQL = S.ratio_parts(_PAIRS_SQL, "product_name", "query")


def _clean_pairs(spark, sf):
    return (_pairs(spark, sf).select("query_id", "product_name", "query",
                                     clean_text("product_name").alias("a"), clean_text("query").alias("b")))


@query("fuzz_ratio", f"SELECT query_id, product_name, {S.ratio('ca', 'cb')} AS ratio FROM ({_PARTS_SQL})", ("offers_q",))
def fuzz_ratio(spark, sf):
    return _clean_pairs(spark, sf).select("query_id", "product_name", ratio_udf("a", "b").alias("ratio"))


@query("partial_ratio", f"SELECT query_id, product_name, {S.partial_ratio('sh', 'lo')} AS partial FROM ({_PARTS_SQL})", ("offers_q",))
def partial_ratio(spark, sf):
    return _clean_pairs(spark, sf).select("query_id", "product_name", partial_ratio_udf("a", "b").alias("partial"))


@query("token_ratios", f"""
SELECT query_id, product_name, {S.ratio('sa', 'sb')} AS token_sort, {S.TSET} AS token_set FROM ({_PARTS_SQL})""", ("offers_q",))
def token_ratios(spark, sf):
    return _clean_pairs(spark, sf).select("query_id", "product_name",
                                          token_sort_ratio_udf("a", "b").alias("token_sort"),
                                          token_set_ratio_udf("a", "b").alias("token_set"))


@query("offer_similarity", f"""
SELECT query_id, product_name, round(similarity, 6) AS similarity
FROM ({S.similarity(_PAIRS_SQL, 'product_name', 'query')})""", ("offers_q",))
def offer_similarity(spark, sf):
    """F6 per distinct (name, query) pair."""
    return _pairs(spark, sf).select("query_id", "product_name",
                                    F.round(name_similarity_udf("product_name", "query"), 6).alias("similarity"))


def feature_similarity_sql(pairs: str, a: str, b: str, q: str | None = None) -> str:
    """F10 of two name columns of ``pairs`` as ``similarity``; ``q`` is the query column, if any."""
    shorter = lambda x, y: (f"CASE WHEN length({x}) <= length({y}) THEN {x} ELSE {y} END",
                            f"CASE WHEN length({x}) <= length({y}) THEN {y} ELSE {x} END")
    query = q or "''"
    f1 = _product_features_sql(a, query).replace(" AS brand", " AS b1").replace(" AS model", " AS m1").replace(
        " AS storage", " AS s1").replace(" AS color", " AS k1").replace(" AS category", " AS cat1").replace(" AS key_specs", " AS ks1")
    f2 = _product_features_sql(b, query).replace(" AS brand", " AS b2").replace(" AS model", " AS m2").replace(
        " AS storage", " AS s2").replace(" AS color", " AS k2").replace(" AS category", " AS cat2").replace(" AS key_specs", " AS ks2")
    rel = "0.5"
    extra = ""
    if q:
        (s1, l1), (s2, l2) = shorter("lq", "la"), shorter("lq", "lb")
        extra = f", {s1} AS p1, {l1} AS o1, {s2} AS p2, {l2} AS o2"
        rel = f"(CASE WHEN length({q}) = 0 THEN 0.5 ELSE ({S.partial_ratio('p1', 'o1')} / 100.0 + {S.partial_ratio('p2', 'o2')} / 100.0) / 2.0 END)"
    return f"""
SELECT *, {S.ratio('ka', 'kb')} / 100.0 * 0.3
  + (CASE WHEN b1 IS NULL OR b2 IS NULL THEN 0.5 WHEN b1 = b2 THEN 1.0 ELSE 0.0 END) * 0.25
  + (CASE WHEN m1 IS NULL OR m2 IS NULL THEN 0.5 ELSE {S.ratio('m1', 'm2')} / 100.0 END) * 0.2
  + (CASE WHEN s1 IS NULL OR s2 IS NULL THEN 0.5 WHEN s1 = s2 THEN 1.0 ELSE 0.3 END) * 0.1
  + (CASE WHEN k1 IS NULL OR k2 IS NULL THEN 0.8 WHEN k1 = k2 THEN 1.0 ELSE 0.6 END) * 0.05 + {rel} * 0.1 AS similarity
FROM (SELECT *{extra}, array_to_string(list_sort({_sql_tokens('la')}), ' ') AS ka, array_to_string(list_sort({_sql_tokens('lb')}), ' ') AS kb
 FROM (SELECT *, lower({a}) AS la, lower({b}) AS lb, lower({query}) AS lq, {f1}, {f2} FROM ({pairs})))"""


@query("feature_similarity", f"""
SELECT query_id, product_name, round(similarity, 6) AS similarity
FROM ({feature_similarity_sql(_PAIRS_SQL, 'product_name', 'query', 'query')})""", ("offers_q",))
def feature_similarity_q(spark, sf):
    """F10 + F11: each offer name against its query text, with the query as context."""
    p = _pairs(spark, sf)
    return p.select("query_id", "product_name", F.round(
        feature_similarity(F.col("product_name"), F.col("query"), F.col("query")), 6).alias("similarity"))


@query("rank_products", f"""
SELECT query_id, product_name, relevance, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, product_name) AS rank
FROM (SELECT query_id, product_name, {S.partial_ratio('sh', 'lo')} / 100.0 AS relevance
 FROM (SELECT *, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS sh, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS lo
  FROM (SELECT *, lower(query) AS a, lower(product_name) AS b FROM ({_PAIRS_SQL}))))""", ("offers_q",))
def rank_products_q(spark, sf):
    """Distinct offer names ranked by partial match to the query."""
    return rank_products(_pairs(spark, sf), "query_id", "product_name", "query")
