"""DuckDB SQL text for the oracle side of each check.

These mirror the column expressions in ``functions`` so the oracle stays an
independent, plain-SQL statement of the same rules.
"""

from __future__ import annotations

import re

from ..sources.registry import FX_TO_USD, RELIABILITY, SYMBOLS


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9.,]', '', 'g')"


def _both(s):
    return f"(contains({s}, ',') AND contains({s}, '.'))"


def _comma_last(s):
    return f"(strpos(reverse({s}), ',') < strpos(reverse({s}), '.'))"


def _euro(s):
    return f"replace(replace({s}, '.', ''), ',', '.')"


def _after(s):
    return f"regexp_extract({s}, ',([^,]*)$', 1)"


def _count(s, ch=","):
    return f"(length({s}) - length(replace({s}, '{ch}', '')))"


def clean_price_us(x: str) -> str:
    s = digits(x)
    return (f"TRY_CAST(CASE WHEN {_both(s)} AND {_comma_last(s)} THEN {_euro(s)} "
            f"WHEN {_both(s)} THEN replace({s}, ',', '') "
            f"WHEN contains({s}, ',') AND {_count(s)} = 1 AND length({_after(s)}) <= 2 THEN replace({s}, ',', '.') "
            f"WHEN contains({s}, ',') THEN replace({s}, ',', '') ELSE {s} END AS DOUBLE)")


def clean_price_india(x: str) -> str:
    s = digits(x)
    return (f"TRY_CAST(CASE WHEN {_both(s)} AND {_comma_last(s)} THEN {_euro(s)} "
            f"WHEN {_both(s)} THEN replace({s}, ',', '') "
            f"WHEN contains({s}, ',') AND length({_after(s)}) <= 2 THEN replace({s}, ',', '.') "
            f"WHEN contains({s}, ',') THEN replace({s}, ',', '') ELSE {s} END AS DOUBLE)")


def clean_price_strip(x: str) -> str:
    s = digits(x)
    return (f"TRY_CAST(CASE WHEN {_both(s)} AND {_comma_last(s)} THEN {_euro(s)} "
            f"ELSE replace({s}, ',', '') END AS DOUBLE)")


def clean_price_loose(x: str) -> str:
    return f"nullif({digits(x)}, '')"


def currency_symbol(x: str) -> str:
    sym = f"regexp_extract({x}, '([{''.join(SYMBOLS)}])', 1)"
    whens = " ".join(f"WHEN {sym} = '{s}' THEN '{iso}'" for s, iso in SYMBOLS.items())
    return f"(CASE {whens} ELSE NULL END)"


def pick_currency(x: str, declared: str, target: str) -> str:
    return f"coalesce({currency_symbol(x)}, nullif({declared}, ''), {target})"


def rate(x: str) -> str:
    whens = " ".join(f"WHEN {x} = '{k}' THEN {v!r}" for k, v in sorted(FX_TO_USD.items()))
    return f"(CASE {whens} ELSE NULL END)"


def clean_text(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def levenshtein_similarity(a: str, b: str) -> str:
    ca, cb = clean_text(a), clean_text(b)
    return (f"(CASE WHEN coalesce(length({ca}), 0) = 0 OR coalesce(length({cb}), 0) = 0 THEN 0.0 "
            f"ELSE 1.0 - levenshtein({ca}, {cb}) / greatest(length({ca}), length({cb})) END)")


def reliability(source: str) -> str:
    whens = " ".join(f"WHEN lower({source}) = '{k}' THEN {v!r}" for k, v in RELIABILITY.items())
    return f"(CASE {whens} ELSE 0.6 END)"


def rank_score(sim: str, source: str, availability: str, rating: str, reviews: str,
               shipping: str, price: str) -> str:
    av = f"lower({availability})"
    avail = (f"(CASE WHEN {av} IN ('in stock', 'available') THEN 0.15 "
             f"WHEN contains({av}, 'limited') THEN 0.1 ELSE 0.0 END)")
    rt = f"(CASE WHEN {rating} IS NOT NULL AND {rating} <> 0 THEN least({rating} / 5.0, 1.0) * 0.1 ELSE 0.0 END)"
    rv = (f"(CASE WHEN {reviews} IS NOT NULL AND {reviews} <> 0 "
          f"THEN least(log10({reviews} + 1) / 4.0, 1.0) * 0.1 ELSE 0.0 END)")
    ship = clean_price_us(shipping)
    sp = (f"(CASE WHEN coalesce(length({shipping}), 0) > 0 AND {ship} IS NOT NULL AND {ship} <> 0 "
          f"THEN -least({ship} / {price} * 0.05, 0.05) ELSE 0.0 END)")
    score = f"({sim} * 0.4 + {reliability(source)} * 0.2 + {avail} + {rt} + {rv} + {sp})"
    return f"greatest(0.0, least(1.0, {score}))"


def normalized(offers: str) -> str:
    return f"""
SELECT *,
 CASE WHEN src_currency = target_currency THEN amount
      WHEN {rate('src_currency')} IS NOT NULL AND {rate('target_currency')} IS NOT NULL
      THEN amount * {rate('src_currency')} / {rate('target_currency')} ELSE amount END AS norm_price,
 CASE WHEN src_currency = target_currency THEN target_currency
      WHEN {rate('src_currency')} IS NOT NULL AND {rate('target_currency')} IS NOT NULL
      THEN target_currency ELSE src_currency END AS norm_currency
FROM (SELECT *, {clean_price_us('price')} AS amount,
        {pick_currency('price', 'currency', 'target_currency')} AS src_currency
      FROM {offers}) WHERE amount > 0
"""


NORMALIZED_SQL = normalized("offers_q")

ARRIVAL_SQL = "scraped_at, l_orderkey, l_linenumber, product_id, seller_id"


# --- indel ratios (bit-parallel LCS on 128-bit integers, up to 120 characters) ------------
def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two short texts."""
    full = f"((CAST(1 AS HUGEINT) << CAST(length({a}) AS INT)) - 1)"
    at = (f"list_sum(list_transform(generate_series(1, length({a})), lambda i: CASE WHEN substr({a}, i, 1) = ch "
          f"THEN CAST(1 AS HUGEINT) << CAST(i - 1 AS INT) ELSE 0 END))::HUGEINT")
    masks = f"list_transform(string_split({b}, ''), lambda ch: {at})"
    step = f"list_reduce(list_prepend({full}, {masks}), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full})"
    return f"(length({a}) - bit_count({step}))"


def ratio(a: str, b: str) -> str:
    return (f"(CASE WHEN {a} = {b} THEN 100.0 WHEN {a} = '' OR {b} = '' THEN 0.0 "
            f"ELSE round_even(100 * (2.0 * {lcs(a, b)} / (length({a}) + length({b}))), 0) END)")


def partial_ratio(short: str, long: str) -> str:
    """``short`` must be the shorter text (the first of equals)."""
    window = f"substr({long}, o + 1, length({short}))"
    best = (f"list_max(list_transform(generate_series(0, length({long}) - length({short})), "
            f"lambda o: 2.0 * {lcs(short, window)} / (2 * length({short}))))")
    return (f"(CASE WHEN {short} = {long} THEN 100.0 WHEN {short} = '' THEN 0.0 "
            f"WHEN {best} > 0.995 THEN 100.0 ELSE round_even(100 * {best}, 0) END)")


def tokens(x: str) -> str:
    s = f"trim(lower(regexp_replace(regexp_replace({x}, '[^\\x00-\\x7F]', '', 'g'), '\\W', ' ', 'g')))"
    return f"list_filter(string_split_regex({s}, '\\s+'), lambda t: t <> '')"


def ratio_parts(pairs: str, a: str, b: str) -> str:
    """``pairs`` with its texts cleaned (ca, cb), token-sorted (sa, sb), split into token-set parts
    (sect, c1, c2) and ordered by length (sh, lo)."""
    return f"""
SELECT *, CASE WHEN length(ca) <= length(cb) THEN ca ELSE cb END AS sh,
 CASE WHEN length(ca) <= length(cb) THEN cb ELSE ca END AS lo,
 array_to_string(list_sort(ta), ' ') AS sa, array_to_string(list_sort(tb), ' ') AS sb,
 trim(sect || ' ' || r1) AS c1, trim(sect || ' ' || r2) AS c2
FROM (SELECT *, array_to_string(list_sort(list_distinct(list_intersect(ta, tb))), ' ') AS sect,
  array_to_string(list_sort(list_distinct(list_filter(ta, lambda t: NOT list_contains(tb, t)))), ' ') AS r1,
  array_to_string(list_sort(list_distinct(list_filter(tb, lambda t: NOT list_contains(ta, t)))), ' ') AS r2
 FROM (SELECT *, {tokens('ca')} AS ta, {tokens('cb')} AS tb
  FROM (SELECT *, {clean_text(a)} AS ca, {clean_text(b)} AS cb FROM ({pairs}))))"""


TSET = f"(CASE WHEN c1 = '' OR c2 = '' THEN 0.0 ELSE greatest({ratio('sect', 'c1')}, {ratio('sect', 'c2')}, {ratio('c1', 'c2')}) END)"


def similarity(pairs: str, a: str, b: str, floor: float | None = None) -> str:
    """``pairs`` with F6 as ``similarity``; with ``floor`` only the pairs above it, ratio by ratio."""
    keep = (lambda x: f" WHERE {x} > {floor}") if floor is not None else (lambda x: "")
    blend = "(ts * 0.4 + tset * 0.4 + pr * 0.2) / 100.0"
    ts = f"SELECT *, {ratio('sa', 'sb')} AS ts FROM ({ratio_parts(pairs, a, b)})"
    ts = f"SELECT * FROM ({ts}){keep('(ts * 0.4 + 100 * 0.4 + 100 * 0.2) / 100.0')}"
    tset = f"SELECT * FROM (SELECT *, {TSET} AS tset FROM ({ts})){keep('(ts * 0.4 + tset * 0.4 + 100 * 0.2) / 100.0')}"
    out = (f"SELECT *, CASE WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE {blend} END AS similarity "
           f"FROM (SELECT *, {partial_ratio('sh', 'lo')} AS pr FROM ({tset}))")
    return f"SELECT * FROM ({out}){keep('similarity')}"


# --- the search: similarity, near-duplicate groups, best members, score, rank --------------
def close(p1: str, p2: str) -> str:
    return f"(1.0 - abs({p1} - {p2}) / greatest({p1}, {p2}) > 0.9)"


SIMILAR_OFFERS_SQL = f"""
SELECT n.*, s.similarity FROM norm n JOIN (
 SELECT product_name AS pn, query AS q, similarity
 FROM ({similarity('SELECT DISTINCT product_name, query FROM norm', 'product_name', 'query')})) s
 ON n.product_name = s.pn AND n.query = s.q"""

_VOCABULARY = "SELECT DISTINCT query_id, product_name FROM norm"
NAME_PAIRS_SQL = f"""
SELECT query_id, name_a, name_b FROM ({similarity(
    f'''SELECT a.query_id, a.product_name AS name_a, b.product_name AS name_b
        FROM ({_VOCABULARY}) a JOIN ({_VOCABULARY}) b ON a.query_id = b.query_id AND a.product_name < b.product_name''',
    'name_a', 'name_b', 0.85)})"""

#: Runs of close prices of one name.
RUNS_SQL = f"""
SELECT query_id, product_name, seg, min(norm_price) AS lo, max(norm_price) AS hi FROM (
 SELECT *, sum(gap) OVER (PARTITION BY query_id, product_name ORDER BY norm_price) AS seg FROM (
  SELECT *, CASE WHEN prev IS NULL OR NOT {close('prev', 'norm_price')}
    OR len({tokens(clean_text('product_name'))}) = 0 THEN 1 ELSE 0 END AS gap
  FROM (SELECT *, lag(norm_price) OVER (PARTITION BY query_id, product_name ORDER BY norm_price) AS prev
        FROM (SELECT DISTINCT query_id, product_name, norm_price FROM norm))))
GROUP BY query_id, product_name, seg"""

#: Every run with the smallest run that it reaches over similar names at close prices.
ROOTS_SQL = f"""
SELECT query_id, product_name, seg, min(struct_pack(n := other_name, s := other_seg)) AS root FROM (
 WITH RECURSIVE link AS (
  SELECT a.query_id, a.product_name AS n1, a.seg AS s1, b.product_name AS n2, b.seg AS s2
  FROM (SELECT query_id, name_a AS x, name_b AS y FROM name_pairs
        UNION ALL SELECT query_id, name_b, name_a FROM name_pairs) p
  JOIN runs a ON a.query_id = p.query_id AND a.product_name = p.x
  JOIN runs b ON b.query_id = p.query_id AND b.product_name = p.y
  WHERE (a.lo <= b.hi AND b.lo <= a.hi) OR (a.hi < b.lo AND {close('a.hi', 'b.lo')}) OR (b.hi < a.lo AND {close('b.hi', 'a.lo')})),
 reach AS (
  SELECT query_id, product_name, seg, product_name AS other_name, seg AS other_seg FROM runs
  UNION SELECT r.query_id, r.product_name, r.seg, l.n2, l.s2
  FROM reach r JOIN link l ON l.query_id = r.query_id AND l.n1 = r.other_name AND l.s1 = r.other_seg)
 SELECT * FROM reach) GROUP BY query_id, product_name, seg"""

GROUPED_SQL = """
SELECT o.*, r.root FROM sim_offers o JOIN runs u ON o.query_id = u.query_id AND o.product_name = u.product_name
 AND o.norm_price BETWEEN u.lo AND u.hi
JOIN roots r ON r.query_id = u.query_id AND r.product_name = u.product_name AND r.seg = u.seg"""

BEST_SQL = f"""
SELECT * EXCLUDE (rn), substr(md5(product_name), 1, 8) AS group_id FROM (
 SELECT *, count(*) OVER (PARTITION BY query_id, root) AS group_size,
  row_number() OVER (PARTITION BY query_id, root ORDER BY similarity DESC, norm_price, {ARRIVAL_SQL}) AS rn
 FROM grouped) WHERE rn = 1"""

RANKED_SQL = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, norm_price, {ARRIVAL_SQL}) AS rank
 FROM (SELECT *, {rank_score('similarity', 'source', 'availability', 'rating', 'reviews_count', 'shipping_cost', 'norm_price')}
       AS score FROM best))
WHERE max_results <= 0 OR rank <= max_results"""

_GROUP_VIEWS = {"sim_offers": (SIMILAR_OFFERS_SQL, ["norm"]), "name_pairs": (NAME_PAIRS_SQL, ["norm"]),
                "runs": (RUNS_SQL, ["norm"]), "roots": (ROOTS_SQL, ["runs", "name_pairs"]),
                "grouped": (GROUPED_SQL, ["sim_offers", "runs", "roots"]), "best": (BEST_SQL, ["grouped"])}

#: What a shop front finds for the rewritten query: the shops of the country that the lists leave over, names by token share.
_TOKENS = "SELECT DISTINCT {id}, token FROM (SELECT {id}, unnest(string_split({clean}, ' ')) AS token FROM {source}) WHERE token <> ''"
FRONT_VIEWS = {
    "selected_shops": ("""
SELECT q.query_id, r.source AS shop, r.country AS shop_country FROM queries q JOIN registry r ON upper(q.country) = r.country
WHERE (len(include_sources) = 0 OR list_contains(list_transform(include_sources, lambda x: lower(x)), lower(r.source)))
 AND NOT list_contains(list_transform(exclude_sources, lambda x: lower(x)), lower(r.source))""", ["queries", "registry"]),
    "name_tokens": (_TOKENS.format(id="product_name", clean=clean_text("product_name"), source="(SELECT DISTINCT product_name FROM offers)"), ["offers"]),
    "search_tokens": (_TOKENS.format(id="query_id", clean=clean_text("enhanced_query"), source="enhanced")
                      + " AND token NOT IN ('india', 'official', 'variant')", ["enhanced"]),
    "name_hits": ("""
SELECT t.query_id, n.product_name FROM search_tokens t JOIN name_tokens n ON t.token = n.token
JOIN (SELECT query_id, ceil(count(*) * 0.75) AS need FROM search_tokens GROUP BY query_id) d ON t.query_id = d.query_id
GROUP BY t.query_id, n.product_name, d.need HAVING count(*) >= d.need""", ["search_tokens", "name_tokens"]),
    "offers_s": ("""
SELECT o.* EXCLUDE (shop, shop_country), q.query_id, q.query, q.country, q.max_results, q.target_currency
FROM name_hits h JOIN selected_shops s ON h.query_id = s.query_id JOIN queries q ON q.query_id = h.query_id
JOIN shop_offers o ON o.product_name = h.product_name AND o.shop = s.shop AND o.shop_country = s.shop_country""",
                 ["name_hits", "selected_shops", "queries", "shop_offers"]),
    "s_norm": (normalized("offers_s"), ["offers_s"]),
}


def _of_search(sql: str) -> str:
    """A view of the grouping chain, over the offers that a search found."""
    return re.sub(rf"\b({'|'.join(['norm', *_GROUP_VIEWS])})\b(?!_)", r"s_\1", sql)


SEARCH_VIEWS = {**_GROUP_VIEWS, **FRONT_VIEWS,
                **{f"s_{k}": (_of_search(v), [f"s_{d}" for d in deps]) for k, (v, deps) in _GROUP_VIEWS.items()},
                "ranked": (_of_search(RANKED_SQL), ["s_best"])}
