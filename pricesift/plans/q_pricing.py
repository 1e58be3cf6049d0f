"""Offer scan, price parsing, normalisation, scoring and ranking queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import pricing as P
from ..functions.text import levenshtein_similarity, with_levenshtein_similarity
from ..operators.normalize import normalize_offers
from ..operators.rank import limit_bound, rank_within_query, top_n_per_query, with_rank_score
from ..sources import tables as T
from . import sql_exprs as S
from .catalog import query

A = S.ARRIVAL_SQL


def scored(spark, sf):
    """Normalised offers with the SQL-checkable similarity and the rank score."""
    o = normalize_offers(T.offers_for_queries(spark, sf))
    o = with_levenshtein_similarity(o, "product_name", "query")
    return with_rank_score(o)


SCORED_SQL = f"""SELECT *, {S.rank_score('similarity', 'source', 'availability', 'rating',
                                         'reviews_count', 'shipping_cost', 'norm_price')} AS score
FROM (SELECT *, {S.levenshtein_similarity('product_name', 'query')} AS similarity FROM norm)"""


def _rank_cols():
    return ["query_id", "l_orderkey", "l_linenumber", "product_id", "seller_id", "source",
            F.col("norm_price").cast("bigint").cast("string").alias("price"),
            F.col("norm_currency").alias("currency"),
            F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"), "rank"]


RANK_COLS_SQL = """query_id, l_orderkey, l_linenumber, product_id, seller_id, source,
 CAST(CAST(trunc(norm_price) AS BIGINT) AS VARCHAR) AS price, norm_currency AS currency,
 round(similarity, 6) AS similarity, round(score, 6) AS score"""


@query("rank_offers", f"""
SELECT {RANK_COLS_SQL}, row_number() OVER (PARTITION BY query_id
  ORDER BY score DESC, norm_price, {A}) AS rank
FROM ({SCORED_SQL})""", ("norm",))
def rank_offers(spark, sf):
    """Flagship: offers -> P1/P5 -> J3 -> similarity -> F7 -> W1."""
    s = scored(spark, sf).select("query_id", "l_orderkey", "l_linenumber", "product_id", "seller_id", "source",
                                 "scraped_at", "norm_price", "norm_currency", "similarity", "score")
    return rank_within_query(s).select(*_rank_cols())


@query("topn_offers", f"""
SELECT * EXCLUDE (max_results) FROM (
 SELECT {RANK_COLS_SQL}, max_results, row_number() OVER (PARTITION BY query_id
   ORDER BY score DESC, norm_price, {A}) AS rank
 FROM ({SCORED_SQL})) WHERE max_results <= 0 OR rank <= max_results""", ("norm",))
def topn_offers(spark, sf):
    bound = limit_bound(T.queries(spark, sf))
    s = scored(spark, sf).select("query_id", "l_orderkey", "l_linenumber", "product_id", "seller_id", "source", "scraped_at",
                                 "norm_price", "norm_currency", "max_results", "similarity", "score")
    return top_n_per_query(s, bound=bound).select(*_rank_cols())


@query("rank_score", f"""
SELECT query_id, l_orderkey, l_linenumber, product_id, seller_id, round(score, 6) AS score
FROM ({SCORED_SQL})""", ("norm",))
def rank_score_q(spark, sf):
    return scored(spark, sf).select("query_id", "l_orderkey", "l_linenumber", "product_id", "seller_id",
                                    F.round("score", 6).alias("score"))


@query("offers_scan", "SELECT * FROM offers", ("offers",))
def offers_scan(spark, sf):
    return T.offers(spark, sf)


@query("offers_normalized", """
SELECT query_id, l_orderkey, l_linenumber, product_id, seller_id, amount, src_currency,
 round(norm_price, 6) AS norm_price, norm_currency FROM norm""", ("norm",))
def offers_normalized(spark, sf):
    return normalize_offers(T.offers_for_queries(spark, sf)).select(
        "query_id", "l_orderkey", "l_linenumber", "product_id", "seller_id", "amount", "src_currency",
        F.round("norm_price", 6).alias("norm_price"), "norm_currency")


@query("offers_usd", """
SELECT norm_currency, count(*) AS n, round(sum(norm_price), 2) AS total
FROM norm GROUP BY norm_currency""", ("norm",))
def offers_usd(spark, sf):
    return (normalize_offers(T.offers_for_queries(spark, sf)).groupBy("norm_currency")
            .agg(F.count("*").alias("n"), F.round(F.sum("norm_price"), 2).alias("total")))


# --- price text variants (exercise every parsing rule on real rows) -----------
def price_text(c_price="l_extendedprice", c_line="l_linenumber") -> Column:
    p2 = F.col(c_price).cast("decimal(12,2)").cast("string")
    ip = F.substring_index(p2, ".", 1)
    cents = F.substring_index(p2, ".", -1)
    n = F.length(ip)
    th = F.when(n > 3, F.concat(F.left(ip, n - 3), F.lit(","), F.right(ip, F.lit(3)))).otherwise(ip)
    india = (F.when(n <= 3, ip)
             .when(n <= 5, F.concat(F.left(ip, n - 3), F.lit(","), F.right(ip, F.lit(3))))
             .otherwise(F.concat(F.left(ip, n - 5), F.lit(","), F.left(F.right(ip, F.lit(5)), F.lit(2)),
                                 F.lit(","), F.right(ip, F.lit(3)))))
    euro = F.when(n > 3, F.concat(F.left(ip, n - 3), F.lit("."), F.right(ip, F.lit(3)), F.lit(","), cents)) \
        .otherwise(F.concat(ip, F.lit(","), cents))
    k = F.col(c_line) % 6
    return (F.when(k == 0, F.concat(F.lit("$"), th, F.lit("."), cents))
            .when(k == 1, th)
            .when(k == 2, F.concat(F.lit("₹"), india))
            .when(k == 3, F.concat(ip, F.lit(","), cents))
            .when(k == 4, euro)
            .otherwise(F.when(cents == "00", F.lit("N/A")).otherwise(F.concat(p2, F.lit(" USD")))))


def _price_text_sql(c_price="l_extendedprice", c_line="l_linenumber") -> str:
    p2 = f"CAST(CAST({c_price} AS DECIMAL(12,2)) AS VARCHAR)"
    ip = f"split_part({p2}, '.', 1)"
    cents = f"split_part({p2}, '.', 2)"
    n = f"length({ip})"
    th = f"(CASE WHEN {n} > 3 THEN left({ip}, {n} - 3) || ',' || right({ip}, 3) ELSE {ip} END)"
    india = (f"(CASE WHEN {n} <= 3 THEN {ip} WHEN {n} <= 5 THEN left({ip}, {n} - 3) || ',' || right({ip}, 3) "
             f"ELSE left({ip}, {n} - 5) || ',' || left(right({ip}, 5), 2) || ',' || right({ip}, 3) END)")
    euro = (f"(CASE WHEN {n} > 3 THEN left({ip}, {n} - 3) || '.' || right({ip}, 3) || ',' || {cents} "
            f"ELSE {ip} || ',' || {cents} END)")
    k = f"({c_line} % 6)"
    return (f"(CASE WHEN {k} = 0 THEN '$' || {th} || '.' || {cents} WHEN {k} = 1 THEN {th} "
            f"WHEN {k} = 2 THEN '₹' || {india} WHEN {k} = 3 THEN {ip} || ',' || {cents} "
            f"WHEN {k} = 4 THEN {euro} "
            f"ELSE (CASE WHEN {cents} = '00' THEN 'N/A' ELSE {p2} || ' USD' END) END)")


def _texts(spark, sf):
    return T.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", price_text().alias("price_text"))


TEXTS_SQL = f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_price_text_sql()} AS price_text
FROM lineitem"""


def _price_q(name, spark_fn, sql_fn):
    @query(name, f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, price_text, "
                 f"{sql_fn('price_text')} AS price FROM ({TEXTS_SQL})")
    def q(spark, sf):
        return _texts(spark, sf).withColumn("price", spark_fn("price_text"))
    return q


_price_q("price_clean", P.clean_price_us, S.clean_price_us)
_price_q("price_clean_in", P.clean_price_india, S.clean_price_india)
_price_q("price_clean_strip", P.clean_price_strip, S.clean_price_strip)
_price_q("price_clean_loose", P.clean_price_loose, S.clean_price_loose)


@query("currency_pick", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, price_text,
 {S.pick_currency('price_text', 'currency', "'USD'")} AS currency
FROM (SELECT t.*, CASE s.s_nationkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'INR' WHEN 2 THEN 'EUR' ELSE NULL END AS currency
      FROM ({TEXTS_SQL}) t JOIN supplier s ON t.l_suppkey = s.s_suppkey)""")
def currency_pick(spark, sf):
    s = T.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    nat = F.col("s_nationkey") % 4
    declared = F.when(nat == 0, "USD").when(nat == 1, "INR").when(nat == 2, "EUR")
    return (_texts(spark, sf).join(s, F.col("l_suppkey") == s.s_suppkey)
            .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price_text",
                    P.pick_currency("price_text", declared, F.lit("USD")).alias("currency")))


@query("shipping_cost", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ship_text,
 CASE WHEN contains(lower(ship_text), 'free') THEN '0'
      ELSE nullif(regexp_extract(ship_text, '[\\d.,]+', 0), '') END AS shipping_cost
FROM (SELECT *, CASE WHEN l_tax = 0 THEN 'FREE Shipping' WHEN l_tax < 0.04
   THEN '+$' || CAST(CAST(l_tax * 100 AS DECIMAL(6,2)) AS VARCHAR) || ' shipping' ELSE 'Shipping calculated' END AS ship_text
 FROM lineitem)""")
def shipping_cost_q(spark, sf):
    t = F.col("l_tax")
    text = (F.when(t == 0, "FREE Shipping")
            .when(t < 0.04, F.concat(F.lit("+$"), (t * 100).cast("decimal(6,2)").cast("string"), F.lit(" shipping")))
            .otherwise("Shipping calculated"))
    return (T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                  text.alias("ship_text"))
            .withColumn("shipping_cost", P.shipping_cost("ship_text")))


_RATING_TEXT = ("CASE WHEN l_quantity > 45 THEN 'No reviews yet' "
                "ELSE CAST(l_quantity / 10.0 AS VARCHAR) || ' out of 5 stars' END")


@query("rating_parse", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rating_text,
 TRY_CAST(nullif(regexp_extract(rating_text, '(\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS rating,
 CASE WHEN TRY_CAST(nullif(regexp_extract(rating_text, '(\\d+\\.?\\d*)', 1), '') AS DOUBLE) BETWEEN 0 AND 5
      THEN TRY_CAST(nullif(regexp_extract(rating_text, '(\\d+\\.?\\d*)', 1), '') AS DOUBLE) END AS rating_in
FROM (SELECT *, {_RATING_TEXT} AS rating_text FROM lineitem)""")
def rating_parse(spark, sf):
    q = F.col("l_quantity")
    text = F.when(q > 45, "No reviews yet").otherwise(F.concat((q / 10.0).cast("string"), F.lit(" out of 5 stars")))
    return (T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                  text.alias("rating_text"))
            .withColumn("rating", P.parse_rating("rating_text"))
            .withColumn("rating_in", P.parse_rating("rating_text", bounded=True)))


@query("reviews_parse", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, reviews_text,
 TRY_CAST(nullif(replace(regexp_extract(reviews_text, '([0-9,]+)', 1), ',', ''), '') AS BIGINT) AS reviews,
 CASE WHEN TRY_CAST(nullif(replace(regexp_extract(reviews_text, '([0-9,]+)', 1), ',', ''), '') AS BIGINT) > 0
  THEN TRY_CAST(nullif(replace(regexp_extract(reviews_text, '([0-9,]+)', 1), ',', ''), '') AS BIGINT) END AS reviews_in
FROM (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN 'No ratings'
  ELSE '(' || CAST(CAST(floor(l_extendedprice) AS BIGINT) % 5000 AS VARCHAR) || ' ratings)' END AS reviews_text
  FROM lineitem)""")
def reviews_parse(spark, sf):
    text = F.when(F.col("l_linenumber") % 3 == 0, "No ratings").otherwise(
        F.concat(F.lit("("), (F.floor("l_extendedprice").cast("bigint") % 5000).cast("string"), F.lit(" ratings)")))
    return (T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                  text.alias("reviews_text"))
            .withColumn("reviews", P.parse_reviews("reviews_text"))
            .withColumn("reviews_in", P.parse_reviews("reviews_text", positive_only=True)))


@query("availability_class", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, avail_text,
 CASE WHEN regexp_matches(lower(avail_text), 'out of stock|unavailable|sold out|currently out') THEN 'Out of Stock'
      WHEN regexp_matches(lower(avail_text), 'stock|available|delivery|ships') THEN 'In Stock'
      WHEN regexp_matches(lower(avail_text), 'out|sold') THEN 'Out of Stock' ELSE 'Unknown' END AS availability
FROM (SELECT *, CASE l_linestatus || l_returnflag WHEN 'OA' THEN 'In stock' WHEN 'ON' THEN 'Ships in 2 days'
  WHEN 'OR' THEN 'Currently unavailable' WHEN 'FA' THEN 'Out of Stock' WHEN 'FN' THEN 'Sold by partner'
  ELSE 'See options' END AS avail_text FROM lineitem)""")
def availability_class_q(spark, sf):
    k = F.concat("l_linestatus", "l_returnflag")
    text = (F.when(k == "OA", "In stock").when(k == "ON", "Ships in 2 days").when(k == "OR", "Currently unavailable")
            .when(k == "FA", "Out of Stock").when(k == "FN", "Sold by partner").otherwise("See options"))
    return (T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                  text.alias("avail_text"))
            .withColumn("availability", P.availability_class("avail_text")))


@query("link_product_id", """
SELECT l_orderkey, l_linenumber, product_id, seller_id, link,
 nullif(regexp_extract(link, '/(?:dp|gp/product)/([A-Z0-9]{10})', 1), '') AS asin FROM offers""", ("offers",))
def link_product_id(spark, sf):
    return T.offers(spark, sf).select("l_orderkey", "l_linenumber", "product_id", "seller_id", "link",
                                      P.link_product_id("link").alias("asin"))


@query("offer_output", f"""
SELECT query_id, l_orderkey, l_linenumber, product_id, seller_id, link,
 CAST(CAST(trunc(norm_price) AS BIGINT) AS VARCHAR) AS price, norm_currency AS currency,
 product_name AS productName, availability, rating, reviews_count AS reviewsCount, seller,
 shipping_cost AS shippingCost, source FROM norm""", ("norm",))
def offer_output(spark, sf):
    o = normalize_offers(T.offers_for_queries(spark, sf))
    return o.select("query_id", "l_orderkey", "l_linenumber", "product_id", "seller_id", "link",
                    F.col("norm_price").cast("bigint").cast("string").alias("price"),
                    F.col("norm_currency").alias("currency"), F.col("product_name").alias("productName"),
                    "availability", "rating", F.col("reviews_count").alias("reviewsCount"), "seller",
                    F.col("shipping_cost").alias("shippingCost"), "source")


@query("valid_cards", """
SELECT * FROM offers WHERE l_orderkey IS NOT NULL AND product_name IS NOT NULL AND price IS NOT NULL
 AND link IS NOT NULL AND NOT contains(lower(product_name), 'shop on ebay')""", ("offers",))
def valid_cards(spark, sf):
    o = T.offers(spark, sf).dropna(subset=["l_orderkey", "product_name", "price", "link"])
    return o.filter(~F.lower("product_name").contains("shop on ebay"))


@query("name_levenshtein", f"""
SELECT query_id, l_orderkey, l_linenumber, product_id, seller_id,
 levenshtein({S.clean_text('product_name')}, {S.clean_text('query')}) AS distance,
 round({S.levenshtein_similarity('product_name', 'query')}, 6) AS similarity FROM offers_q""", ("offers_q",))
def name_levenshtein(spark, sf):
    from ..functions.text import clean_text
    o = T.offers_for_queries(spark, sf)
    return o.select("query_id", "l_orderkey", "l_linenumber", "product_id", "seller_id",
                    F.levenshtein(clean_text("product_name"), clean_text("query")).alias("distance"),
                    F.round(levenshtein_similarity("product_name", "query"), 6).alias("similarity"))
