"""Shop selection, result summaries, price history, retrieval and document set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as AG
from ..operators.history import last_points, learn_prices, trend_of
from ..operators.rank import limit_bound
from ..operators.retrieval import Search, TokenIndex, by_shop, candidate_offers, shared_search, token_index, union_offers
from ..operators.search import ranked_results
from ..operators.shops import search_urls, shops_for_queries
from ..session import new_path, once, write_shared
from ..sources import exchange, shop_feed
from ..sources import tables as T
from ..sources.registry import SHOP_ORDER, source_registry
from . import sql_exprs as S
from .catalog import query
from .q_pricing import SCORED_SQL, scored

A = S.ARRIVAL_SQL

T.VIEW_SQL["results"] = """
SELECT query_id, l_orderkey, l_linenumber, product_id, seller_id, source, seller, product_name, rating, scraped_at,
 CAST(CAST(trunc(norm_price) AS BIGINT) AS VARCHAR) AS price,
 CAST(CAST(trunc(norm_price) AS BIGINT) AS DOUBLE) AS price_num, similarity, score, rank FROM ranked"""
T.VIEW_DEPS["results"] = ["ranked"]

def shop_front(spark, sf) -> tuple[DataFrame, TokenIndex]:
    """Offers in partitions by shop and country, and the token index of their names."""
    def build():
        offers = by_shop(T.shop_offers(spark, sf))
        return offers, token_index(offers.select("product_name").distinct())
    return once(spark, "shop-front", sf, build)


def found_offers(spark, sf) -> Search:
    """What the shops chosen by country and lists answer to the rewritten query text."""
    from .q_vectors import enhance  # it reads the trend SQL of this module
    texts = enhance(spark, sf).select("query_id", F.col("enhanced_query").alias("search_text"))
    offers, index = shop_front(spark, sf)
    return shared_search(offers, index, T.queries(spark, sf).join(texts, "query_id"))


def ranked(spark, sf) -> DataFrame:
    """The search results of every query, written once per state of the input to the shared folder.

    Summaries, exports, insights and reports all read this one table.
    """
    def build():
        bound = limit_bound(T.queries(spark, sf))
        return write_shared(ranked_results(found_offers(spark, sf), T.ARRIVAL, bound), "ranked")
    return once(spark, "ranked", sf, build)


def results(spark, sf) -> DataFrame:
    """The ranked results with the numeric output price."""
    p = F.col("norm_price").cast("bigint")
    return ranked(spark, sf).select("query_id", "l_orderkey", "l_linenumber", "product_id", "seller_id", "source", "seller",
                                    "product_name", "rating", "scraped_at", p.cast("string").alias("price"),
                                    p.cast("double").alias("price_num"), "similarity", "score", "rank")


# --- shops ------------------------------------------------------------------
def _shop_sql(where: str) -> str:
    return f"""
SELECT query_id, source, domain, currency, priority,
 row_number() OVER (PARTITION BY query_id ORDER BY priority, reg_order) AS shop_rank
FROM (SELECT q.*, r.source, r.domain, r.currency, r.priority, r.reg_order
      FROM queries q JOIN registry r ON upper(q.country) = r.country) WHERE {where}"""


_INC = "(len(include_sources) = 0 OR list_contains(list_transform(include_sources, lambda x: lower(x)), lower(source)))"
_EXC = "NOT list_contains(list_transform(exclude_sources, lambda x: lower(x)), lower(source))"


def _shops(spark, sf, mode):
    q = T.queries(spark, sf)
    if mode == "include":
        q = q.withColumn("exclude_sources", F.array().cast("array<string>"))
    elif mode == "exclude":
        q = q.withColumn("include_sources", F.array().cast("array<string>"))
    s = shops_for_queries(q, apply_lists=mode != "none")
    return s.select("query_id", "source", "domain", "currency", "priority", "shop_rank")


@query("sources_for_country", _shop_sql("TRUE"), ("queries", "registry"))
def sources_for_country(spark, sf):
    return _shops(spark, sf, "none")


@query("include_sources", _shop_sql(_INC), ("queries", "registry"))
def include_sources(spark, sf):
    return _shops(spark, sf, "include")


@query("exclude_sources", _shop_sql(_EXC), ("queries", "registry"))
def exclude_sources(spark, sf):
    return _shops(spark, sf, "exclude")


@query("source_registry", """
SELECT o.source, o.n_offers, count(r.country) AS n_countries, min(r.priority) AS priority
FROM (SELECT source, count(*) AS n_offers FROM offers GROUP BY source) o
LEFT JOIN registry r ON o.source = r.source GROUP BY o.source, o.n_offers""", ("offers", "registry"))
def source_registry_q(spark, sf):
    o = T.offers(spark, sf).groupBy("source").agg(F.count("*").alias("n_offers"))
    r = F.broadcast(source_registry(spark))
    return (o.join(r, "source", "left").groupBy("source", "n_offers")
            .agg(F.count("country").alias("n_countries"), F.min("priority").alias("priority")))


_SHOPS_SQL = ", ".join(f"('{s}')" for s in SHOP_ORDER)


@query("url_frontier", f"""
SELECT f.query_id, f.source,
 replace(replace(t.url_template, '{{domain}}', coalesce(CASE WHEN h.domain IS NOT NULL THEN h.domain
   WHEN f.source IN ('Amazon', 'eBay') THEN u.domain END, '')), '{{q}}', replace(url_encode(f.query), '%20', '+')) AS url
FROM (SELECT q.query_id, q.query, upper(q.country) AS country, s.source
      FROM queries q, (VALUES {_SHOPS_SQL}) s(source)) f
LEFT JOIN registry h ON f.source = h.source AND f.country = h.country
LEFT JOIN (SELECT source, domain FROM registry WHERE country = 'US') u ON f.source = u.source
LEFT JOIN (SELECT DISTINCT source, url_template FROM registry) t ON f.source = t.source""",
       ("queries", "registry"))
def url_frontier(spark, sf):
    return search_urls(T.queries(spark, sf))


# --- result summaries ---------------------------------------------------------
@query("price_stats", """
SELECT query_id, n, min_price, max_price, round(avg_price, 6) AS avg_price, max_price - min_price AS spread,
 (max_price - min_price) > avg_price * 0.3 AS high_spread
FROM (SELECT query_id, count(*) AS n, min(price_num) AS min_price, max(price_num) AS max_price,
      avg(price_num) AS avg_price FROM results GROUP BY query_id) WHERE n >= 2""", ("results",))
def price_stats(spark, sf):
    s = AG.price_stats(results(spark, sf))
    return s.withColumn("avg_price", F.round("avg_price", 6))


@query("price_verdict", """
SELECT s.query_id, s.min_price, e.exp_min, e.exp_max,
 CASE WHEN e.exp_min IS NULL THEN NULL WHEN s.min_price < e.exp_min THEN 'deal'
      WHEN s.min_price > e.exp_max THEN 'high' ELSE 'none' END AS verdict
FROM (SELECT query_id, count(*) AS n, min(price_num) AS min_price FROM results GROUP BY query_id HAVING count(*) >= 2) s
LEFT JOIN (SELECT product_id AS query_id, min(price) AS exp_min, max(price) AS exp_max
           FROM price_points GROUP BY product_id) e ON s.query_id = e.query_id""", ("results", "price_points"))
def price_verdict(spark, sf):
    st = AG.price_stats(results(spark, sf))
    rng = AG.product_price_range(T.price_points(spark, sf)).select(
        F.col("product_id").alias("query_id"), F.col("price_min").alias("exp_min"),
        F.col("price_max").alias("exp_max"))
    return AG.price_verdict(st, rng).select("query_id", "min_price", "exp_min", "exp_max", "verdict")


@query("best_deal", """
SELECT query_id, price AS best_price, seller AS best_seller, rank AS best_rank FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY price_num, rank) AS rn FROM results) WHERE rn = 1""",
       ("results",))
def best_deal(spark, sf):
    return AG.best_deal(results(spark, sf))


@query("seller_summary", """
SELECT s.*, n.n_sellers FROM (
 SELECT query_id, coalesce(seller, 'Unknown') AS seller_key, count(*) AS n_offers, min(price_num) AS min_price,
  max(price_num) AS max_price, min(rank) AS first_seen, arg_min(price, rank) AS first_price
 FROM results GROUP BY query_id, coalesce(seller, 'Unknown')) s
JOIN (SELECT query_id, count(DISTINCT coalesce(seller, 'Unknown')) AS n_sellers FROM results GROUP BY query_id) n
 ON s.query_id = n.query_id""", ("results",))
def seller_summary(spark, sf):
    return AG.seller_summary(results(spark, sf))


@query("rating_summary", """
SELECT a.query_id, round(a.avg_rating, 6) AS avg_rating, b.rating AS best_rating, b.seller AS best_rated_seller
FROM (SELECT query_id, avg(rating) AS avg_rating FROM results WHERE rating IS NOT NULL AND rating <> 0
      GROUP BY query_id) a
JOIN (SELECT * FROM (SELECT query_id, rating, seller, row_number() OVER (PARTITION BY query_id
      ORDER BY rating DESC, rank) AS rn FROM results WHERE rating IS NOT NULL AND rating <> 0) WHERE rn = 1) b
 ON a.query_id = b.query_id""", ("results",))
def rating_summary(spark, sf):
    return AG.rating_summary(results(spark, sf)).withColumn("avg_rating", F.round("avg_rating", 6))


@query("group_best", f"""
SELECT query_id, product_name, group_size, l_orderkey, l_linenumber, seller_id, round(similarity, 6) AS similarity,
 substr(md5(product_name), 1, 8) AS group_id FROM (
 SELECT *, count(*) OVER (PARTITION BY query_id, product_name) AS group_size,
  row_number() OVER (PARTITION BY query_id, product_name ORDER BY similarity DESC, norm_price, {A}) AS rn
 FROM ({SCORED_SQL})) WHERE rn = 1""", ("norm",))
def group_best(spark, sf):
    g = AG.group_best(scored(spark, sf), ["query_id", "product_name"],
                      ["scraped_at", "l_orderkey", "l_linenumber", "product_id", "seller_id"])
    return g.select("query_id", "product_name", "group_size", "l_orderkey", "l_linenumber", "seller_id",
                    F.round(-F.col("ns"), 6).alias("similarity"), "group_id")


@query("export_top3", """
SELECT query_id, to_json(list(struct_pack(rank := rank, productName := product_name, price := price,
 source := source) ORDER BY rank)) AS top3 FROM results WHERE rank <= 3 GROUP BY query_id""", ("results",))
def export_top3(spark, sf):
    r = results(spark, sf).filter(F.col("rank") <= 3)
    return r.groupBy("query_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(
        "rank", F.col("product_name").alias("productName"), "price", "source")))).alias("top3"))


@query("export_markets", """
SELECT q.country, r.query_id, q.query, r.rank, r.product_name, r.price, r.source
FROM results r JOIN queries q ON r.query_id = q.query_id WHERE r.rank <= 3""", ("results", "queries"))
def export_markets_q(spark, sf):
    """The first results of every query as nested JSON files per market, read back."""
    q = T.queries(spark, sf).select("query_id", "query", "country")
    path = new_path(spark, "markets")
    exchange.export_markets(results(spark, sf).join(q, "query_id"), path)
    r = exchange.read_markets(spark, path).select("country", "query_id", "query", F.inline("results"))
    return r.withColumnRenamed("productName", "product_name")


# --- price history -------------------------------------------------------------
@query("product_price_range", """
SELECT product_id, min(price) AS price_min, max(price) AS price_max, round(avg(price), 6) AS price_avg
FROM price_points GROUP BY product_id""", ("price_points",))
def product_price_range(spark, sf):
    return AG.product_price_range(T.price_points(spark, sf)).withColumn("price_avg", F.round("price_avg", 6))


def last30_sql(points: str) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id
  ORDER BY observed_at DESC, seq DESC, seq2 DESC) AS rn FROM {points}) WHERE rn <= 30"""


@query("price_history_last30", f"SELECT product_id, observed_at, seq, seq2, price, source, rn FROM ({last30_sql('price_points')})",
       ("price_points",))
def price_history_last30(spark, sf):
    return last_points(T.price_points(spark, sf)).select(
        "product_id", "observed_at", "seq", "seq2", "price", "source", F.col("rn").cast("bigint").alias("rn"))


def trend_sql(points: str) -> str:
    """Current price, trend and name per product of a point table."""
    return f"""
SELECT product_id, n_points, current_price, last_updated, oldest_kept, product_name,
 CASE WHEN n_points < 3 THEN 'stable' WHEN current_price > third_price THEN 'increasing'
      WHEN current_price < third_price THEN 'decreasing' ELSE 'stable' END AS price_trend
FROM (SELECT product_id, count(*) AS n_points, max(CASE WHEN rn = 1 THEN price END) AS current_price,
  max(CASE WHEN rn = 3 THEN price END) AS third_price, max(CASE WHEN rn = 1 THEN observed_at END) AS last_updated,
  min(observed_at) AS oldest_kept, max(CASE WHEN rn = 1 THEN product_name END) AS product_name
  FROM ({last30_sql(points)}) GROUP BY product_id)"""


_TREND_SQL = trend_sql("price_points")


@query("price_trend", f"SELECT product_id, n_points, price_trend FROM ({_TREND_SQL})", ("price_points",))
def price_trend(spark, sf):
    return trend_of(last_points(T.price_points(spark, sf))).select("product_id", "n_points", "price_trend")


@query("current_price", f"SELECT product_id, current_price, last_updated FROM ({_TREND_SQL})", ("price_points",))
def current_price(spark, sf):
    return trend_of(last_points(T.price_points(spark, sf))).select("product_id", "current_price", "last_updated")


@query("price_learning_batch", f"""
SELECT *, 'Monitor for trends' AS best_time_to_buy, CAST(NULL AS DOUBLE) AS price_prediction,
 'Insufficient data for analysis' AS market_analysis FROM ({_TREND_SQL})""", ("price_points",))
def price_learning_batch(spark, sf):
    return learn_prices(T.price_points(spark, sf))


@query("kb_stats", """
SELECT 'n_products' AS metric, count(*) AS value FROM part
UNION ALL SELECT 'n_insight_products', count(DISTINCT product_id) FROM price_points
UNION ALL SELECT 'n_documents', count(*) FROM embeddings
UNION ALL SELECT 'vector_dim', max(len(embedding)) FROM embeddings""", ("price_points",))
def kb_stats(spark, sf):
    """A9 in long form (metric, value): one small aggregate per table, no joins."""
    a = T.table(spark, sf, "part").agg(F.lit("n_products").alias("metric"), F.count("*").alias("value"))
    b = T.price_points(spark, sf).agg(F.lit("n_insight_products").alias("metric"),
                                      F.countDistinct("product_id").alias("value"))
    e = T.table(spark, sf, "embeddings")
    c = e.agg(F.lit("n_documents").alias("metric"), F.count("*").alias("value"))
    d = e.agg(F.lit("vector_dim").alias("metric"), F.max(F.size("embedding")).cast("bigint").alias("value"))
    return a.unionByName(b).unionByName(c).unionByName(d)


# --- retrieval and set operations --------------------------------------------------
@query("candidate_offers", f"""
WITH nt AS (SELECT DISTINCT product_name, token FROM (SELECT product_name,
   unnest(string_split({S.clean_text('product_name')}, ' ')) AS token FROM (SELECT DISTINCT product_name FROM offers))
   WHERE token <> ''),
 qt AS (SELECT DISTINCT query_id, token FROM (SELECT query_id,
   unnest(string_split({S.clean_text('query')}, ' ')) AS token FROM queries) WHERE token <> ''),
 need AS (SELECT query_id, ceil(count(*) * 1.0) AS need FROM qt GROUP BY query_id),
 hits AS (SELECT qt.query_id, nt.product_name, count(*) AS shared FROM qt JOIN nt ON qt.token = nt.token
   GROUP BY qt.query_id, nt.product_name)
SELECT h.query_id, o.l_orderkey, o.l_linenumber, o.product_id, o.seller_id, h.shared
FROM hits h JOIN need n ON h.query_id = n.query_id AND h.shared >= n.need
JOIN offers o ON o.product_name = h.product_name""", ("offers", "queries"))
def candidate_offers_q(spark, sf):
    c = candidate_offers(T.offers(spark, sf), T.queries(spark, sf), index=shop_front(spark, sf)[1])
    return c.select("query_id", "l_orderkey", "l_linenumber", "product_id", "seller_id", "shared")


@query("offers_union", "SELECT source, count(*) AS n FROM offers GROUP BY source", ("offers",))
def offers_union(spark, sf):
    o = T.offers(spark, sf)
    shops = ["Amazon", "Apple", "BestBuy", "Walmart", "Target", "eBay"]
    parts = [o.filter(F.col("source") == s) for s in shops]
    parts.append(o.filter(~F.col("source").isin(*shops)).drop("link"))  # a shop without links
    return union_offers(parts).groupBy("source").agg(F.count("*").alias("n"))


def _docs(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars",
                                                  F.md5("text").alias("text_md5"))


def _feed(spark, sf) -> str:
    """A shop feed of all offers, written once per state of the input: Parquet files by shop and country."""
    def build():
        offers = T.shop_offers(spark, sf).select(*[c.split()[0] for c in shop_feed.SCHEMA.split(", ")])
        return by_shop(offers).inputFiles()[0].split("/shop=")[0]
    return once(spark, "shop-feed", sf, build)


@query("shop_feed_offers", """
SELECT shop, shop_country, availability, count(*) AS n, sum(reviews_count) AS n_reviews, min(product_name) AS first_name
FROM shop_offers WHERE shop IN ('Amazon', 'Flipkart', 'Walmart', 'Other') AND shop_country IN ('US', 'IN')
 AND (shop, shop_country) IN (SELECT (source, country) FROM registry) GROUP BY ALL""", ("shop_offers", "registry"))
def shop_feed_offers(spark, sf):
    """Registered shops read as a table by the data source, filters on shop and country pushed into it."""
    feed = shop_feed.read_feed(spark, _feed(spark, sf))
    asked = feed.where(F.col("shop").isin("Amazon", "Flipkart", "Walmart", "Other") & F.col("shop_country").isin("US", "IN"))
    return asked.groupBy("shop", "shop_country", "availability").agg(
        F.count("*").alias("n"), F.sum("reviews_count").alias("n_reviews"), F.min("product_name").alias("first_name"))


_SENT = """CASE WHEN l_orderkey % 101 = 7 THEN 'unreadable'
 WHEN l_orderkey % 103 = 9 AND l_orderkey % 107 = 11 THEN 'without product_id, product_name, price' WHEN l_orderkey % 103 = 9 THEN 'without price'
 WHEN l_orderkey % 107 = 11 THEN 'without product_id, product_name' ELSE 'good' END"""


@query("offers_rejected", f"""
SELECT source, {_SENT} AS outcome, count(*) AS n, sum(CASE WHEN {_SENT} = 'good' THEN product_id END) AS product_ids
FROM offers GROUP BY ALL""", ("offers",))
def offers_rejected(spark, sf):
    """Shop outputs as JSON lines, some cut short or incomplete, read back; good and rejected rows add up to the lines sent."""
    sent = T.offers(spark, sf).select("source", "l_orderkey", F.struct(
        "l_orderkey", "l_linenumber", "seller_id", "source", "currency",
        *[F.when(F.col("l_orderkey") % 107 != 11, F.col(c)).alias(c) for c in ("product_id", "product_name")],
        F.when(F.col("l_orderkey") % 103 != 9, F.col("price")).alias("price")).alias("o"))
    line = F.to_json("o")
    line = F.when(F.col("l_orderkey") % 101 == 7, F.expr("left(line, length(line) - 5)")).otherwise(F.col("line"))
    path = new_path(spark, "shop-lines")
    sent.select(F.to_json("o").alias("line"), "l_orderkey").select(line.alias("value")).write.text(path)
    good, rejects = exchange.read_shop_lines(spark, path)
    shop = F.regexp_extract("line", '"source":"([^"]*)"', 1)
    parts = [good.select("source", F.lit("good").alias("outcome"), "product_id"),
             rejects.select(shop.alias("source"), F.col("reason").alias("outcome"), F.lit(None).cast("long").alias("product_id"))]
    return union_offers(parts).groupBy("source", "outcome").agg(F.count("*").alias("n"), F.sum("product_id").alias("product_ids"))


_DOCS_SQL = "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents"


@query("docs_by_id", f"SELECT * FROM ({_DOCS_SQL}) WHERE doc_id IN (SELECT doc_id FROM labels)")
def docs_by_id(spark, sf):
    return _docs(spark, sf).join(T.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")


@query("docs_delete", f"SELECT * FROM ({_DOCS_SQL}) WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def docs_delete(spark, sf):
    return _docs(spark, sf).join(T.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("docs_upsert", f"""
SELECT d.*, d.doc_id NOT IN (SELECT doc_id FROM labels) AS is_new FROM ({_DOCS_SQL}) d""")
def docs_upsert(spark, sf):
    """The labelled documents are the stored set; add only incoming ids that are new."""
    docs = _docs(spark, sf)
    ids = T.table(spark, sf, "labels").select("doc_id")
    stored = docs.join(ids, "doc_id", "left_semi").withColumn("is_new", F.lit(False))
    cols = [c for c in docs.columns if c != "doc_id"]  # of rows that share an id the smallest is added
    incoming = docs.groupBy("doc_id").agg(F.min(F.struct(*cols)).alias("r")).select("doc_id", "r.*")
    new = incoming.join(stored.select("doc_id"), "doc_id", "left_anti").withColumn("is_new", F.lit(True))
    return stored.unionByName(new)


@query("doc_ids", """
SELECT doc_id, md5(text) || '_' || md5('{"lang": "' || lang || '", "source": "' || source || '"}') AS doc_key
FROM documents""")
def doc_ids(spark, sf):
    from ..functions.ids import document_id
    d = T.table(spark, sf, "documents")
    return d.select("doc_id", document_id("text", {"lang": F.col("lang"), "source": F.col("source")}).alias("doc_key"))


@query("slug_ids", """
SELECT p_partkey, lower(replace(p_brand || ' ' || p_name, ' ', '_')) AS knowledge_id,
 lower(replace(p_name, ' ', '_')) AS price_id FROM part""")
def slug_ids(spark, sf):
    from ..functions.text import slug
    p = T.table(spark, sf, "part")
    return p.select("p_partkey", slug(F.concat_ws(" ", "p_brand", "p_name")).alias("knowledge_id"),
                    slug("p_name").alias("price_id"))
