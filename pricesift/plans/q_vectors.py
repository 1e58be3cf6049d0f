"""Vector search, knowledge lookups and the query enhancer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features as FT
from ..functions.text import slug
from ..operators.encoder import DIM, document_weights, term_counts
from ..operators.history import learn_prices
from ..operators.knn import knn_topk, l2_norm, normalize
from ..operators.sparse_index import build_index, search
from ..operators.vector_index import build, index_topk
from ..session import once, write_shared
from ..settings import DEFAULT
from ..sources import tables as T
from . import sql_exprs as S
from .catalog import query
from .q_relational import trend_sql
from .q_text import _query_features_sql, hints_sql


def _cos_sql(a: str, b: str) -> str:
    da, db = f"CAST({a} AS DOUBLE[])", f"CAST({b} AS DOUBLE[])"
    return (f"(list_dot_product({da}, {db}) / (sqrt(list_dot_product({da}, {da})) * "
            f"sqrt(list_dot_product({db}, {db}))))")


def _docs(spark, sf) -> DataFrame:
    return T.kb_docs(spark, sf)


@query("knn_topk", f"""
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (
 SELECT a.vec_id AS query_id, b.vec_id AS doc_id, {_cos_sql('a.embedding', 'b.embedding')} AS score,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY {_cos_sql('a.embedding', 'b.embedding')} DESC, b.vec_id) AS rank
 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 5 AND score >= 0.3""")
def knn_topk_q(spark, sf):
    """Five nearest other documents per document, score >= 0.3."""
    d = _docs(spark, sf)
    q = d.select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("qvec"))
    r = knn_topk(q, d, 5, exclude_self=True, min_score=DEFAULT.min_score)
    return r.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def _every_20th(spark, sf) -> DataFrame:
    return _docs(spark, sf).where(F.col("doc_id") % 20 == 0).select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("qvec"))


def vector_index(spark, sf):
    """The index of all embeddings, written once per state of the input."""
    return once(spark, "vector-index", sf, lambda: build(_docs(spark, sf)))


@query("knn_index", None)
def knn_index(spark, sf):
    """J8 through the inverted file: approximate, all rows indexed, every twentieth id as a query (recall is tested)."""
    r = index_topk(vector_index(spark, sf), _every_20th(spark, sf), 5, exclude_self=True, min_score=DEFAULT.min_score)
    return r.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("knn_index_exact", f"""
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (
 SELECT a.vec_id AS query_id, b.vec_id AS doc_id, {_cos_sql('a.embedding', 'b.embedding')} AS score,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY {_cos_sql('a.embedding', 'b.embedding')} DESC, b.vec_id) AS rank
 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE rank <= 5 AND score >= 0.3""")
def knn_index_exact(spark, sf):
    """J8 through the inverted file with the bound on the cells left: nothing is missed."""
    r = index_topk(vector_index(spark, sf), _every_20th(spark, sf), 5, exact=True, exclude_self=True, min_score=DEFAULT.min_score)
    return r.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("normalize_vectors", """
SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm,
 round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x /
   sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))))), 6) AS unit_sum
FROM embeddings""")
def normalize_vectors(spark, sf):
    e = T.table(spark, sf, "embeddings")
    u = normalize("embedding")
    return e.select("vec_id", F.round(l2_norm("embedding"), 6).alias("norm"),
                    F.round(F.aggregate(u, F.lit(0.0), lambda a, x: a + x), 6).alias("unit_sum"))


# --- encoded texts ---------------------------------------------------------------------
T.VIEW_SQL["kb_terms"] = f"""
SELECT doc_id, CAST('0x' || substr(md5(token), 1, 7) AS BIGINT) % {DIM} AS place, count(*) AS n
FROM (SELECT doc_id, unnest({S.tokens('text')}) AS token FROM kb_texts) GROUP BY ALL"""
T.VIEW_SQL["kb_weights"] = """
SELECT place, ln(((SELECT count(*) FROM kb_texts) + 1.0) / (count(*) + 1)) AS idf FROM kb_terms GROUP BY place"""
T.VIEW_SQL["kb_vectors"] = """
SELECT doc_id, place, w, sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS norm
FROM (SELECT doc_id, place, CAST(CAST(n * idf AS FLOAT) AS DOUBLE) AS w FROM kb_terms JOIN kb_weights USING (place))"""
T.VIEW_DEPS |= {"kb_terms": ["kb_texts"], "kb_weights": ["kb_terms", "kb_texts"], "kb_vectors": ["kb_terms", "kb_weights"]}


def _hits_sql(texts: str) -> str:
    """Best document (score >= 0.3) of each (id, text) row of ``texts``."""
    return f"""
SELECT id, doc_id AS hit_doc_id, score AS confidence FROM (
 SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, doc_id) AS rn FROM (
  SELECT q.id, d.doc_id, round(sum(q.w * d.w) / (any_value(q.norm) * any_value(d.norm)), 9) AS score FROM (
   SELECT id, place, w, sqrt(sum(w * w) OVER (PARTITION BY id)) AS norm FROM (
    SELECT id, place, CAST(CAST(count(*) * any_value(idf) AS FLOAT) AS DOUBLE) AS w FROM (
     SELECT id, CAST('0x' || substr(md5(token), 1, 7) AS BIGINT) % {DIM} AS place
     FROM (SELECT id, unnest({S.tokens('text')}) AS token FROM ({texts}))) JOIN kb_weights USING (place) GROUP BY id, place)) q
  JOIN kb_vectors d ON q.place = d.place WHERE q.norm > 0 AND d.norm > 0 GROUP BY q.id, d.doc_id)) WHERE rn = 1 AND score >= 0.3"""


T.VIEW_SQL["query_hits"] = f"""
SELECT h.id AS query_id, h.hit_doc_id, h.confidence, d.type AS hit_type, d.product_id AS hit_product, d.name AS hit_name
FROM ({_hits_sql('SELECT query_id AS id, query AS text FROM queries')}) h JOIN kb_texts d ON h.hit_doc_id = d.doc_id"""
T.VIEW_DEPS["query_hits"] = ["queries", "kb_texts", "kb_weights", "kb_vectors"]


def text_index(spark, sf):
    """The inverted index of the knowledge texts, written once per session and input."""
    def build():
        docs = T.kb_texts(spark, sf)
        counts = write_shared(term_counts(docs, "doc_id", "text"), "kb-terms")
        return build_index(counts, document_weights(counts, docs.count()))
    return once(spark, "text-index", sf, build)


def text_hits(spark, sf, texts: DataFrame, k: int = 1) -> DataFrame:
    """J8 on encoded texts: up to ``k`` knowledge texts (score >= 0.3) per (id, text) row, best first."""
    docs = T.kb_texts(spark, sf)
    hits = search(text_index(spark, sf), term_counts(texts, "id", "text"), k, DEFAULT.min_score)
    meta = docs.select("doc_id", F.col("type").alias("hit_type"), F.col("product_id").alias("hit_product"), F.col("name").alias("hit_name"))
    # The size of ``part`` on disk says little about its texts: without the hint all of them may be broadcast by the driver.
    return hits.join(meta.hint("merge"), "doc_id").select("id", F.col("doc_id").alias("hit_doc_id"), F.col("score").alias("confidence"),
                                            "rank", "hit_type", "hit_product", "hit_name")


@query("knowledge_search", f"""
SELECT query_id, hit_doc_id, round(confidence, 6) AS score, hit_type, hit_name FROM query_hits""", ("query_hits",))
def knowledge_search(spark, sf):
    """J8/P13 from text: the best knowledge text of every query, if any reaches 0.3."""
    return _best_hits(spark, sf).select("query_id", "hit_doc_id", F.round("confidence", 6).alias("score"), "hit_type", "hit_name")


# --- enhancer ------------------------------------------------------------------------
def _best_hits(spark, sf):
    """The best hit of every query, one written table per session and input for all that read it."""
    def build():
        q = T.queries(spark, sf).select(F.col("query_id").alias("id"), F.col("query").alias("text"))
        return write_shared(text_hits(spark, sf, q).withColumnRenamed("id", "query_id").drop("rank"), "query-hits")
    return once(spark, "query-hits", sf, build)


def _slug_points(spark, sf, slugs: DataFrame) -> DataFrame:
    """Price points keyed by the slug of the product's name, of the given slugs only."""
    named = T.named_parts(spark, sf).join(slugs.select(F.col("product_id").alias("_slug")), slug("name") == F.col("_slug"), "left_semi")
    return T.price_points(spark, sf, named).withColumn("product_id", slug("product_name"))


T.VIEW_SQL["slug_points"] = "SELECT * REPLACE (lower(replace(product_name, ' ', '_')) AS product_id) FROM price_points"
T.VIEW_DEPS["slug_points"] = ["price_points"]


def enhance(spark, sf) -> DataFrame:
    """F13 + J9 + J10 + F14 + P14 for every query at once, written once per session and input."""
    return once(spark, "enhanced", sf, lambda: write_shared(_enhance(spark, sf), "enhanced"))


def _hit_products(hits: DataFrame) -> DataFrame:
    return hits.select(F.col("hit_product").alias("product_id")).distinct()


def _enhance(spark, sf) -> DataFrame:
    """Knowledge and learned prices are read for the hits only."""
    s = DEFAULT
    f = FT.query_features("query")
    q = T.queries(spark, sf).select("query_id", "query", "country", f.alias("f"))
    hits = _best_hits(spark, sf)
    kb = T.knowledge(spark, sf, _hit_products(hits)).withColumnRenamed("product_id", "hit_product")
    slugs = hits.select(slug("hit_name").alias("product_id")).distinct()
    ins = learn_prices(_slug_points(spark, sf, slugs)).select(
        F.col("product_id").alias("hit_slug"), "current_price", "price_trend", "best_time_to_buy")
    # One row per query on every side, so no side is the driver's to broadcast.
    j = (q.join(hits.withColumn("hit_slug", slug("hit_name")).hint("merge"), "query_id", "left")
         .join(kb.hint("merge"), "hit_product", "left").join(ins.hint("merge"), "hit_slug", "left"))
    gate = (F.coalesce(F.col("confidence"), F.lit(0.0)) > s.enhance_gate) & (F.col("hit_type") == "product_knowledge") \
        & F.col("product_name").isNotNull()
    add_storage = F.when(gate & F.col("f.storage").isNull() & (F.size("storage_options") > 0),
                         F.element_at("storage_options", 1))
    add_brand = F.when(gate & F.col("f.brand").isNull(), F.col("brand"))
    lq = F.lower("query")
    india = F.upper("country") == "IN"
    suffix = (F.when(india & (lq.contains("iphone") | lq.contains("apple")), " India official")
              .when(india & (lq.contains("samsung") | lq.contains("oneplus")), " India variant").otherwise(""))
    return j.select(
        "query_id", "query", "country", F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        "hit_doc_id", "hit_type", "hit_name",
        F.concat(F.concat_ws(" ", "query", add_storage, add_brand), suffix).alias("enhanced_query"),
        F.coalesce(F.col("f.storage"), add_storage).alias("storage"),
        F.coalesce(F.col("f.brand"), add_brand).alias("brand"),
        F.when(gate, F.slice("alternatives", 1, 3)).otherwise(F.array().cast("array<string>")).alias("alternatives"),
        F.when(gate, F.col("price_min")).alias("exp_min"), F.when(gate, F.col("price_max")).alias("exp_max"),
        F.when(gate, F.col("market_insights")).alias("market_insights"),
        F.when(gate, F.col("current_price")).alias("current_price"),
        F.when(gate, F.col("price_trend")).alias("price_trend"),
        F.when(gate, F.col("best_time_to_buy")).alias("best_time_to_buy"),
        F.col("f").alias("features"))


T.VIEW_SQL["enhanced"] = f"""
SELECT q.query_id, q.query, q.country, coalesce(b.confidence, 0.0) AS confidence, b.hit_doc_id, b.hit_type, b.hit_name,
 q.query || CASE WHEN g.gate AND q.storage IS NULL AND len(k.storage_options) > 0 THEN ' ' || k.storage_options[1] ELSE '' END
  || CASE WHEN g.gate AND q.brand IS NULL THEN ' ' || k.brand ELSE '' END
  || CASE WHEN upper(q.country) = 'IN' AND (contains(lower(q.query), 'iphone') OR contains(lower(q.query), 'apple'))
          THEN ' India official' WHEN upper(q.country) = 'IN' AND (contains(lower(q.query), 'samsung')
          OR contains(lower(q.query), 'oneplus')) THEN ' India variant' ELSE '' END AS enhanced_query,
 coalesce(q.storage, CASE WHEN g.gate AND len(k.storage_options) > 0 THEN k.storage_options[1] END) AS storage,
 coalesce(q.brand, CASE WHEN g.gate THEN k.brand END) AS brand,
 CASE WHEN g.gate THEN k.alternatives[1:3] ELSE [] END AS alternatives,
 CASE WHEN g.gate THEN k.price_min END AS exp_min, CASE WHEN g.gate THEN k.price_max END AS exp_max,
 CASE WHEN g.gate THEN k.market_insights END AS market_insights,
 CASE WHEN g.gate THEN i.current_price END AS current_price, CASE WHEN g.gate THEN i.price_trend END AS price_trend,
 CASE WHEN g.gate THEN 'Monitor for trends' END AS best_time_to_buy
FROM (SELECT query_id, query, country, {_query_features_sql('query')} FROM queries) q
LEFT JOIN query_hits b ON q.query_id = b.query_id
LEFT JOIN knowledge k ON b.hit_product = k.product_id
LEFT JOIN ({trend_sql('slug_points')}) i ON lower(replace(b.hit_name, ' ', '_')) = i.product_id
CROSS JOIN LATERAL (SELECT coalesce(b.confidence, 0.0) > 0.5 AND b.hit_type = 'product_knowledge'
                    AND k.product_name IS NOT NULL AS gate) g"""
T.VIEW_DEPS["enhanced"] = ["queries", "query_hits", "knowledge", "slug_points"]


@query("enhance_queries", """
SELECT query_id, round(confidence, 6) AS confidence, hit_doc_id, hit_type, enhanced_query, storage, brand,
 array_to_string(alternatives, '|') AS alternatives FROM enhanced""", ("enhanced",))
def enhance_queries(spark, sf):
    e = enhance(spark, sf)
    return e.select("query_id", F.round("confidence", 6).alias("confidence"), "hit_doc_id", "hit_type",
                    "enhanced_query", "storage", "brand", F.array_join("alternatives", "|").alias("alternatives"))


@query("price_context", """
SELECT query_id, round(exp_min, 6) AS exp_min, round(exp_max, 6) AS exp_max, market_insights,
 round(current_price, 6) AS current_price, price_trend, best_time_to_buy FROM enhanced""", ("enhanced",))
def price_context(spark, sf):
    """J10 + F14: price expectations of the matched product, its learned prices found by the slug of its name."""
    e = enhance(spark, sf)
    return e.select("query_id", F.round("exp_min", 6).alias("exp_min"), F.round("exp_max", 6).alias("exp_max"),
                    "market_insights", F.round("current_price", 6).alias("current_price"), "price_trend",
                    "best_time_to_buy")


@query("alternatives", """
SELECT q.query_id, b.hit_doc_id,
 CASE WHEN b.hit_type = 'product_knowledge' THEN array_to_string(k.alternatives, '|') ELSE '' END AS alternatives
FROM queries q LEFT JOIN query_hits b ON q.query_id = b.query_id
LEFT JOIN knowledge k ON b.hit_product = k.product_id""", ("queries", "query_hits", "knowledge"))
def alternatives(spark, sf):
    """Alternatives of the single best hit, only when it is a product document."""
    hits = _best_hits(spark, sf)
    kb = T.knowledge(spark, sf, _hit_products(hits)).select(F.col("product_id").alias("hit_product"), "alternatives")
    h = hits.join(kb.hint("merge"), "hit_product", "left")
    q = T.queries(spark, sf).select("query_id")
    return q.join(h.hint("merge"), "query_id", "left").select(
        "query_id", "hit_doc_id",
        F.when(F.col("hit_type") == "product_knowledge", F.array_join("alternatives", "|"))
         .otherwise(F.lit("")).alias("alternatives"))


T.VIEW_SQL["bands"] = f"""
SELECT a.query_id, a.pos, CASE WHEN h.id IS NULL THEN '• ' || a.alt
  ELSE '• ' || a.alt || ' ($' || CAST(k.price_min AS VARCHAR) || ' - $' || CAST(k.price_max AS VARCHAR) || ')' END AS line
FROM (SELECT e.query_id, u.pos, u.alt FROM enhanced e,
   LATERAL (SELECT unnest(generate_series(1, len(e.alternatives))) AS pos, unnest(e.alternatives) AS alt) u) a
LEFT JOIN (SELECT h.id, d.type, d.product_id FROM (
  {_hits_sql('SELECT DISTINCT name AS id, name AS text FROM catalogue WHERE name IN (SELECT unnest(alternatives) FROM enhanced)')}) h
  JOIN kb_texts d ON h.hit_doc_id = d.doc_id) h ON a.alt = h.id
LEFT JOIN knowledge k ON h.product_id = k.product_id
WHERE h.id IS NULL OR h.type = 'product_knowledge'"""
T.VIEW_DEPS["bands"] = ["enhanced", "catalogue", "kb_texts", "kb_weights", "kb_vectors", "knowledge"]


def bands(spark, sf) -> DataFrame:
    """J12 for the enhanced queries, written once per session and input for all that read it."""
    return once(spark, "bands", sf, lambda: write_shared(_bands(spark, sf, enhance(spark, sf)), "bands"))


def _bands(spark, sf, enhanced: DataFrame) -> DataFrame:
    """For each alternative of each query, its best hit's price band (or the bare name)."""
    e = enhanced.select("query_id", F.posexplode("alternatives").alias("pos0", "alt"))
    names = write_shared(e.select("alt").distinct().select(F.xxhash64("alt").alias("id"), F.col("alt").alias("text")), "alternatives")
    hits = text_hits(spark, sf, names).join(names, "id").select(F.col("text").alias("alt"), "hit_type", "hit_product")
    hits = write_shared(hits, "alternative-hits")  # read twice below
    ranges = T.price_ranges(spark, sf, _hit_products(hits)).select(F.col("product_id").alias("hit_product"), "price_min", "price_max")
    j = (e.join(hits.join(ranges.hint("merge"), "hit_product", "left").hint("merge"), "alt", "left")
         .filter(F.col("hit_type").isNull() | (F.col("hit_type") == "product_knowledge")))
    band = F.concat(F.lit("• "), F.col("alt"), F.lit(" ($"), F.col("price_min").cast("string"), F.lit(" - $"),
                    F.col("price_max").cast("string"), F.lit(")"))
    line = F.when(F.col("hit_type").isNull(), F.concat(F.lit("• "), F.col("alt"))).otherwise(band)
    return j.select("query_id", (F.col("pos0") + 1).cast("bigint").alias("pos"), line.alias("line"))


@query("alternative_bands", "SELECT * FROM bands", ("bands",))
def alternative_bands(spark, sf):
    return bands(spark, sf)


@query("query_context", f"""
SELECT q.query_id,
 (CASE WHEN q.storage IS NULL THEN 0 ELSE 1 END) + (CASE WHEN q.storage_gb IS NULL THEN 0 ELSE 1 END)
 + (CASE WHEN q.memory IS NULL THEN 0 ELSE 1 END) + (CASE WHEN q.memory_gb IS NULL THEN 0 ELSE 1 END)
 + (CASE WHEN q.color IS NULL THEN 0 ELSE 1 END) + (CASE WHEN q.brand IS NULL THEN 0 ELSE 1 END)
 + (CASE WHEN q.model IS NULL THEN 0 ELSE 1 END) AS feature_count,
 b.hit_doc_id IS NOT NULL AS has_knowledge_match, round(b.confidence, 6) AS knowledge_confidence,
 b.hit_name AS matched_product, {hints_sql('q.query', 'q')} AS suggestions
FROM (SELECT query_id, query, {_query_features_sql('query')} FROM queries) q
LEFT JOIN query_hits b ON q.query_id = b.query_id""", ("queries", "query_hits"))
def query_context(spark, sf):
    """A10: feature count, knowledge match, its confidence and product, and suggestions per query."""
    q = T.queries(spark, sf).select("query_id", "query", FT.query_features("query").alias("f"))
    return q.join(_best_hits(spark, sf), "query_id", "left").select(
        "query_id", FT.feature_count(F.col("f")).alias("feature_count"),
        F.col("hit_doc_id").isNotNull().alias("has_knowledge_match"),
        F.round("confidence", 6).alias("knowledge_confidence"), F.col("hit_name").alias("matched_product"),
        F.array_join(FT.query_hints("query", F.col("f")), " | ").alias("suggestions"))
