"""Price learning in batch and as a stream (M1, M2, M3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import slug
from ..operators.history import history_arrays, last_points, learn_prices
from ..sources import knowledge_io as K
from ..sources import tables as T
from ..streaming.learning import run_learning
from ..streaming.snapshots import SnapshotStore
from .catalog import query
from .q_relational import last30_sql

_EV_TREND = """
SELECT product_id, n_points, current_price, last_updated, oldest_kept, product_name,
 CASE WHEN n_points < 3 THEN 'stable' WHEN current_price > third_price THEN 'increasing'
      WHEN current_price < third_price THEN 'decreasing' ELSE 'stable' END AS price_trend,
 'Monitor for trends' AS best_time_to_buy, CAST(NULL AS DOUBLE) AS price_prediction,
 'Insufficient data for analysis' AS market_analysis
FROM (SELECT product_id, count(*) AS n_points, max(CASE WHEN rn = 1 THEN price END) AS current_price,
  max(CASE WHEN rn = 3 THEN price END) AS third_price, max(CASE WHEN rn = 1 THEN observed_at END) AS last_updated,
  min(observed_at) AS oldest_kept, max(CASE WHEN rn = 1 THEN product_name END) AS product_name
  FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id
        ORDER BY observed_at DESC, seq DESC, seq2 DESC) AS rn FROM event_points
        WHERE product_name <> '' AND price IS NOT NULL) WHERE rn <= 30) GROUP BY product_id)"""


@query("price_learning_events", _EV_TREND, ("event_points",))
def price_learning_events(spark, sf):
    """M1 batch over the event stream table (the reference of the streaming run)."""
    return learn_prices(T.event_points(spark, sf))


@query("price_learning_stream", _EV_TREND, ("event_points",))
def price_learning_stream(spark, sf):
    """M1 as Structured Streaming with per-product state; equals price_learning_events."""
    return run_learning(spark, T.events_stream(spark, sf))


@query("price_learning_two_runs", _EV_TREND, ("event_points",))
def price_learning_two_runs(spark, sf):
    """M1 + M2: the events in two halves, learned in two runs; the second starts from the first one's published history."""
    events = T.table(spark, sf, "events")
    base = K.version_dir(spark, "learning")
    for half in (0, 1):
        folder = f"{base}-{half}"
        events.where(F.pmod("event_id", F.lit(2)) == half).write.parquet(f"{folder}/events.parquet")
        out = run_learning(spark, T.points_from_events(spark.readStream.schema(events.schema).parquet(f"{folder}/events.parquet")),
                           SnapshotStore(spark, base))
    return out


@query("kb_docs_current", """
SELECT product_id, observed_at AS created_at, 'Price insight for ' || product_name || ': current price ' ||
 CAST(price AS VARCHAR) AS content FROM (SELECT *, row_number() OVER (PARTITION BY product_id
 ORDER BY observed_at DESC, seq DESC, seq2 DESC) AS rn FROM price_points) WHERE rn = 1""", ("price_points",))
def kb_docs_current(spark, sf):
    """M3: one current insight document per product (the newest point), not one per update."""
    last = last_points(T.price_points(spark, sf), keep=1)
    return last.select("product_id", F.col("observed_at").alias("created_at"),
                       F.concat(F.lit("Price insight for "), F.col("product_name"), F.lit(": current price "),
                                F.col("price").cast("string")).alias("content"))


_HISTORY = f"""SELECT product_id, list(struct_pack(date := strftime(observed_at, '%Y-%m-%dT%H:%M:%S'), price := price, source := source)
  ORDER BY observed_at, seq, seq2) AS pts FROM ({last30_sql('price_points')}) GROUP BY product_id"""


@query("history_export", f"SELECT product_id, CAST(to_json(pts) AS VARCHAR) AS historical_prices FROM ({_HISTORY})", ("price_points",))
def history_export(spark, sf):
    """Nested export of the kept history: a JSON list of {date, price, source} per product."""
    h = history_arrays(last_points(T.price_points(spark, sf)))
    return h.select("product_id", F.to_json("historical_prices").alias("historical_prices"))


# --- knowledge storage (S3-S7) ------------------------------------------------------
@query("kb_load_products", """
SELECT CAST(product_id AS VARCHAR) AS id, product_name, category, brand, array_to_string(storage_options, '|') AS storage_options,
 round(price_min, 6) AS price_min, round(price_max, 6) AS price_max, round(price_avg, 6) AS price_avg,
 array_to_string(alternatives, '|') AS alternatives, market_insights FROM knowledge""", ("knowledge",))
def kb_load_products(spark, sf):
    """S3: knowledge written as id -> record JSON maps, then loaded with a fixed schema."""
    path = K.version_dir(spark, "products")
    K.save_json_maps(K.products_as_records(T.knowledge(spark, sf)), path)
    r = K.load_json_map(spark, path, K.PRODUCT_SCHEMA)
    return r.select("id", "product_name", "category", "brand", F.array_join("storage_options", "|").alias("storage_options"),
                    *[F.round(f"price_range.{c}", 6).alias(f"price_{c}") for c in ("min", "max", "avg")],
                    F.array_join("alternatives", "|").alias("alternatives"), "market_insights")


@query("kb_load_insights", f"""
SELECT CAST(product_id AS VARCHAR) AS id, product_name, strftime(observed_at, '%Y-%m-%dT%H:%M:%S') AS date, price, source
FROM ({last30_sql('price_points')}) JOIN (SELECT product_id, arg_max(product_name, struct_pack(o := observed_at, s := seq, t := seq2)) AS name
 FROM price_points GROUP BY product_id) USING (product_id)""", ("price_points",))
def kb_load_insights(spark, sf):
    """Price insights with their nested history, written as maps and exploded back to points."""
    hist = history_arrays(last_points(T.price_points(spark, sf)))
    ins = learn_prices(T.price_points(spark, sf)).join(hist, "product_id")
    rec = ins.select(F.col("product_id").cast("string").alias("id"),
                     F.struct("product_name", "current_price", "price_trend", "historical_prices").alias("record"))
    path = K.version_dir(spark, "insights")
    K.save_json_maps(rec, path)
    loaded = K.load_json_map(spark, path, rec.schema["record"].dataType)
    return loaded.select("id", "product_name", F.explode("historical_prices").alias("p")).select(
        "id", "product_name", F.col("p.date").alias("date"), F.col("p.price").alias("price"),
        F.col("p.source").alias("source"))


@query("kb_roundtrip", "SELECT doc_id, lang, source, n_chars, md5(text) AS md5 FROM documents")
def kb_roundtrip(spark, sf):
    """Full rewrite of the documents table into a new version folder, read back by schema."""
    docs = T.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    path = K.version_dir(spark, "documents")
    K.save_table(docs, path, fmt="parquet")
    loaded = K.load_table(spark, path, docs.schema, fmt="parquet")
    return loaded.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("md5"))


_SEED_VALUES = ", ".join(f"('{b.lower()}_{n.lower().replace(' ', '_')}', '{n}', '{b}')" for n, _, b, *_ in K.SEED_PRODUCTS)


@query("kb_seed", f"""
SELECT lower(replace(brand || ' ' || product_name, ' ', '_')) AS id, min(product_name) AS product_name, min(brand) AS brand FROM knowledge GROUP BY id
UNION ALL SELECT * FROM (VALUES {_SEED_VALUES}) v(id, product_name, brand)
 WHERE id NOT IN (SELECT lower(replace(brand || ' ' || product_name, ' ', '_')) FROM knowledge)""", ("knowledge",))
def kb_seed(spark, sf):
    """S7 + U2: the knowledge keyed by slug (or the seed, were it empty) and the starting products that it lacks."""
    kb = T.knowledge(spark, sf)
    record = F.min(F.struct("product_name", "brand")).alias("record")
    kb = kb.groupBy(slug(F.concat_ws(" ", "brand", "product_name")).alias("id")).agg(record)
    seed = K.seed_records(spark).select("id", F.struct("record.product_name", "record.brand").alias("record"))
    return K.add_missing(K.seed_if_empty(kb, seed), seed).select("id", "record.product_name", "record.brand")


@query("kb_load_documents", """
SELECT md5(text) || '_' || md5('{"lang": "' || lang || '", "source": "' || source || '"}') AS id, min(doc_id) AS created_from,
 lang, source, md5(text) AS md5 FROM documents GROUP BY text, lang, source""")
def kb_load_documents(spark, sf):
    """The document store (id -> content, metadata) written as maps and loaded by schema; equal documents are one."""
    from ..functions.ids import document_id
    d = T.table(spark, sf, "documents").select(
        document_id("text", {"lang": F.col("lang"), "source": F.col("source")}).alias("id"), "text", "lang", "source", "doc_id")
    first = d.groupBy("id").agg(F.min(F.struct("doc_id", "lang", "source", "text")).alias("r"))
    rec = first.select("id", F.struct(F.col("r.text").alias("content"), F.struct("r.lang", "r.source").alias("metadata"),
                                      F.col("r.doc_id").alias("created_from")).alias("record"))
    path = K.version_dir(spark, "docs")
    K.save_json_maps(rec, path)
    loaded = K.load_json_map(spark, path, rec.schema["record"].dataType)
    return loaded.select("id", "created_from", "metadata.lang", "metadata.source", F.md5("content").alias("md5"))
