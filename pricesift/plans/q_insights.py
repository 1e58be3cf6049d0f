"""Insight texts (F21, F22), the text report (F23) and the response envelope (S9) for every query."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import insights as I
from ..operators.rank import offer_output
from ..session import write_shared
from ..sources import tables as T
from .catalog import query
from .q_relational import ranked, results, trend_sql
from .q_vectors import bands, enhance


def _lines(*parts: str) -> str:
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), chr(10))"


def _fmt0(x: str) -> str:
    return f"CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR)"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_RANGE = "'$' || CAST(exp_min AS VARCHAR) || '-$' || CAST(exp_max AS VARCHAR)"
_PRICE_SQL = f"""
SELECT query_id, 'price_analysis' AS insight_type, {_text(I.TITLE_PRICE)} AS title, {_lines(
    f"{_text(I.FOUND)} || n || {_text(I.PRICED_FROM)} || {_fmt0('mn')} || {_text(I.RANGE_TO)} || {_fmt0('mx')} || '.'",
    f"{_text(I.AVERAGE)} || {_fmt0('av')}",
    f"CASE WHEN mx - mn > av * 0.3 THEN {_text(I.HIGH_SPREAD)} || {_fmt0('mx - mn')} || {_text(I.COMPARE)} END",
    f"CASE WHEN exp_min IS NOT NULL AND mn < exp_min THEN {_text(I.DEAL)} || {_fmt0('mn')} || {_text(I.BELOW)} || {_RANGE} || ')' "
    f"WHEN exp_min IS NOT NULL AND mn > exp_max THEN {_text(I.HIGH)} || {_fmt0('mn')} || {_text(I.ABOVE)} || {_RANGE} || ')' END",
    f"{_text(I.BEST_PRICE)} || b.price || ' from ' || coalesce(b.seller, 'None')")} AS content, 0.9 AS confidence,
 CAST(to_json(struct_pack(price_stats := struct_pack("min" := mn, "max" := mx, "avg" := round(av, 2), variance := mx - mn),
   best_deal := struct_pack(price := b.price, seller := b.seller, rank := b.rank),
   expected_range := struct_pack("min" := round(exp_min, 2), "max" := round(exp_max, 2)))) AS VARCHAR) AS supporting_data
FROM (SELECT query_id, count(*) AS n, min(price_num) AS mn, max(price_num) AS mx, avg(price_num) AS av,
  arg_min(struct_pack(price := price, seller := seller, rank := rank), struct_pack(p := price_num, r := rank)) AS b
  FROM results GROUP BY query_id) LEFT JOIN (SELECT query_id, exp_min, exp_max FROM enhanced) USING (query_id) WHERE n >= 2"""

_COMPARISON_SQL = f"""
SELECT query_id, 'product_comparison' AS insight_type, {_text(I.TITLE_COMPARISON)} AS title, {_lines(
    f"{_text(I.SELLERS_HEAD)} || n_sellers || {_text(I.SELLERS_TAIL)}", "array_to_string(list_transform(ls, lambda x: x.l), chr(10))",
    f"CASE WHEN avg_rating IS NOT NULL THEN {_text(I.AVERAGE_RATING)} || printf('%.1f', avg_rating) || '/5' END",
    f"CASE WHEN avg_rating IS NOT NULL THEN {_text(I.HIGHEST_RATED)} || CAST(-top.nr AS VARCHAR) || '/5 from ' || top.seller END")} AS content,
 0.8 AS confidence, CAST(to_json(struct_pack(sellers := list_transform(ls, lambda x: struct_pack(seller := x.seller, options := x.n)),
   seller_count := n_sellers, total_options := n)) AS VARCHAR) AS supporting_data
FROM (SELECT query_id, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_sellers,
  list(struct_pack(first_at := first_at, l := l, seller := seller_key, n := n) ORDER BY first_at) AS ls,
  CAST(sum(rated) AS DOUBLE) / CAST(sum(n_rated) AS DOUBLE) AS avg_rating, min(top) AS top
 FROM (SELECT *, CASE WHEN n > 1 THEN {_text(I.SELLER)} || seller_key || ': ' || n || ' options ($' || {_fmt0('mn')} || ' - $' || {_fmt0('mx')} || ')'
   ELSE {_text(I.SELLER)} || seller_key || ': $' || first_price END AS l
  FROM (SELECT query_id, coalesce(seller, 'Unknown') AS seller_key, count(*) AS n, min(price_num) AS mn, max(price_num) AS mx, min(rank) AS first_at,
    arg_min(price, rank) AS first_price, sum(CAST(rating AS DECIMAL(18,4))) FILTER (rating <> 0) AS rated, count(*) FILTER (rating <> 0) AS n_rated,
    min(struct_pack(nr := -rating, r := rank, seller := seller)) FILTER (rating <> 0) AS top
   FROM results GROUP BY query_id, coalesce(seller, 'Unknown'))) GROUP BY query_id) WHERE n >= 2"""

_CONTEXT = """struct_pack("min" := round(exp_min, 2), "max" := round(exp_max, 2), "current" := round(current_price, 2),
  trend := price_trend, best_time := best_time_to_buy, insights := market_insights)"""
_RECOMMENDATION_SQL = f"""
SELECT query_id, 'recommendation' AS insight_type, {_text(I.TITLE_RECOMMENDATION)} AS title, {_lines(
    _text(I.ALT_HEADER), "''", "bl", f"CASE WHEN market_insights <> '' THEN chr(10) || {_text(I.MARKET_INSIGHTS_HEADER)} || chr(10) || market_insights END")} AS content,
 confidence, CAST(to_json(struct_pack(alternatives := alternatives, price_context := {_CONTEXT})) AS VARCHAR) AS supporting_data
FROM enhanced LEFT JOIN (SELECT query_id, string_agg(line, chr(10) ORDER BY pos) AS bl FROM bands GROUP BY query_id) USING (query_id)
WHERE len(alternatives) > 0"""

_MARKET_SQL = f"""
SELECT * FROM (SELECT query_id, 'market_analysis' AS insight_type, {_text(I.TITLE_MARKET)} AS title, {_lines(
    f"CASE WHEN price_trend <> '' THEN CASE price_trend WHEN 'decreasing' THEN {_text(I.TREND_DOWN)} WHEN 'increasing' THEN {_text(I.TREND_UP)} "
    f"ELSE {_text(I.TREND_FLAT)} END END",
    f"CASE WHEN best_time_to_buy <> '' THEN {_text(I.BEST_TIME)} || best_time_to_buy END",
    f"CASE WHEN market_insights <> '' THEN chr(10) || {_text(I.MARKET_INTEL_HEADER)} || chr(10) || market_insights END")} AS content,
 0.7 AS confidence, CAST(to_json({_CONTEXT}) AS VARCHAR) AS supporting_data
 FROM enhanced WHERE exp_min IS NOT NULL OR market_insights IS NOT NULL) WHERE content <> ''"""

T.VIEW_SQL["insights"] = f"""
SELECT i.*, q.query FROM ({_PRICE_SQL} UNION ALL {_COMPARISON_SQL} UNION ALL {_RECOMMENDATION_SQL} UNION ALL {_MARKET_SQL}) i
JOIN queries q ON i.query_id = q.query_id"""
T.VIEW_DEPS["insights"] = ["results", "enhanced", "bands", "queries"]
_INSIGHTS = "SELECT query_id, insight_type, title, content, round(confidence, 6) AS confidence, supporting_data"


def _enhanced(spark, sf):
    return enhance(spark, sf)


def _shown(df):
    return df.withColumn("confidence", F.round("confidence", 6))


@query("insight_price", f"{_INSIGHTS} FROM ({_PRICE_SQL})", ("results", "enhanced"))
def insight_price(spark, sf):
    return I.price_insight(results(spark, sf), enhance(spark, sf).select("query_id", "exp_min", "exp_max"))


@query("insight_comparison", f"{_INSIGHTS} FROM ({_COMPARISON_SQL})", ("results",))
def insight_comparison(spark, sf):
    return I.comparison_insight(results(spark, sf))


@query("insight_recommendation", f"{_INSIGHTS} FROM ({_RECOMMENDATION_SQL})", ("enhanced", "bands"))
def insight_recommendation(spark, sf):
    e = _enhanced(spark, sf)
    return _shown(I.recommendation_insight(e, bands(spark, sf)))


@query("insight_market", f"{_INSIGHTS} FROM ({_MARKET_SQL})", ("enhanced",))
def insight_market(spark, sf):
    return I.market_insight(enhance(spark, sf))


def all_insights(spark, sf):
    """The four kinds, in the reference's order, from one enhanced table and one results table."""
    e, r = _enhanced(spark, sf), results(spark, sf)
    parts = [I.price_insight(r, e.select("query_id", "exp_min", "exp_max")), I.comparison_insight(r),
             I.recommendation_insight(e, bands(spark, sf)), I.market_insight(e)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _shown(out.join(T.queries(spark, sf).select("query_id", "query"), "query_id"))


@query("insights_all", f"{_INSIGHTS}, query FROM insights", ("insights",))
def insights_all(spark, sf):
    """Long table insights(query_id, query, insight_type, title, content, confidence, supporting_data)."""
    return all_insights(spark, sf)


@query("response_envelope", """
SELECT r.query_id, q.query, q.country, r.total_results, r.sources_used, r.timestamp, r.results, e.enhanced_query,
 coalesce(i.n, 0) AS n_insights, coalesce(i.kinds, '') AS insight_types
FROM (SELECT query_id, count(*) AS total_results, string_agg(DISTINCT source, ',' ORDER BY source) AS sources_used,
  CAST(max(scraped_at) AS VARCHAR) AS timestamp,
  CAST(to_json(list(struct_pack(rank := rank, productName := product_name, price := price, source := source) ORDER BY rank)) AS VARCHAR) AS results
  FROM results GROUP BY query_id) r
JOIN queries q ON r.query_id = q.query_id JOIN enhanced e ON r.query_id = e.query_id
LEFT JOIN (SELECT query_id, count(*) AS n, string_agg(insight_type, ',' ORDER BY insight_type) AS kinds FROM insights GROUP BY query_id) i
 ON r.query_id = i.query_id""", ("results", "queries", "enhanced", "insights"))
def response_envelope(spark, sf):
    """What one search returns; ``timestamp`` is that of the newest result, so a run can be repeated."""
    r = results(spark, sf).groupBy("query_id").agg(
        F.count("*").alias("total_results"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources_used"),
        F.max("scraped_at").cast("string").alias("timestamp"),
        F.to_json(F.array_sort(F.collect_list(F.struct("rank", F.col("product_name").alias("productName"), "price", "source")))).alias("results"))
    i = all_insights(spark, sf).groupBy("query_id").agg(
        F.count("*").alias("n_insights"), F.array_join(F.array_sort(F.collect_list("insight_type")), ",").alias("insight_types"))
    e = enhance(spark, sf).select("query_id", "query", "country", "enhanced_query")
    return (r.join(e, "query_id").join(i, "query_id", "left")
            .withColumn("n_insights", F.coalesce("n_insights", F.lit(0).cast("bigint")))
            .withColumn("insight_types", F.coalesce("insight_types", F.lit(""))))


_R = I.REPORT_LINES


@query("report_text", f"""
SELECT query_id, {_text(I.REPORT_FOUND)} || n || ' results for ' || chr(39) || query || chr(39) || chr(10) || {_text(I.REPORT_COUNTRY)} || country
 || chr(10) || chr(10) || body AS report
FROM (SELECT query_id, max(n) AS n, string_agg(block, chr(10) ORDER BY rank) AS body FROM (
 SELECT query_id, rank, n, {_lines(
    "rank || '. ' || coalesce(product_name, 'Unknown Product')",
    f"{_text(_R['price'])} || coalesce(norm_currency, '') || ' ' || CAST(CAST(trunc(norm_price) AS BIGINT) AS VARCHAR)",
    f"{_text(_R['source'])} || coalesce(source, 'Unknown')", f"{_text(_R['link'])} || coalesce(link, 'N/A')",
    f"CASE WHEN availability <> '' THEN {_text(_R['availability'])} || availability END",
    f"CASE WHEN rating <> 0 THEN {_text(_R['rating'])} || CAST(rating AS VARCHAR) END",
    f"CASE WHEN shipping_cost <> '' THEN {_text(_R['shipping'])} || shipping_cost END", "''")} AS block
 FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM ranked)) WHERE rank <= 10 GROUP BY query_id)
JOIN (SELECT query_id, query, country FROM queries) USING (query_id)""", ("ranked", "queries"))
def report_text(spark, sf):
    return I.report_text(offer_output(ranked(spark, sf)), T.queries(spark, sf))


@query("trend_wording", """
SELECT product_id, CASE price_trend WHEN 'decreasing' THEN '📉 Prices are currently trending down - good time to buy!'
 WHEN 'increasing' THEN '📈 Prices are trending up - consider buying soon'
 ELSE '📊 Prices are stable in the current market' END AS wording FROM (
 SELECT product_id, CASE WHEN count(*) < 3 THEN 'stable'
  WHEN max(CASE WHEN rn = 1 THEN price END) > max(CASE WHEN rn = 3 THEN price END) THEN 'increasing'
  WHEN max(CASE WHEN rn = 1 THEN price END) < max(CASE WHEN rn = 3 THEN price END) THEN 'decreasing'
  ELSE 'stable' END AS price_trend
 FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY observed_at DESC, seq DESC, seq2 DESC) AS rn
       FROM price_points) WHERE rn <= 30 GROUP BY product_id)""", ("price_points",))
def trend_wording(spark, sf):
    """F22 over the learned trend of every product."""
    from ..operators.history import last_points, trend_of
    t = trend_of(last_points(T.price_points(spark, sf)))
    return t.select("product_id", I.trend_line(F.col("price_trend")).alias("wording"))


_PAD = "chr(10) || '        "
_SPEC = """'{' || chr(10) || '  "storage_options": [' || chr(10)
 || array_to_string(list_transform(storage_options, lambda x: '    "' || x || '"'), ',' || chr(10)) || chr(10) || '  ]' || chr(10) || '}'"""
_POINT = """'  {' || chr(10) || '    "date": "' || strftime(observed_at, '%Y-%m-%dT%H:%M:%S') || '",' || chr(10) || '    "price": ' || CAST(price AS VARCHAR)
 || ',' || chr(10) || '    "source": "' || source || '"' || chr(10) || '  }'"""


@query("kb_doc_text", f"""
SELECT product_id, 'product_knowledge' AS type, 'Product: ' || product_name || {_PAD}Brand: ' || brand || {_PAD}Category: ' || category
 || {_PAD}' || {_PAD}Specifications: ' || {_SPEC} || {_PAD}' || {_PAD}Features: ' || lower(category)
 || {_PAD}' || {_PAD}Price Range: $' || CAST(price_min AS VARCHAR) || ' - $' || CAST(price_max AS VARCHAR) || ' (avg: $' || CAST(round(price_avg, 2) AS VARCHAR) || ')'
 || {_PAD}' || {_PAD}Alternatives: ' || array_to_string(alternatives, ', ') || {_PAD}' || {_PAD}Reviews Summary: '
 || {_PAD}' || {_PAD}Market Insights: ' || market_insights AS content FROM knowledge
UNION ALL
SELECT t.product_id, 'price_insight', 'Price Analysis for: ' || t.product_name || {_PAD}Current Price: $' || CAST(t.current_price AS VARCHAR)
 || {_PAD}Price Trend: ' || t.price_trend || {_PAD}Best Time to Buy: Monitor for trends' || {_PAD}' || {_PAD}Historical Prices: ' || '[' || chr(10) || h.points || chr(10) || ']'
 || {_PAD}' || {_PAD}Market Analysis: Insufficient data for analysis' || {_PAD}' || {_PAD}Price Prediction: $N/A'
FROM ({trend_sql('price_points')}) t JOIN (SELECT product_id, string_agg({_POINT}, ',' || chr(10) ORDER BY observed_at, seq, seq2) AS points
  FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY observed_at DESC, seq DESC, seq2 DESC) AS rn FROM price_points) WHERE rn <= 30
  GROUP BY product_id) h ON t.product_id = h.product_id""", ("knowledge", "price_points"))
def kb_doc_text(spark, sf):
    """product and price-insight document texts for every product."""
    from ..operators.history import history_arrays, last_points, learn_prices
    kb = T.knowledge(spark, sf).withColumn("features", F.array(F.lower("category"))) \
        .withColumn("reviews_summary", F.lit(None).cast("string")).withColumn("price_avg", I.cents("price_avg"))
    pts = T.price_points(spark, sf)
    ins = learn_prices(pts).join(history_arrays(last_points(pts)), "product_id")
    return I.product_doc_text(kb).unionByName(I.insight_doc_text(ins))
