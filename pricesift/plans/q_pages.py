"""Page extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.pricing import absolute_link
from ..sources import pages as PG
from ..sources import tables as T
from ..sources.registry import PRICE_RULES
from . import sql_exprs as S
from .catalog import query

_HOST = "regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)"


@query("page_fields", f"""
SELECT page_id, {_HOST} AS host, regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
 regexp_extract(html, '<h1>(.*?)</h1>', 1) AS h1,
 CAST(len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS BIGINT) AS n_links,
 CAST(len(regexp_extract_all(html, '(class="ad")', 1)) AS BIGINT) AS n_ads FROM pages""")
def page_fields(spark, sf):
    return PG.page_fields(T.table(spark, sf, "pages"))


@query("field_fallback", """
SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '<title>(.*?)</title>', 1)), ''),
 nullif(trim(regexp_extract(html, '<h1>(.*?)</h1>', 1)), ''), nullif(trim(regexp_extract(html, '<p>(.*?)</p>', 1)), ''))
 AS name FROM pages""")
def field_fallback(spark, sf):
    """P20 in column form: first non-empty of title, h1, first paragraph."""
    h = F.col("html")

    def f(p):
        return F.nullif(F.trim(F.regexp_extract(h, p, 1)), F.lit(""))
    return T.table(spark, sf, "pages").select(
        "page_id", F.coalesce(f("<title>(.*?)</title>"), f("<h1>(.*?)</h1>"), f("<p>(.*?)</p>")).alias("name"))


@query("absolute_links", f"""
SELECT page_id, pos, href, CASE WHEN starts_with(href, '/') THEN 'https://' || host || href
  WHEN starts_with(href, 'http') THEN href END AS link
FROM (SELECT page_id, {_HOST} AS host, unnest(generate_series(1, len(l))) AS pos, unnest(l) AS href
      FROM (SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages))""")
def absolute_links(spark, sf):
    p = T.table(spark, sf, "pages").select(
        "page_id", PG.page_host("url").alias("host"),
        F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos0", "href"))
    return p.select("page_id", (F.col("pos0") + 1).cast("bigint").alias("pos"), "href",
                    absolute_link("href", "host").alias("link"))


_AMOUNT = {"us": S.clean_price_us("price_text"), "india": S.clean_price_india("price_text"), "strip": S.clean_price_strip("price_text"),
           "loose": f"TRY_CAST({S.clean_price_loose('price_text')} AS DOUBLE)"}
_RULE = ("CASE shop " + " ".join(f"WHEN '{shop}' THEN {_AMOUNT[rule]}" for shop, rule in PRICE_RULES.items() if shop in T._PAGE_SHOPS)
         + " END")


@query("page_cards", f"""
SELECT shop, product_name, price_text, CASE WHEN shop = 'eBay' THEN {S.clean_price_loose('price_text')} ELSE CAST(amount AS VARCHAR) END AS price,
 amount, currency, link, rating, reviews_count, availability, shipping_cost, seller, pos, product_id FROM (
 SELECT shop, product_name, price_text, {_RULE} AS amount, currency, pos,
  CASE shop WHEN 'Flipkart' THEN 'https://' || host || '/p/' || pk WHEN 'eBay' THEN 'https://' || host || '/itm/' || pk
   ELSE 'https://' || host || '/dp/B' || lpad(pk, 9, '0') END AS link,
  CASE WHEN shop LIKE 'Amazon%' THEN 'B' || lpad(pk, 9, '0') END AS product_id,
  CASE WHEN shop LIKE 'Amazon%' THEN rating END AS rating,
  CASE WHEN shop LIKE 'Amazon%' AND reviews_count > 0 THEN reviews_count END AS reviews_count,
  CASE WHEN shop = 'eBay' THEN 'Available' WHEN shop = 'Flipkart' THEN 'Unknown' WHEN availability = 'Out of Stock' THEN 'Out of Stock'
   ELSE 'In Stock' END AS availability,
  CASE WHEN shop = 'eBay' THEN shipping_cost END AS shipping_cost,
  CASE WHEN shop = 'eBay' THEN seller ELSE shop END AS seller
 FROM (SELECT *, CAST(product_id AS VARCHAR) AS pk, CASE currency WHEN 'USD' THEN '$' WHEN 'INR' THEN '₹' WHEN 'EUR' THEN '€' ELSE '£' END
   || price AS price_text FROM shop_cards)) WHERE amount > 0 OR shop = 'eBay'""", ("shop_cards",))
def page_cards(spark, sf):
    """S2 over shop pages built from the offers: every field of a card, parsed by its shop's rules."""
    return PG.page_cards(T.shop_pages(spark, sf)).drop("page_id", "image_url")
