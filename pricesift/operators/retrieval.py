"""Candidate retrieval (J2), the shops' front (J1, P7-P9, F13) and offer union.

J2 works on the *vocabulary*, not on offers: distinct names become a token index, written
once and bucketed by token, so a search joins it without moving it. A text keeps the
rarest tokens of which one must be shared (all of its tokens but ``need - 1``), names meet
texts on those, and the pairs are verified by set intersection. A token that most names
hold is never joined on unless a text has nothing rarer.

The front holds the offers in partitions by shop and country. A request reaches the shops
of its country that its lists leave over; those shops' partitions alone are read (dynamic
partition pruning), and of their offers the ones whose names match the search text.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..session import ensure_checkpoint_dir, write_shared
from .shops import shops_for_queries

#: Words that the rewriting adds for a country; the choice of shops has already answered them.
COUNTRY_WORDS = ("india", "official", "variant")
#: Share of a search text's words that a name must hold to answer it.
SEARCH_SHARE = 0.75


def text_tokens(text: str, without: tuple[str, ...] = ()) -> Column:
    return F.array_distinct(F.filter(F.split(clean_text(text), " "), lambda t: (t != "") & ~t.isin(*without) if without else t != ""))


@dataclass
class TokenIndex:
    """``names``: (token, product_name, name_tokens) bucketed by token; ``counts``: (token, n names)."""

    names: DataFrame
    counts: DataFrame


def token_index(names: DataFrame, buckets: int | None = None) -> TokenIndex:
    """Write the index of distinct product names."""
    spark = names.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = names.withColumn("name_tokens", text_tokens("product_name"))
    held = held.select(F.explode("name_tokens").alias("token"), "product_name", "name_tokens")
    name = f"token_index_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    held.repartition(n, "token").write.bucketBy(n, "token").sortBy("token").option("path", path).saveAsTable(name)
    index = spark.table(name)
    return TokenIndex(index, write_shared(index.groupBy("token").agg(F.count("*").alias("n")), "token-counts"))


def matching_names(index: TokenIndex, texts: DataFrame, min_share: float = 1.0) -> DataFrame:
    """(query_id, product_name, shared): names that hold at least ``ceil(min_share * n)`` of the n distinct
    ``query_tokens`` of a (query_id, query_tokens) row."""
    q = texts.select("query_id", "query_tokens").filter(F.size("query_tokens") > 0)
    need = F.ceil(F.size("query_tokens") * F.lit(min_share)).cast("int")
    rare = (q.select("query_id", "query_tokens", F.explode("query_tokens").alias("token")).join(index.counts, "token", "left")
            .groupBy("query_id", "query_tokens")
            .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("order")))
    prefix = F.slice("order", F.lit(1), F.size("query_tokens") - need + 1)
    keys = rare.select("query_id", "query_tokens", F.explode(prefix).alias("p")).select("query_id", "query_tokens", "p.token")
    shared = F.size(F.array_intersect("query_tokens", "name_tokens"))
    hits = (keys.join(index.names, "token").withColumn("shared", shared.cast("bigint"))
            .filter(F.col("shared") >= need).select("query_id", "product_name", "shared"))
    return hits.distinct() if min_share < 1.0 else hits  # a name may meet a text on several of its rare tokens


def candidate_offers(offers: DataFrame, queries: DataFrame, min_share: float = 1.0, index: TokenIndex | None = None) -> DataFrame:
    """Offers whose name holds at least ``ceil(min_share * n)`` of a query's n distinct tokens."""
    index = index or token_index(offers.select("product_name").distinct())
    return offers.join(matching_names(index, queries.select("query_id", text_tokens("query").alias("query_tokens")), min_share), "product_name")


def by_shop(offers: DataFrame, salts: int = 8) -> DataFrame:
    """Offers with ``shop`` and ``shop_country``, written in partitions of the two; a large shop is spread over files."""
    spread = F.pmod(F.xxhash64("product_id", "seller_id"), F.lit(salts))
    n = int(offers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return write_shared(offers.repartition(n, "shop", "shop_country", spread), "offers-by-shop", ["shop", "shop_country"])


def search_offers(offers_by_shop: DataFrame, index: TokenIndex, requests: DataFrame) -> DataFrame:
    """The offers that answer each request, with its query_id, query, country, max_results and target_currency.

    ``requests`` holds these, the include and exclude lists and ``search_text``, the rewritten
    query. The shops asked are a table of at most the registry's rows, broadcast, by which
    the partitions of all other shops are pruned before they are read.
    """
    asked = shops_for_queries(requests).select("query_id", F.col("source").alias("shop"), F.col("country_uc").alias("shop_country"))
    open_shops = F.broadcast(asked.select("shop", "shop_country").distinct())  # at most the registry's rows
    shown = offers_by_shop.join(open_shops, ["shop", "shop_country"], "left_semi")
    texts = requests.select("query_id", text_tokens("search_text", COUNTRY_WORDS).alias("query_tokens"))
    wanted = matching_names(index, texts, SEARCH_SHARE).select("query_id", "product_name").join(asked, "query_id")
    found = shown.join(wanted, ["shop", "shop_country", "product_name"])
    return found.join(requests.select("query_id", "query", "country", "max_results", "target_currency"), "query_id")


@dataclass
class Search:
    """What requests find, without a row per request and name.

    ``asked``: (query_id, request, market, core, words, query, country, max_results): queries of one market (the shops
    asked and the target currency), text and words are one request, under its smallest query_id; requests of one market
    whose most frequent words are the same share a ``core``. ``members``: (words, core, market, product_name), the names
    that hold all words of a core; ``extras``: (words, core, request, market, product_name), names that a request finds
    beyond; ``offers``: the offers of these names, per market, with its target_currency.
    """

    asked: DataFrame
    members: DataFrame
    extras: DataFrame
    offers: DataFrame


def shared_search(offers_by_shop: DataFrame, index: TokenIndex, requests: DataFrame) -> Search:
    """``search_offers`` with what requests share held once: the same shops are asked for the same names.

    A name that answers a request of n words holds ``need`` of them: either its ``need`` most frequent words, which is
    the core, or one of the others at least, by which the remaining names are found.
    """
    shops = shops_for_queries(requests).groupBy("query_id").agg(
        F.array_sort(F.collect_set(F.struct(F.col("source").alias("shop"), F.col("country_uc").alias("shop_country")))).alias("shops"))
    q = requests.withColumn("tokens", F.array_sort(text_tokens("search_text", COUNTRY_WORDS))).filter(F.size("tokens") > 0).join(shops, "query_id")
    known = (q.select("query_id", F.explode("tokens").alias("token")).join(index.counts, "token", "left")
             .groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.coalesce("n", F.lit(0))).alias("n"), "token"))).alias("order")))
    need = F.ceil(F.size("tokens") * F.lit(SEARCH_SHARE)).cast("int")
    q = q.join(known, "query_id").withColumn("need", need).withColumn("order", F.transform("order", lambda x: x["token"]))
    q = q.withColumn("core_tokens", F.array_sort(F.slice("order", F.lit(1), F.col("need"))))
    q = q.withColumn("other_tokens", F.array_except("tokens", "core_tokens")).drop("order")

    def least(*keys: str) -> Column:
        return F.min("query_id").over(Window.partitionBy(*keys))

    q = q.withColumn("market", least("shops", "target_currency")).withColumn("words", least("core_tokens"))
    q = q.withColumn("core", least("market", "words")).withColumn("request", least("core", "tokens", "query"))
    q = write_shared(q.select("query_id", "request", "market", "core", "words", "query", "country", "max_results", "target_currency", "shops",
                              "tokens", "core_tokens", "other_tokens", "need"), "requests")
    texts = q.where("query_id = words").select("query_id", F.col("core_tokens").alias("query_tokens"))
    of_words = matching_names(index, texts).select(F.col("query_id").alias("words"), "product_name")
    members = write_shared(q.select("words", "core", "market").distinct().join(of_words, "words"), "core-names")
    keys = q.where("query_id = request").select("words", "core", "request", "market", "tokens", "core_tokens", "need", F.explode("other_tokens").alias("token"))
    held = [F.size(F.array_intersect(c, "name_tokens")) for c in ("tokens", "core_tokens")]
    extras = keys.join(index.names, "token").filter((held[0] >= F.col("need")) & (held[1] < F.col("need")))
    extras = write_shared(extras.select("words", "core", "request", "market", "product_name").distinct(), "extra-names")
    wanted = members.select("market", "product_name").unionByName(extras.select("market", "product_name")).distinct()
    of_market = q.where("query_id = market").select("market", "target_currency", F.explode("shops").alias("s")).select("market", "target_currency", "s.*")
    open_shops = F.broadcast(of_market.select("shop", "shop_country").distinct())  # at most the registry's rows
    shown = offers_by_shop.join(open_shops, ["shop", "shop_country"], "left_semi")
    offers = shown.join(wanted.join(of_market, "market"), ["shop", "shop_country", "product_name"])
    return Search(q.drop("shops", "tokens", "core_tokens", "other_tokens", "need"), members, extras, offers)


def union_offers(parts: list[DataFrame]) -> DataFrame:
    """Concatenate shop outputs by column name; a missing shop adds nothing."""
    parts = [p for p in parts if p is not None]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
