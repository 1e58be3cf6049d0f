"""Shop result pages -> product cards -> offers.

A page is parsed in its own task with the stdlib HTML parser inside ``mapInPandas``
(Arrow batches of pages in, card texts out); everything after the texts is column
expressions: the shop's price rule, currency, links, rating, reviews, availability
and shipping. Shops, their hosts, card caps and profiles are gathered into one plain
dict when the query is built and travel to the workers inside the function, so a
registered shop works there like a built-in one. A profile names its containers in
order (the first kind that a page holds is used), and the classes of each field in
order (the first non-empty one wins, P20).
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pricing import (absolute_link, availability_class, clean_price_by_rule, clean_price_loose, link_product_id,
                                 parse_rating, parse_reviews, shipping_cost)
from .registry import CARD_CAPS, PROFILES, registry_rows

TEXTS = ["title", "price", "rating", "reviews", "availability", "shipping", "seller"]
CARD_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("shop", T.StringType()), T.StructField("domain", T.StringType()),
    T.StructField("host", T.StringType()),
    T.StructField("pos", T.LongType()), T.StructField("card_id", T.StringType()), T.StructField("href", T.StringType()),
    T.StructField("image_url", T.StringType()), *[T.StructField(f"{t}_text", T.StringType()) for t in TEXTS]])
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Done(Exception):
    """The cap's last card is closed: the rest of a page adds nothing."""


class _Cards(HTMLParser):
    """Collects the texts of configured classes inside the containers of one kind."""

    def __init__(self, profile: dict, container: dict, cap: int):
        super().__init__(convert_charrefs=True)
        self.profile, self.container, self.cap = profile, container, cap
        self.cards: list[dict] = []
        self.depth = 0  # element depth inside the current card (0 = outside)
        self.open: list[tuple[str, str, int]] = []  # fields being read: (field, class, depth)

    def _starts_card(self, attrs: dict, classes: list[str]) -> bool:
        c = self.container
        if "class" in c and c["class"] not in classes:
            return False
        return "attr" not in c or (c["attr"] in attrs and c.get("value") in (None, attrs[c["attr"]]))

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        if self.depth == 0:
            if tag not in VOID and len(self.cards) < self.cap and self._starts_card(a, classes):
                ids = [a.get(k) for k in self.profile["id_attrs"] if a.get(k)]
                self.cards.append({"id": ids[0] if ids else None, "href": None, "image": None, "texts": {}})
                self.depth = 1
            return
        void = tag in VOID
        if not void:
            self.depth += 1
        card = self.cards[-1]
        if tag == "a" and card["href"] is None and a.get("href"):
            card["href"] = a["href"]
        if tag == "img" and card["image"] is None:
            card["image"] = next((a[k] for k in self.profile["image_attrs"] if (a.get(k) or "").startswith("http")), None)
        if not void:
            for field in TEXTS:
                for c in self.profile.get(field, []):
                    if c in classes and (field, c) not in card["texts"]:
                        card["texts"][field, c] = []
                        self.open.append((field, c, self.depth))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.depth:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.depth == 0 or tag in VOID:
            return
        self.open = [x for x in self.open if x[2] != self.depth]
        self.depth -= 1
        if self.depth == 0 and len(self.cards) >= self.cap:
            raise _Done

    def handle_data(self, data):
        if self.depth:
            for field, c, _ in self.open:
                self.cards[-1]["texts"][field, c].append(data)


def _text(card: dict, profile: dict, field: str) -> str | None:
    """First non-empty text of a field's classes, in their order."""
    for c in profile.get(field, []):
        text = " ".join("".join(card["texts"].get((field, c), [])).split())
        if text:
            return text
    return None


def shop_of(url: str | None, hosts: list[tuple[str, str]]) -> tuple[str | None, str | None, str]:
    """(shop, domain, host) by the longest registered domain that the host equals or ends with."""
    host = (url or "").split("//", 1)[-1].split("/", 1)[0].split("?", 1)[0].split(":", 1)[0].lower()
    found = [(len(d), shop, d) for d, shop in hosts if host == d or host.endswith("." + d)]
    return (*(max(found)[1:] if found else (None, None)), host)


def shops() -> dict:
    """Hosts, profiles and caps of every registered shop, as plain values."""
    # A shop of its own for one country's domain (registered later) goes before the general one.
    hosts = {r[2].removeprefix("www."): r[0] for r in registry_rows() if r[0] in PROFILES}
    return {"hosts": sorted(hosts.items()), "profiles": dict(PROFILES), "caps": dict(CARD_CAPS)}


def _may_hold(container: dict, html: str, lower: str) -> bool:
    """Whether a page can hold a kind of container: its words must stand in the page, or be written with references."""
    texts = [container[k] for k in ("class", "value") if container.get(k)]
    return container.get("attr", "") in lower and ("&" in html or all(t in html for t in texts))


def _extract(known: dict):
    def run(batches):
        for pdf in batches:
            rows = []
            for pid, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"], strict=True):
                shop, domain, host = shop_of(url, known["hosts"])
                if shop is None or html is None:
                    continue
                profile = known["profiles"][shop]
                cards: list[dict] = []
                lower = html.lower()
                for container in profile["containers"]:
                    if not _may_hold(container, html, lower):
                        continue
                    parser = _Cards(profile, container, known["caps"].get(shop, 20))
                    try:
                        parser.feed(html)
                    except _Done:
                        pass
                    cards = parser.cards
                    if cards:
                        break
                for i, c in enumerate(cards):
                    rows.append((int(pid), shop, domain, host, i + 1, c["id"], c["href"], c["image"],
                                 *[_text(c, profile, t) for t in TEXTS]))
            yield pd.DataFrame(rows, columns=[f.name for f in CARD_SCHEMA.fields])
    return run


def card_texts(pages: DataFrame) -> DataFrame:
    """One row per card container (first N of a page), with the texts as they stand."""
    return pages.select("page_id", "url", "html").mapInPandas(_extract(shops()), CARD_SCHEMA)


def page_cards(pages: DataFrame) -> DataFrame:
    """The cards of all pages as offers; a card without title, price, link or a needed id is dropped (P10)."""
    c = card_texts(pages)
    rules = {r[0]: r[6] for r in registry_rows()}
    currencies = {r[2].removeprefix("www."): r[3] for r in registry_rows()}
    lookup = lambda d, key: F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(d.items()) for x in kv]), key)
    rule = lookup(rules, F.col("shop"))
    needs_id = {s for s, p in PROFILES.items() if p.get("needs_id")}
    seller = lookup({s: p["seller_name"] for s, p in PROFILES.items()}, F.col("shop"))
    given = lookup({s: p.get("availability_default", "Unknown") for s, p in PROFILES.items()}, F.col("shop"))
    amount = clean_price_by_rule("price_text", rule)
    price = F.when(rule == "loose", clean_price_loose("price_text")).otherwise(amount.cast("string"))
    out = c.select(
        "page_id", "shop", rule.alias("_rule"), "pos", F.coalesce("card_id", link_product_id("href")).alias("product_id"),
        F.col("title_text").alias("product_name"), "price_text", price.alias("price"), amount.alias("amount"),
        F.coalesce(lookup(currencies, F.col("domain")), F.lit("USD")).alias("currency"),
        absolute_link("href", F.col("host")).alias("link"), "image_url",
        parse_rating("rating_text", bounded=True).alias("rating"), parse_reviews("reviews_text", positive_only=True).alias("reviews_count"),
        F.when(F.col("availability_text").isNotNull(), availability_class("availability_text")).otherwise(given).alias("availability"),
        shipping_cost("shipping_text").alias("shipping_cost"), F.coalesce("seller_text", seller).alias("seller"))
    return out.filter(
        F.col("product_name").isNotNull() & F.col("price").isNotNull() & ((F.col("amount") > 0) | (F.col("_rule") == "loose"))
        & F.col("link").isNotNull() & (F.col("product_id").isNotNull() | ~F.col("shop").isin(*sorted(needs_id) or [""]))
        & ~((F.col("shop") == "eBay") & F.lower("product_name").contains("shop on ebay"))).drop("_rule")


def page_host(url) -> Column:
    u = F.col(url) if isinstance(url, str) else url
    return F.regexp_extract(u, r"^[A-Za-z]+://([^/?#:]+)", 1)


def page_fields(pages: DataFrame) -> DataFrame:
    """Title, h1, link and ad counts per page, all as column expressions."""
    h = F.col("html")
    return pages.select(
        "page_id", page_host("url").alias("host"),
        F.regexp_extract(h, "<title>(.*?)</title>", 1).alias("title"),
        F.regexp_extract(h, "<h1>(.*?)</h1>", 1).alias("h1"),
        F.size(F.regexp_extract_all(h, F.lit('href="([^"]*)"'), F.lit(1))).cast("bigint").alias("n_links"),
        F.size(F.regexp_extract_all(h, F.lit('(class="ad")'), F.lit(1))).cast("bigint").alias("n_ads"))
