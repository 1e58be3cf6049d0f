"""Price, rating, review, availability and link parsing as column expressions.

Everything here is a built-in expression (regexp_replace / when / try_cast), so
it stays inside whole-stage codegen; nothing calls back into Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.registry import SYMBOLS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _count(s: Column, ch: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(ch), F.lit("")))


def price_digits(text) -> Column:
    """Keep only digits, dots and commas."""
    return F.regexp_replace(_c(text), r"[^0-9.,]", "")


def _european(s: Column) -> Column:
    # Both separators and the comma comes last: "1.234,56" -> "1234.56" (deviation D10).
    return F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))


def _both(s: Column) -> Column:
    return s.contains(",") & s.contains(".")


def _comma_last(s: Column) -> Column:
    return F.locate(",", F.reverse(s)) < F.locate(".", F.reverse(s))


def _to_double(s: Column) -> Column:
    return s.try_cast("double")


def clean_price_us(text) -> Column:
    """Default rule; one comma with <=2 digits after it is a decimal comma."""
    return us_rule(price_digits(text))


def us_rule(s: Column) -> Column:
    """P1 on text already reduced to digits, dots and commas (stage it as a column)."""
    no_comma = F.replace(s, F.lit(","), F.lit(""))
    after = F.substring_index(s, ",", -1)
    out = (F.when(_both(s) & _comma_last(s), _european(s))
           .when(_both(s), no_comma)
           .when(s.contains(",") & (_count(s, ",") == 1) & (F.length(after) <= 2),
                 F.replace(s, F.lit(","), F.lit(".")))
           .when(s.contains(","), no_comma)
           .otherwise(s))
    return _to_double(out)


def clean_price_india(text) -> Column:
    """Only commas -> if the last group has <=2 digits every comma becomes a dot."""
    s = price_digits(text)
    no_comma = F.replace(s, F.lit(","), F.lit(""))
    after = F.substring_index(s, ",", -1)
    out = (F.when(_both(s) & _comma_last(s), _european(s))
           .when(_both(s), no_comma)
           .when(s.contains(",") & (F.length(after) <= 2), F.replace(s, F.lit(","), F.lit(".")))
           .when(s.contains(","), no_comma)
           .otherwise(s))
    return _to_double(out)


def clean_price_strip(text) -> Column:
    """Drop every comma."""
    s = price_digits(text)
    out = F.when(_both(s) & _comma_last(s), _european(s)).otherwise(F.replace(s, F.lit(","), F.lit("")))
    return _to_double(out)


def clean_price_loose(text) -> Column:
    """eBay keeps the digit text as is; empty -> null (string result)."""
    return F.nullif(price_digits(text), F.lit(""))


def clean_price_by_rule(text, rule) -> Column:
    r = _c(rule)
    return (F.when(r == "india", clean_price_india(text))
            .when(r == "strip", clean_price_strip(text))
            .when(r == "loose", clean_price_loose(text).try_cast("double"))
            .otherwise(clean_price_us(text)))


def currency_symbol(text) -> Column:
    """P6 helper: ISO code for a currency symbol found in the price text."""
    sym = F.regexp_extract(_c(text), "([" + "".join(SYMBOLS) + "])", 1)
    expr = F.lit(None).cast("string")
    for s, iso in SYMBOLS.items():
        expr = F.when(sym == s, F.lit(iso)).otherwise(expr)
    return expr


def pick_currency(text, declared, target) -> Column:
    """Symbol in the text, else the declared currency, else the target."""
    return F.coalesce(currency_symbol(text), F.nullif(_c(declared), F.lit("")), _c(target))


def shipping_cost(text) -> Column:
    """P16: 'free' -> '0', else the first number run."""
    t = _c(text)
    return F.when(F.lower(t).contains("free"), F.lit("0")).otherwise(
        F.nullif(F.regexp_extract(t, r"[\d.,]+", 0), F.lit("")))


def parse_rating(text, bounded: bool = False) -> Column:
    """First number in the text; India/Flipkart rules require 0..5."""
    v = F.nullif(F.regexp_extract(_c(text), r"(\d+\.?\d*)", 1), F.lit("")).try_cast("double")
    return F.when(v.between(0, 5), v) if bounded else v


def parse_reviews(text, positive_only: bool = False) -> Column:
    """First digit-or-comma group, commas removed."""
    g = F.regexp_extract(_c(text), r"([0-9,]+)", 1)
    v = F.nullif(F.replace(g, F.lit(","), F.lit("")), F.lit("")).try_cast("bigint")
    return F.when(v > 0, v) if positive_only else v


def availability_class(text) -> Column:
    """P19 with D9: out-of-stock words are tested before in-stock words."""
    t = F.lower(_c(text))
    return (F.when(t.rlike("out of stock|unavailable|sold out|currently out"), "Out of Stock")
            .when(t.rlike("stock|available|delivery|ships"), "In Stock")
            .when(t.rlike("out|sold"), "Out of Stock")
            .otherwise("Unknown"))


def absolute_link(href, domain) -> Column:
    """P15: '/x' -> https://domain/x, keep http(s) links, else null."""
    h = _c(href)
    return (F.when(h.startswith("/"), F.concat(F.lit("https://"), _c(domain), h))
            .when(h.startswith("http"), h))


def link_product_id(href) -> Column:
    """Ten-character product id after /dp/ or /gp/product/."""
    return F.nullif(F.regexp_extract(_c(href), r"/(?:dp|gp/product)/([A-Z0-9]{10})", 1), F.lit(""))
