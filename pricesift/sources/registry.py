"""Shop registry (S11) and fixed lookup tables.

These are fixed values that must equal the reference's shop definitions for the
same URLs, currencies and parsing rules. They are literal dimensions with a
known, small row count, so broadcasting them is always safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
AMAZON_COUNTRIES = [
    ("US", "amazon.com", "USD"), ("CA", "amazon.ca", "CAD"), ("UK", "amazon.co.uk", "GBP"),
    ("DE", "amazon.de", "EUR"), ("FR", "amazon.fr", "EUR"), ("IT", "amazon.it", "EUR"),
    ("ES", "amazon.es", "EUR"), ("JP", "amazon.co.jp", "JPY"), ("IN", "amazon.in", "INR"),
    ("AU", "amazon.com.au", "AUD"), ("BR", "amazon.com.br", "BRL"), ("MX", "amazon.com.mx", "MXN"),
    ("NL", "amazon.nl", "EUR"), ("SE", "amazon.se", "SEK"), ("PL", "amazon.pl", "PLN"),
    ("TR", "amazon.com.tr", "TRY"), ("AE", "amazon.ae", "AED"), ("SA", "amazon.sa", "SAR"),
    ("SG", "amazon.sg", "SGD"),
]
EBAY_COUNTRIES = [
    ("US", "ebay.com", "USD"), ("CA", "ebay.ca", "CAD"), ("UK", "ebay.co.uk", "GBP"),
    ("DE", "ebay.de", "EUR"), ("FR", "ebay.fr", "EUR"), ("IT", "ebay.it", "EUR"),
    ("ES", "ebay.es", "EUR"), ("AU", "ebay.com.au", "AUD"), ("IN", "ebay.in", "INR"),
    ("SG", "ebay.com.sg", "SGD"), ("MY", "ebay.com.my", "MYR"), ("PH", "ebay.ph", "PHP"),
]
# Search URL templates; {domain} and {q} (the url-encoded query) are filled in.
URL_TEMPLATES = {
    "Amazon": "https://{domain}/s?k={q}&ref=sr_pg_1&sort=relevanceblender",
    "eBay": "https://{domain}/sch/i.html?_nkw={q}&_sacat=0&LH_BIN=1&_sop=15&rt=nc",
    "BestBuy": "https://www.bestbuy.com/site/searchpage.jsp?st={q}",
    "Walmart": "https://www.walmart.com/search?q={q}",
    "Target": "https://www.target.com/s?searchTerm={q}",
    "Flipkart": "https://www.flipkart.com/search?q={q}&sort=relevance",
    "Amazon India": "https://www.amazon.in/s?k={q}&ref=sr_pg_1&sort=relevanceblender",
}
# Registration order of the shops (stable tie-break for equal priority).
SHOP_ORDER = ["Amazon", "eBay", "BestBuy", "Walmart", "Target", "Flipkart", "Amazon India"]
# Which price-text rule each shop's cards use.
PRICE_RULES = {"Amazon": "us", "eBay": "loose", "BestBuy": "us", "Walmart": "us",
               "Target": "us", "Flipkart": "strip", "Amazon India": "india"}
# Shops that fall back to US for an unsupported country when building URLs.
US_FALLBACK = {"Amazon", "eBay"}
# Source reliability used by the rank score; anything else scores 0.6.
RELIABILITY = {"amazon": 0.9, "apple": 0.95, "bestbuy": 0.85, "walmart": 0.8,
               "target": 0.75, "ebay": 0.7}
# Currency rates to USD (latest rate, no date).
FX_TO_USD = {"USD": 1.0, "INR": 0.012, "EUR": 1.1, "GBP": 1.25}
# Price-text currency symbols to ISO codes.
SYMBOLS = {"$": "USD", "₹": "INR", "€": "EUR", "£": "GBP"}
# Card caps per shop page (first N containers are parsed).
CARD_CAPS = {"Amazon": 20, "Amazon India": 20, "Flipkart": 25, "eBay": 15}
# Card containers (tried in order) and the classes of a card's fields (first non-empty wins).
_AMAZON = {
    "containers": [{"attr": "data-component-type", "value": "s-search-result"}, {"class": "s-result-item", "attr": "data-asin"},
                   {"class": "s-widget-container"}],
    "id_attrs": ["data-asin", "data-uuid"], "needs_id": True, "image_attrs": ["data-src", "src"], "seller_name": "Amazon",
    "title": ["a-size-medium", "a-size-base-plus", "a-link-normal"], "price": ["a-offscreen", "a-price-whole", "a-color-price"],
    "rating": ["a-icon-alt"], "reviews": ["s-underline-text", "a-size-base"], "availability": ["a-color-success", "a-color-price"]}
PROFILES = {
    "Amazon": _AMAZON,
    "Amazon India": {**_AMAZON, "price": ["a-price-whole", "a-offscreen"], "seller_name": "Amazon India"},
    "Flipkart": {"containers": [{"attr": "data-id"}, {"class": "_1AtVbE"}, {"class": "_13oc-S"}, {"class": "_2kHMtA"}],
                 "id_attrs": ["data-id"], "image_attrs": ["src", "data-src"], "seller_name": "Flipkart",
                 "title": ["_4rR01T", "s1Q9rs", "_2WkVRV", "IRpwTa"], "price": ["_30jeq3", "_1_WHN1", "Nx9bqj", "_3tbKJL"],
                 "rating": ["_3LWZlK"], "reviews": ["_2_R_DZ"], "availability": ["_2Tpdn3"]},
    "eBay": {"containers": [{"class": "s-item"}], "id_attrs": [], "image_attrs": ["src"], "seller_name": "eBay Seller",
             "availability_default": "Available", "title": ["s-item__title"], "price": ["notranslate", "s-item__price"],
             "shipping": ["s-item__shipping"], "seller": ["s-item__seller-info-text"]},
}
# --- end fixed values -------------------------------------------------------


def registry_rows() -> list[tuple]:
    rows = []
    for order, shop in enumerate(SHOP_ORDER):
        if shop == "Amazon":
            entries = AMAZON_COUNTRIES
        elif shop == "eBay":
            entries = EBAY_COUNTRIES
        elif shop in dict(EXTRA_SHOPS):
            entries = dict(EXTRA_SHOPS)[shop]
        elif shop in ("Flipkart", "Amazon India"):
            entries = [("IN", "www.flipkart.com" if shop == "Flipkart" else "www.amazon.in", "INR")]
        else:
            entries = [("US", f"www.{shop.lower()}.com", "USD")]
        for country, domain, currency in entries:
            rows.append((shop, country, domain, currency, 1, order, PRICE_RULES[shop],
                         URL_TEMPLATES[shop]))
    return rows


REGISTRY_SCHEMA = T.StructType([
    T.StructField("source", T.StringType(), False),
    T.StructField("country", T.StringType(), False),
    T.StructField("domain", T.StringType(), False),
    T.StructField("currency", T.StringType(), False),
    T.StructField("priority", T.IntegerType(), False),
    T.StructField("reg_order", T.IntegerType(), False),
    T.StructField("price_rule", T.StringType(), False),
    T.StructField("url_template", T.StringType(), False),
])


def source_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(registry_rows(), REGISTRY_SCHEMA)


def sql_values(rows: list[tuple], columns: list[str]) -> str:
    """Render literal rows as a SQL VALUES relation (for the DuckDB oracle)."""
    def lit(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return repr(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({', '.join(columns)}))"


def registry_sql() -> str:
    return sql_values(registry_rows(), [f.name for f in REGISTRY_SCHEMA.fields])


def fx_sql() -> str:
    return sql_values(sorted(FX_TO_USD.items()), ["currency", "rate_to_usd"])


EXTRA_SHOPS: list[tuple] = []


def register_shop(name: str, countries: list[tuple[str, str, str]], url_template: str,
                  price_rule: str = "us", us_fallback: bool = False, card_cap: int | None = None,
                  profile: dict | None = None) -> None:
    """Add a shop (country, domain, currency rows, URL template with {domain}/{q}, price rule, card profile).

    Shops are data: registering one extends the registry that shop selection, URL
    building, page extraction and price parsing read when a query is built.
    """
    if name in SHOP_ORDER:
        raise ValueError(f"shop {name} already registered")
    SHOP_ORDER.append(name)
    URL_TEMPLATES[name] = url_template
    PRICE_RULES[name] = price_rule
    if us_fallback:
        US_FALLBACK.add(name)
    if card_cap is not None:
        CARD_CAPS[name] = card_cap
    if profile is not None:
        PROFILES[name] = {"id_attrs": [], "image_attrs": ["src"], "seller_name": name, **profile}
    EXTRA_SHOPS.append((name, list(countries)))
