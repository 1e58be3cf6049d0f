"""Product and query feature extraction.

All extraction is ``regexp_extract`` / ``rlike`` chains; ``(?U)`` makes Java's
``\\b``, ``\\d``, ``\\s`` Unicode-aware like the Python patterns they mirror.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import title_case

# --- fixed values: patterns and texts that must equal the reference's -----------
PRODUCT_BRANDS = [
    ("apple", r"\b(apple|iphone|ipad|macbook|imac|airpods)\b"),
    ("samsung", r"\b(samsung|galaxy)\b"),
    ("oneplus", r"\b(oneplus|one\s*plus)\b"),
    ("xiaomi", r"\b(xiaomi|mi|redmi)\b"),
    ("oppo", r"\b(oppo)\b"),
    ("vivo", r"\b(vivo)\b"),
    ("realme", r"\b(realme)\b"),
    ("google", r"\b(google|pixel)\b"),
    ("sony", r"\b(sony|xperia)\b"),
    ("lg", r"\b(lg)\b"),
    ("motorola", r"\b(motorola|moto)\b"),
    ("nokia", r"\b(nokia)\b"),
    ("huawei", r"\b(huawei|honor)\b"),
]
PRODUCT_STORAGE = r"\b(\d+)\s*(gb|tb|mb)\b"
PRODUCT_RAM = r"\b(\d+)\s*gb\s*(ram|memory)\b"
PRODUCT_COLORS = (r"\b(black|white|blue|red|green|gold|silver|rose|pink|purple|yellow|orange|gray|grey"
                  r"|titanium|natural|pro|max)\b")
GENERIC_MODEL = r"\b([a-z]+\s*\d+(?:\s*[a-z]+)*)\b"
PRODUCT_CATEGORIES = [
    ("smartphone", r"\b(phone|smartphone|mobile)\b"),
    ("laptop", r"\b(laptop|notebook|macbook)\b"),
    ("tablet", r"\b(tablet|ipad)\b"),
    ("headphones", r"\b(headphones|earphones|airpods|earbuds)\b"),
    ("watch", r"\b(watch|smartwatch)\b"),
]
CAMERA = r"\b(\d+)\s*mp\b"
DISPLAY = r"\b(\d+\.?\d*)\s*inch\b"

QUERY_STORAGE = r"(\d+)\s*(gb|tb)"
QUERY_STORAGE_WORDS = r"(\d+)\s*(gigabyte|terabyte)"
QUERY_MEMORY = r"(\d+)\s*gb\s*(ram|memory)"
QUERY_MEMORY_WORDS = r"(\d+)\s*gigabyte\s*(ram|memory)"
QUERY_COLORS = (r"\b(black|white|silver|gold|rose\s*gold|space\s*gray|midnight|starlight|blue|red|green"
                r"|purple|pink|yellow|orange)\b")
QUERY_BRANDS = [
    r"\b(apple|samsung|google|oneplus|xiaomi|huawei|sony|lg|motorola|nokia|oppo|vivo|realme)\b",
    r"\b(dell|hp|lenovo|asus|acer|msi|razer|alienware|surface|macbook)\b",
]
QUERY_MODELS = [
    r"\b(iphone\s*\d+(?:\s*pro)?(?:\s*max)?)\b",
    r"\b(galaxy\s*s\d+(?:\s*ultra)?(?:\s*plus)?)\b",
    r"\b(pixel\s*\d+(?:\s*pro)?(?:\s*xl)?)\b",
    r"\b(oneplus\s*\d+(?:\s*pro)?)\b",
    r"\b(macbook\s*(?:air|pro)?(?:\s*m\d+)?)\b",
]
PHONE_WORDS = ["phone", "iphone", "galaxy", "pixel"]
HINT_VAGUE = "Try adding more specific details like storage size, color, or model"
HINT_BRAND = "Consider specifying a brand (Apple, Samsung, Google, etc.)"
HINT_STORAGE = "Add storage capacity (128GB, 256GB, etc.) for better results"
HINT_MODEL = "Include specific model name or number"
# --- end fixed values -------------------------------------------------------------


def _u(p: str) -> str:
    return "(?U)" + p


def _extract(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, _u(pattern), group), F.lit(""))


def _first_label(text: Column, table: list[tuple[str, str]]) -> Column:
    expr = F.lit(None).cast("string")
    for label, pat in reversed(table):
        expr = F.when(text.rlike(_u(pat)), F.lit(label)).otherwise(expr)
    return expr


def product_features(name, query=None) -> Column:
    """F8 on ``lower(name || ' ' || query)`` (the query leaks into both sides, D5)."""
    n = F.col(name) if isinstance(name, str) else name
    q = F.lit("") if query is None else (F.col(query) if isinstance(query, str) else query)
    text = F.lower(F.concat_ws(" ", n, F.coalesce(q, F.lit(""))))
    storage = F.when(text.rlike(_u(PRODUCT_STORAGE)),
                     F.concat(F.regexp_extract(text, _u(PRODUCT_STORAGE), 1),
                              F.upper(F.regexp_extract(text, _u(PRODUCT_STORAGE), 2))))
    ram = F.when(text.rlike(_u(PRODUCT_RAM)), F.concat(F.regexp_extract(text, _u(PRODUCT_RAM), 1), F.lit("GB RAM")))
    cam = F.when(text.rlike(_u(CAMERA)), F.concat(F.regexp_extract(text, _u(CAMERA), 1), F.lit("MP")))
    disp = F.when(text.rlike(_u(DISPLAY)), F.concat(F.regexp_extract(text, _u(DISPLAY), 1), F.lit('"')))
    model = F.trim(_extract(text, GENERIC_MODEL))
    return F.struct(
        _first_label(text, PRODUCT_BRANDS).alias("brand"),
        model.alias("model"),
        storage.alias("storage"),
        _extract(text, PRODUCT_COLORS).alias("color"),
        _first_label(text, PRODUCT_CATEGORIES).alias("category"),
        F.array_compact(F.array(ram, cam, disp)).alias("key_specs"),
    )


def feature_scores(f1: Column, f2: Column) -> dict[str, Column]:
    """per-feature comparison scores."""
    def cmp(a, b, same, diff, null):
        return F.when(a.isNull() | b.isNull(), F.lit(null)).when(a == b, F.lit(same)).otherwise(F.lit(diff))
    return {
        "brand": cmp(f1["brand"], f2["brand"], 1.0, 0.0, 0.5),
        "storage": cmp(f1["storage"], f2["storage"], 1.0, 0.3, 0.5),
        "color": cmp(f1["color"], f2["color"], 1.0, 0.6, 0.8),
    }


def query_features(query) -> Column:
    """F12 with D6 (gigabyte/terabyte parsed as numbers) and D7 (str.title())."""
    q = F.lower(F.col(query) if isinstance(query, str) else query)
    has_st = q.rlike(QUERY_STORAGE)
    has_stw = q.rlike(QUERY_STORAGE_WORDS)
    st_n = F.when(has_st, F.regexp_extract(q, QUERY_STORAGE, 1)).when(has_stw, F.regexp_extract(q, QUERY_STORAGE_WORDS, 1))
    st_u = (F.when(has_st, F.upper(F.regexp_extract(q, QUERY_STORAGE, 2)))
            .when(has_stw, F.when(F.regexp_extract(q, QUERY_STORAGE_WORDS, 2) == "terabyte", "TB").otherwise("GB")))
    storage_gb = F.when(st_u == "TB", st_n.cast("bigint") * 1024).otherwise(st_n.cast("bigint"))
    mem_n = F.when(q.rlike(QUERY_MEMORY), F.regexp_extract(q, QUERY_MEMORY, 1)) \
        .when(q.rlike(QUERY_MEMORY_WORDS), F.regexp_extract(q, QUERY_MEMORY_WORDS, 1))
    color = F.when(q.rlike(_u(QUERY_COLORS)), title_case(F.regexp_extract(q, _u(QUERY_COLORS), 1)))
    brand = F.when(q.rlike(_u(QUERY_BRANDS[0])), title_case(F.regexp_extract(q, _u(QUERY_BRANDS[0]), 1))) \
        .when(q.rlike(_u(QUERY_BRANDS[1])), title_case(F.regexp_extract(q, _u(QUERY_BRANDS[1]), 1)))
    model = F.lit(None).cast("string")
    for pat in reversed(QUERY_MODELS):
        model = F.when(q.rlike(_u(pat)), title_case(F.regexp_extract(q, _u(pat), 1))).otherwise(model)
    return F.struct(
        F.concat(st_n, st_u).alias("storage"), storage_gb.alias("storage_gb"),
        F.concat(mem_n, F.lit("GB")).alias("memory"), mem_n.cast("bigint").alias("memory_gb"),
        color.alias("color"), brand.alias("brand"), model.alias("model"))


def feature_count(f: Column) -> Column:
    """A10: number of extracted query features."""
    names = ["storage", "storage_gb", "memory", "memory_gb", "color", "brand", "model"]
    return sum((F.when(f[n].isNotNull(), 1).otherwise(0) for n in names), F.lit(0))


def query_hints(query, f: Column) -> Column:
    """improvement hints, in the reference's order."""
    q = F.col(query) if isinstance(query, str) else query
    lq = F.lower(q)
    n_words = F.size(F.filter(F.split(F.trim(q), r"\s+"), lambda t: t != ""))
    phone = F.lit(False)
    for w in PHONE_WORDS:
        phone = phone | lq.contains(w)
    return F.array_compact(F.array(
        F.when(n_words < 2, F.lit(HINT_VAGUE)),
        F.when(f["brand"].isNull(), F.lit(HINT_BRAND)),
        F.when(f["storage"].isNull() & phone, F.lit(HINT_STORAGE)),
        F.when(f["model"].isNull(), F.lit(HINT_MODEL))))
