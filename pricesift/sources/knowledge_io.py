"""Knowledge-base storage.

The reference stores each table as one JSON object mapping id -> record. Here every
line is such an object with one entry, so a line is one record however large the table
is, any reader can split the files, and a file of the original format (one object for
everything) still loads. Schemas are given, never inferred. Plain tables are written
into a fresh version folder, never over a path being read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

PRODUCT_SCHEMA = T.StructType([
    T.StructField("product_name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("storage_options", T.ArrayType(T.StringType())),
    T.StructField("price_range", T.StructType([T.StructField("min", T.DoubleType()),
                                               T.StructField("max", T.DoubleType()),
                                               T.StructField("avg", T.DoubleType())])),
    T.StructField("alternatives", T.ArrayType(T.StringType())),
    T.StructField("market_insights", T.StringType()),
])


def version_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint location for one written version."""
    return ensure_checkpoint_dir(spark).rstrip("/") + f"/kb-{name}-{uuid.uuid4().hex}"


def products_as_records(knowledge: DataFrame) -> DataFrame:
    return knowledge.select(
        F.col("product_id").cast("string").alias("id"),
        F.struct("product_name", "category", "brand", "storage_options",
                 F.struct(F.col("price_min").alias("min"), F.col("price_max").alias("max"),
                          F.col("price_avg").alias("avg")).alias("price_range"),
                 "alternatives", "market_insights").alias("record"))


def save_json_maps(records: DataFrame, path: str) -> None:
    """Write (id, record) rows as one-entry JSON maps, one per line."""
    records.select(F.to_json(F.create_map("id", "record")).alias("value")).write.mode("overwrite").text(path)


def load_json_map(spark: SparkSession, path: str, value_schema: T.StructType,
                  one_document_per_file: bool = False) -> DataFrame:
    """Read id -> record JSON maps into rows.

    Maps written by ``save_json_maps`` are read line by line. A pretty-printed single-document
    file (the original format) needs ``one_document_per_file=True``: then each
    file is parsed whole, in one task.
    """
    raw = spark.read.text(path, wholetext=one_document_per_file)
    m = F.from_json("value", T.MapType(T.StringType(), value_schema))
    return raw.select(F.explode(m).alias("id", "record")).select("id", "record.*")


def save_table(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write a full new version (the caller picks a fresh folder)."""
    df.write.mode("overwrite").format(fmt).save(path)


def load_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json") -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


# --- fixed values: the products that a new knowledge base starts with --------------------
SEED_PRODUCTS = [
    ("iPhone 16 Pro", "smartphone", "Apple", ["128GB", "256GB", "512GB", "1TB"], 999.0, 1599.0, 1200.0,
     ["iPhone 16", "iPhone 15 Pro", "Samsung Galaxy S24 Ultra", "Google Pixel 9 Pro"]),
    ("iPhone 16", "smartphone", "Apple", ["128GB", "256GB", "512GB"], 799.0, 1099.0, 900.0,
     ["iPhone 15", "iPhone 16 Plus", "Samsung Galaxy S24", "Google Pixel 9"]),
    ("Samsung Galaxy S24 Ultra", "smartphone", "Samsung", ["256GB", "512GB", "1TB"], 1199.0, 1659.0, 1400.0,
     ["iPhone 16 Pro Max", "Google Pixel 9 Pro XL", "OnePlus 12"]),
    ("OnePlus 12", "smartphone", "OnePlus", ["256GB", "512GB"], 699.0, 899.0, 799.0,
     ["Samsung Galaxy S24", "iPhone 16", "Google Pixel 9"]),
    ("MacBook Air M2", "laptop", "Apple", ["256GB", "512GB", "1TB", "2TB"], 999.0, 2499.0, 1400.0,
     ["MacBook Pro 14-inch", "Dell XPS 13", "Surface Laptop 5"]),
]
# --- end fixed values ----------------------------------------------------------------------


def seed_records(spark: SparkSession) -> DataFrame:
    """The starting products as (id, record) rows; ids are the slugs of brand and name."""
    rows = [(f"{b} {n}".lower().replace(" ", "_"), (n, c, b, st, (lo, hi, avg), alt, None))
            for n, c, b, st, lo, hi, avg, alt in SEED_PRODUCTS]
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("record", PRODUCT_SCHEMA)])
    return spark.createDataFrame(rows, schema)


def seed_if_empty(target: DataFrame, seed: DataFrame) -> DataFrame:
    """The seed rows are used only when the target has no rows."""
    return seed if target.isEmpty() else target


def add_missing(target: DataFrame, seed: DataFrame) -> DataFrame:
    """The target and those seed rows whose id it does not hold."""
    return target.unionByName(seed.join(target.select("id"), "id", "left_anti"))
