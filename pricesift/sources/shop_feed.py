"""A shop's feed as a table: Python data source ``shop_feed``.

A feed is a folder of Parquet files in partitions by shop and country, as a crawler or a
shop's export leaves them. ``spark.read.format("shop_feed").option("path", folder).load()``
reads it: one input partition per file, and filters on ``shop`` and
``shop_country`` (equality, IN) pushed into the listing, so files of other shops are not
opened. A shop that is not registered (see ``registry``) is left out: what can be asked is
what the registry knows. Other kinds of feed subclass ``ShopFeedReader`` and override
``files`` and ``batches``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .registry import registry_rows

SCHEMA = ("shop string, shop_country string, product_id long, seller_id long, product_name string, currency string, price string, "
          "availability string, rating double, reviews_count long, shipping_cost string, seller string")
_KEYS = ("shop", "shop_country")


@dataclass
class FeedFile(InputPartition):
    """One file of a feed."""

    path: str
    shop: str
    shop_country: str


class ShopFeedReader(DataSourceReader):
    """Lists a feed's files and reads them as Arrow batches."""

    def __init__(self, schema: StructType, path: str, known: set[tuple[str, str]]):
        self.schema, self.path, self.known = schema, path, known
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if column not in _KEYS:
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.wanted[column] = self.wanted.get(column, values) & values

    def files(self) -> Iterator[FeedFile]:
        """All files of the feed with their shop and country."""
        store, base = fs.FileSystem.from_uri(self.path)
        for info in store.get_file_info(fs.FileSelector(base, recursive=True)):
            parts = dict(p.split("=", 1) for p in info.path[len(base):].strip("/").split("/")[:-1] if "=" in p)
            if info.path.endswith(".parquet") and parts.keys() >= {*_KEYS}:
                yield FeedFile(info.path, unquote(parts["shop"]), unquote(parts["shop_country"]))

    def partitions(self) -> list[FeedFile]:
        return [f for f in self.files() if (f.shop, f.shop_country) in self.known
                and all(getattr(f, k) in v for k, v in self.wanted.items())]

    def batches(self, file: FeedFile, columns: list[str]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(file.path) as f:
            yield from pq.ParquetFile(f).iter_batches(columns=columns)

    def read(self, partition: FeedFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file is left: Spark still asks once
            return
        arrow = to_arrow_schema(self.schema)
        for batch in self.batches(partition, [n for n in arrow.names if n not in _KEYS]):
            columns = [pa.repeat(getattr(partition, f.name), batch.num_rows) if f.name in _KEYS
                       else batch.column(batch.schema.get_field_index(f.name)).cast(f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)


class ShopFeed(DataSource):
    """``shop_feed``: option ``path``, a folder that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "shop_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ShopFeedReader:
        known = self.options.get("shops")  # the registry as the session knows it: workers import a fresh one
        rows = [tuple(x.split("@", 1)) for x in known.split("|")] if known else [(r[0], r[1]) for r in registry_rows()]
        return ShopFeedReader(schema, self.options["path"], set(rows))


def read_feed(spark: SparkSession, path: str):
    """A feed as a DataFrame, restricted to the shops registered in this session."""
    spark.dataSource.register(ShopFeed)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    uri = path if "://" in path or path.startswith("file:") else f"file://{path}"
    shops = "|".join(f"{r[0]}@{r[1]}" for r in registry_rows())
    return spark.read.format("shop_feed").option("path", uri).option("shops", shops).load()
