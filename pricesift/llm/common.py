"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = re.compile(r"[\x20\x09-\x0D]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(id_col: str, text_col: str) -> Column:
    """128-bit identity of an (id, text) row: rows of equal id and text share it; a null id is its own id."""
    known = F.concat(F.lit("1"), F.col(id_col).cast("string"))
    return F.unhex(F.md5(F.concat_ws("\0", F.coalesce(known, F.lit("0")), F.coalesce(F.col(text_col), F.lit(""))).cast("binary")))


def byte_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8: bytes.split() parts at exactly these six bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def texts(batch: pa.RecordBatch, column: int = 0) -> Iterator[str | None]:
    """The strings of one Arrow column, one at a time."""
    for value in batch.column(column):
        yield value.as_py()

