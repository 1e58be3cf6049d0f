"""Identifiers: document ids (F18) built from content and metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def metadata_json(meta: dict[str, Column]) -> Column:
    """JSON text with sorted keys and ", " / ": " separators (string values)."""
    parts = []
    for i, k in enumerate(sorted(meta)):
        sep = "" if i == 0 else ", "
        parts += [F.lit(f'{sep}"{k}": "'), F.replace(F.replace(meta[k], F.lit("\\"), F.lit("\\\\")),
                                                     F.lit('"'), F.lit('\\"')), F.lit('"')]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def document_id(content, meta: dict[str, Column]) -> Column:
    """md5(content) + '_' + md5(sorted metadata JSON)."""
    c = F.col(content) if isinstance(content, str) else content
    return F.concat_ws("_", F.md5(c), F.md5(metadata_json(meta)))
