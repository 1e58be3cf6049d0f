"""Corpus pipeline: quality rules, near-duplicates, decontamination, secrets, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns
a DataFrame that is written as Parquet to the shared folder and read again as the next
one's ``docs``. All stages but the last keep the columns of ``documents``:

quality_rules     documents rejected by the base rules or a risk-controlled cutoff go
simhash_dedup     one document of each near-duplicate group stays, the one with the smallest id
decontamination   documents with too many benchmark words go
secret_scan       secrets are replaced by a mark; every document stays
packing           token ids of what is left, packed into sequences

The stages handle null ids and texts, repeated rows, empty tables and extra columns as
their operators define it (see ``pricesift/llm``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricesift.llm import decontaminate, packing, quality_rules, secret_scan, simhash
from pricesift.llm.common import table
from pricesift.llm.oracles import ORACLES
from pricesift.llm.queries import QUERIES
from pricesift.session import write_shared


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, shingle=4, max_bits=4)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, with_ids=True)


STAGES = [("quality_rules", quality_stage), ("simhash_dedup", dedup_stage),
          ("decontamination", decontamination_stage), ("secret_scan", secret_stage), ("packing", packing_stage)]

#: SQL can't express fingerprint components, guess costs or tokenisation: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def corpus_queries() -> dict:
    return {**QUERIES, "pipeline": run}


def corpus_oracles() -> dict:
    return {**ORACLES, **({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})}
