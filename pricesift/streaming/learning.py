"""Streaming price learning (M1) over stored history, and its versions (M2).

State per product is its newest 30 points, a list state of ``transformWithStateInPandas``
that starts from the stored history, so a run goes on where the last one ended. Each
micro-batch merges new points in (observed_at, seq, seq2) order; the result equals the
batch window query over old and new points, whatever order and however many runs they
arrive in. ``foreachBatch`` appends updates to a log; at the end the log is folded into
the stored history (the newest update per product, else the stored row) and published as
the next version of a ``SnapshotStore``, the old version staying readable until then.

With ``stale_after_ms`` a product that gets no point for that long (processing time) is
reported once as stale by a timer; its history stays.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ensure_checkpoint_dir
from ..settings import DEFAULT
from .snapshots import SnapshotStore

POINT = T.StructType([T.StructField("ts", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("seq2", T.LongType()),
                      T.StructField("price", T.DoubleType()), T.StructField("source", T.StringType()),
                      T.StructField("product_name", T.StringType())])
_COLS = [f.name for f in POINT.fields]
#: One row per product: its kept points, oldest first, as lists.
HISTORY = T.StructType([T.StructField("product_id", T.LongType()),
                        *[T.StructField(f.name, T.ArrayType(f.dataType)) for f in POINT.fields], T.StructField("stale", T.BooleanType())])
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PriceHistory(StatefulProcessor):
    """Keeps a product's newest points; emits them all whenever one of them is new."""

    def __init__(self, keep: int, stale_after_ms: int | None):
        self.keep, self.stale_after_ms = keep, stale_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.points = handle, handle.getListState("points", POINT)

    def _row(self, key, points: list[tuple], stale: bool) -> pd.DataFrame:
        columns = {c: [list(v)] for c, v in zip(_COLS, zip(*points, strict=True), strict=True)}
        return pd.DataFrame({"product_id": [int(key[0])], **columns, "stale": [stale]})

    def handleInitialState(self, key, initialState, timerValues) -> None:
        frames = [initialState] if isinstance(initialState, pd.DataFrame) else list(initialState)
        rows = [tuple(_plain(v) for v in r) for f in frames for lists in zip(*(f[c] for c in _COLS), strict=True) for r in zip(*lists, strict=True)]
        self.points.put(sorted(rows, key=lambda p: p[:3])[-self.keep:])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.points.get())
        touched = False
        for frame in rows:  # each frame is cut to its newest points before the next is read
            # Plain values: a frame holds few points of one product, so pandas would cost more than the points.
            known = [tuple(_plain(v) for v in p) for p in zip(*(frame[c].tolist() for c in _COLS), strict=True)]
            known = [p for p in known if p[5] and p[3] is not None]
            if known:
                held = sorted([*map(tuple, held), *known], key=lambda p: p[:3])[-self.keep:]
                touched = True
        if touched:
            self.points.put(held)
            if self.stale_after_ms is not None:
                for timer in self.handle.listTimers():
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.stale_after_ms)
            yield self._row(key, held, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [tuple(p) for p in self.points.get()]
        if held:
            yield self._row(key, held, True)

    def close(self) -> None:
        pass


def _plain(value):
    """A Python value of a numpy one; missing values are None."""
    value = value.item() if hasattr(value, "item") else value
    return None if value is None or value != value else value


def learning_stream(points: DataFrame, history: DataFrame | None = None, keep: int = DEFAULT.history_keep,
                    stale_after_ms: int | None = None) -> DataFrame:
    """Stateful update stream: one row per product touched in a micro-batch; ``history`` is the state at the start."""
    p = points.select("product_id", F.unix_micros("observed_at").alias("ts"), "seq", "seq2", "price", "source", "product_name")
    start = history.select("product_id", *_COLS).groupBy("product_id") if history is not None else None
    return p.groupBy("product_id").transformWithStateInPandas(
        PriceHistory(keep, stale_after_ms), HISTORY, "Update", "None" if stale_after_ms is None else "ProcessingTime", start)


def merge_history(previous: DataFrame | None, updates: DataFrame) -> DataFrame:
    """The newest update per product, else its previous row.

    ``max`` of a struct combines map-side, so a product with most of the updates ships one row per task.
    """
    cols = [f.name for f in HISTORY.fields if f.name != "product_id"]
    rows = updates.select("product_id", "batch_id", *cols)
    if previous is not None:
        rows = rows.unionByName(previous.withColumn("batch_id", F.lit(-1).cast("bigint")).select("product_id", "batch_id", *cols))
    newest = rows.groupBy("product_id").agg(F.max(F.struct("batch_id", *cols)).alias("r"))
    return newest.select("product_id", *[F.col("r")[c].alias(c) for c in cols])


def insights_of(history: DataFrame) -> DataFrame:
    """The insight row of each product (W3, W4 and the reference's defaults) from its kept points."""
    price, n = F.col("price"), F.size("price")
    last, third = F.element_at(price, -1), F.element_at(price, -3)
    trend = F.when(n < 3, "stable").when(last > third, "increasing").when(last < third, "decreasing").otherwise("stable")
    return history.select(
        "product_id", n.cast("bigint").alias("n_points"), last.alias("current_price"), trend.alias("price_trend"),
        F.timestamp_micros(F.element_at("ts", -1)).alias("last_updated"), F.timestamp_micros(F.element_at("ts", 1)).alias("oldest_kept"),
        F.element_at("product_name", -1).alias("product_name"), F.lit("Monitor for trends").alias("best_time_to_buy"),
        F.lit(None).cast("double").alias("price_prediction"), F.lit("Insufficient data for analysis").alias("market_analysis"))


def run_learning(spark: SparkSession, source: DataFrame, store: SnapshotStore | None = None, keep: int = DEFAULT.history_keep) -> DataFrame:
    """Run the stream to its end (availableNow) over the stored history, publish the next version, return its insights."""
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/learning-{uuid.uuid4().hex}"
    store = store or SnapshotStore(spark, base)
    versions = store.versions()
    at = versions[-1] if versions else None
    previous, log = store.read("history", at), store.new_folder("log")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, _ROCKSDB)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    try:
        query = (learning_stream(source, previous, keep).writeStream.outputMode("update").foreachBatch(sink)
                 .option("checkpointLocation", base + "/state").trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    schema = T.StructType([*HISTORY, T.StructField("batch_id", T.LongType())])
    # A stream without a file has no batch and no log.
    found = store._fs.exists(store._path(log))
    updates = spark.read.schema(schema).parquet(f"{log}/batch=*") if found else spark.createDataFrame([], schema)
    version = store.commit({"history": merge_history(previous, updates)}, at)
    return insights_of(store.read("history", version))
