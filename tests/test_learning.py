"""Stream result equals the batch window result (M1)."""
from pricesift.operators.history import learn_prices
from pricesift.sources import tables as T
from pricesift.streaming.learning import run_learning

COLS = ["product_id", "n_points", "current_price", "price_trend", "last_updated", "oldest_kept", "product_name"]


def test_stream_equals_batch(spark, sf):
    batch = learn_prices(T.event_points(spark, sf)).select(*COLS).collect()
    stream = run_learning(spark, T.events_stream(spark, sf)).select(*COLS).collect()
    key = lambda r: r.product_id
    assert sorted(map(tuple, batch), key=lambda t: t[0]) == sorted(map(tuple, stream), key=lambda t: t[0])
    assert len(batch) > 0 and max(r.n_points for r in batch) <= 30
    assert key(batch[0]) is not None


def test_stream_two_batches_out_of_order(spark, sf, tmp_path):
    """Newer events arrive in the first micro-batch, older ones in the second; state must merge."""
    import os
    import time

    from pyspark.sql import functions as F
    ev = T.table(spark, sf, "events")
    cut = ev.approxQuantile("event_id", [0.5], 0.0)[0]
    d = str(tmp_path)
    import pyarrow as pa
    import pyarrow.parquet as pq
    newer = ev.filter(F.col("event_id") > cut).toArrow()
    older = ev.filter(F.col("event_id") <= cut).toArrow()
    pq.write_table(newer, os.path.join(d, "events.parquet"))
    time.sleep(1.1)   # the file source orders files by modification time
    pq.write_table(older, os.path.join(d, "events_2.parquet"))
    assert isinstance(newer, pa.Table)
    batch = learn_prices(T.points_from_events(ev)).select(*COLS).collect()
    stream = run_learning(spark, T.events_stream(spark, d)).select(*COLS).collect()
    assert sorted(map(tuple, batch), key=lambda t: t[0]) == sorted(map(tuple, stream), key=lambda t: t[0])


def test_roundtrip_stores_whole_texts(spark, sf, monkeypatch):
    from pricesift.plans import q_learning as Q
    saved, save = [], Q.K.save_table
    monkeypatch.setattr(Q.K, "save_table", lambda docs, *a, **k: (saved.append(docs.columns), save(docs, *a, **k))[1])
    assert Q.kb_roundtrip(spark, sf).count() == T.table(spark, sf, "documents").count()
    assert saved == [["doc_id", "lang", "source", "n_chars", "text"]]


def points(spark, rows):
    """(product, second, seq, price) rows as price points."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(p, f"name {p}" if p else "", s, q, 0, float(x), "shop") for p, s, q, x in rows],
                               "product_id long, product_name string, s long, seq long, seq2 long, price double, source string")
    return df.withColumn("observed_at", F.timestamp_seconds("s")).drop("s")


def run_over(spark, rows, folder, store):
    p = points(spark, rows)
    p.write.parquet(folder)
    return run_learning(spark, spark.readStream.schema(p.schema).parquet(folder), store)


def test_runs_continue_the_stored_history(spark, tmp_path):
    import random

    from pricesift.streaming.snapshots import SnapshotStore
    rng = random.Random(6)
    rows = [(rng.randrange(1, 6), rng.randrange(1000), i, rng.randrange(1, 50)) for i in range(300)]
    rows += [(9, i, 1000 + i, 10 + i) for i in range(12)]  # rising, cut between the runs
    parts = [rows[:120] + rows[300:310], rows[120:250], rows[250:300] + rows[310:]]
    base = str(tmp_path / "store")
    for i, part in enumerate(parts):
        got = run_over(spark, part, str(tmp_path / f"in{i}"), SnapshotStore(spark, base))  # a new store object each time, as in a new session
    want = learn_prices(points(spark, rows)).select(*COLS).collect()
    assert sorted(map(tuple, got.select(*COLS).collect())) == sorted(map(tuple, want))
    assert {r.product_id: (r.n_points, r.price_trend) for r in want}[9] == (12, "increasing")
    store = SnapshotStore(spark, base)
    assert store.versions() == [0, 1, 2] and store.read("history", 0).where("product_id = 9").count() == 1
    kept = store.read("history").count()
    assert store.clean(keep=1) and store.versions() == [2] and store.read("history").count() == kept and not store.clean(keep=1)


def test_an_empty_run_and_a_killed_run_leave_the_history(spark, tmp_path):
    import pytest

    from pricesift.streaming.snapshots import ConcurrentCommit, SnapshotStore
    store = SnapshotStore(spark, str(tmp_path / "store"))
    assert store.manifest() is None and store.read("history") is None
    empty = points(spark, [(1, 1, 1, 1)]).limit(0)
    empty.write.parquet(str(tmp_path / "none"))
    assert run_learning(spark, spark.readStream.schema(empty.schema).parquet(str(tmp_path / "none")), store).count() == 0
    run_over(spark, [(1, 5, 1, 7), (0, 6, 2, 8)], str(tmp_path / "a"), store)  # a product without a name is not learned
    before = [tuple(r) for r in store.read("history").collect()]
    assert len(before) == 1
    store.read("history").limit(0).write.parquet(store.new_folder("data-history"))  # a run that ends before it publishes
    assert [tuple(r) for r in SnapshotStore(spark, store.base).read("history").collect()] == before
    with pytest.raises(ConcurrentCommit):
        store.commit({"history": store.read("history")}, after=0)  # version 1 exists
    assert [tuple(r) for r in store.read("history").collect()] == before
    assert len(store.clean(keep=1)) >= 2 and [tuple(r) for r in store.read("history").collect()] == before


def test_a_stale_product_is_reported_once_and_keeps_its_history():
    import pandas as pd

    from pricesift.streaming.learning import PriceHistory

    class List:
        held = []

        def get(self):
            return iter(self.held)

        def put(self, rows):
            self.held = list(rows)

    class Handle:
        timers, state = [], List()

        def getListState(self, *_):
            return self.state

        def listTimers(self):
            return list(self.timers)

        def deleteTimer(self, t):
            self.timers.remove(t)

        def registerTimer(self, t):
            self.timers.append(t)

    class Now:
        at = 0

        def getCurrentProcessingTimeInMs(self):
            return self.at

    p, h, now = PriceHistory(2, 500), Handle(), Now()
    p.init(h)
    p.handleInitialState((1,), pd.DataFrame({"product_id": [1], "ts": [[3, 1]], "seq": [[0, 0]], "seq2": [[0, 0]], "price": [[3.0, 1.0]],
                                              "source": [[None, "s"]], "product_name": [["n", "n"]]}), now)
    assert h.state.held == [(1, 0, 0, 1.0, "s", "n"), (3, 0, 0, 3.0, None, "n")]
    new = pd.DataFrame({"ts": [2, 9], "seq": [0, 0], "seq2": [0, 0], "price": [2.0, float("nan")], "source": ["s", "s"], "product_name": ["n", "n"]})
    row, = p.handleInputRows((1,), iter([new]), now)
    assert row["price"][0] == [2.0, 3.0] and not row["stale"][0] and h.timers == [500]
    now.at = 100
    assert list(p.handleInputRows((1,), iter([new.iloc[1:]]), now)) == [] and h.timers == [500]  # no priced point: nothing learned
    list(p.handleInputRows((1,), iter([new.iloc[:1]]), now))
    assert h.timers == [600]
    row, = p.handleExpiredTimer((1,), now, None)
    assert row["stale"][0] and len(h.state.held) == 2


def test_points_are_merged_without_pandas_work_per_product(monkeypatch):
    import pandas as pd

    from pricesift.streaming.learning import PriceHistory

    class Points:
        held = [(1, 0, 0, 5.0, "a", "p"), (4, 0, 0, 6.0, "a", "p")]

        def get(self):
            return iter(self.held)

        def put(self, points):
            self.held = points

    history = PriceHistory(3, None)
    history.points = Points()
    frames = [pd.DataFrame({"ts": [3, 9, 2, 4, 8], "seq": [0, 0, 0, 1, 0], "seq2": 0, "price": [1.0, None, 2.0, 3.0, 4.0],
                            "source": ["b", "b", None, "b", "b"], "product_name": ["p", "p", "p", "q", ""]})] * 2
    monkeypatch.setattr(pd.DataFrame, "sort_values", None)  # before: a sort and three filters by pandas per product and batch
    out = list(history.handleInputRows((7,), iter(frames[:1]), None))
    assert history.points.held == [(3, 0, 0, 1.0, "b", "p"), (4, 0, 0, 6.0, "a", "p"), (4, 1, 0, 3.0, "b", "q")]
    assert out[0]["price"][0] == [1.0, 6.0, 3.0] and out[0]["product_id"][0] == 7
    frames[1] = frames[1].assign(product_name=None)
    assert list(history.handleInputRows((7,), iter(frames[1:]), None)) == []
