import base64
import hashlib
import json
import zlib

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from pricesift.llm import warc

SCHEMA = "page_id long, url string, html string, archive string, record string, sha string, refers_to string"
ROWS = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2 b\n", "<p>x</p>"), (3, None, "<p>x</p>"), (3, "http://a/3", "<p>x</p>"),
        (4, "http://a/4", None), (5, "http://a/5", ""), (None, "http://a/n", "<p>x</p>"), (None, "http://a/m", "only null"),
        (6, "http://a/6", "é\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 3), (7, "u", "y" * 300_000), (8, "u", "solo")]


def pages(spark):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in ROWS], SCHEMA).repartition(3)


def want():
    best = {}
    for i, _, h in ROWS:
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    out = []
    for i, _, h in ROWS:
        raw = (h or "").encode()
        to = best.get(h or "")
        revisit = to is not None and (i is None or i < to)
        out.append((i or -1, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", (to if revisit else None) or -1))
    return sorted(out)


def shape(df):
    return sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in df.collect())


def test_round_trip_of_odd_pages(spark):
    assert shape(warc.round_trip(pages(spark))) == want()
    assert warc.round_trip(pages(spark).limit(0)).count() == 0


def test_monolithic_files_become_single_members_with_an_index(spark):
    folder = warc.new_folder(spark)
    mono = warc.write_monolithic(pages(spark), folder, archive_bytes=1000)
    normal = warc.normalise(mono, folder)
    store, _ = fs.FileSystem.from_uri(folder)
    assert mono.agg(F.sum("records")).first()[0] == normal.agg(F.sum("records")).first()[0] == len(ROWS) and mono.count() > 3
    for archive, records in mono.collect():
        raw = store.open_input_stream(archive, compression=None).read()
        gz = zlib.decompressobj(31)
        gz.decompress(raw)
        assert gz.eof and not gz.unused_data  # one member over the whole file
        assert len(list(warc.split_records(warc.inflated(store.open_input_stream(archive, compression=None))))) == records
    for archive, records in normal.collect():
        raw = store.open_input_stream(archive, compression=None).read()
        index = [json.loads(x) for x in store.open_input_stream(f"{archive}.idx", compression=None).read().splitlines()]
        assert [e["record"] for e in index] == list(range(records))
        assert sum(e["length"] for e in index) == len(raw)
        for e in index:
            headers, _ = warc.parse(zlib.decompress(raw[e["offset"]:e["offset"] + e["length"]], 31))
            assert headers["warc-type"] in ("response", "revisit")
    assert shape(warc.read_records(normal, folder)) == want()


def test_concatenated_members_and_broken_archives():
    raws = [warc.page_record(i, "u", "body" * i, None, "2024-01-01T00:00:00Z") for i in range(4)]
    gz = lambda b: (c := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(b) + c.flush()

    class Stream:
        def __init__(self, data):
            self.data, self.at = data, 0

        def read(self, n):
            self.at += 7
            return self.data[self.at - 7:self.at]

    assert list(warc.split_records(warc.inflated(Stream(gz(raws[0] + raws[1]) + gz(raws[2] + raws[3]))))) == raws
    with pytest.raises(ValueError):
        list(warc.split_records(iter([raws[0][:-10]])))


def test_a_cut_archive_raises():
    import io
    raws = [warc.page_record(i, f"http://a/{i}", f"<p>{i}</p>" * 50, None, "2024-01-01T00:00:00Z") for i in range(8)]
    gz, cuts, data = zlib.compressobj(6, zlib.DEFLATED, 31), [], b""
    for raw in raws:
        data += gz.compress(raw) + gz.flush(zlib.Z_FULL_FLUSH)
        cuts.append(len(data))
    data += gz.flush()
    read = lambda x: list(warc.split_records(warc.inflated(io.BytesIO(x))))
    assert read(data) == raws and read(data + bytes(700)) == raws and read(data + data) == raws * 2
    for end in (cuts[2], cuts[7], len(data) - 1, len(data) - 8, cuts[3] + 5):
        with pytest.raises((ValueError, zlib.error)):
            read(data[:end])


def test_inflation_holds_a_bounded_part():
    import io
    import tracemalloc
    raw = warc.page_record(1, "u", "x" * 4_000_000, None, "2024-01-01T00:00:00Z")
    data = zlib.compress(raw * 60, 9, 31)
    assert len(raw) * 60 > 500 * len(data)
    tracemalloc.start()
    assert sum(1 for _ in warc.split_records(warc.inflated(io.BytesIO(data)))) == 60
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20


def test_one_hot_payload(spark):
    hot = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("p"), F.col("id").cast("string"))).alias("html"))
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(hot).collect()}
    assert all(got[i] == (("response", None) if i % 3 == 0 or i == 2999 else ("revisit", 2999)) for i in range(3000))
