"""WARC archives: writing, normalising monolithic gzip files, reading back by index.

``write_monolithic`` lets each task write its pages as WARC records into archives of
about ``archive_bytes``, each one gzip stream over the whole file, as many crawlers
leave them: nothing in them can be read without inflating all that comes before.
``normalise`` inflates such a file once, in a stream, rewrites every record as its own
gzip member and writes a sidecar index (record, offset, length) beside it. From then on
``read_records`` fetches single records by offset. Memory per task is one record.

Of pages with equal payloads the one with the largest ``page_id`` is stored as a
``response``, the others as ``revisit`` records that name it. Equal payloads are found
by SHA-256 with map-side combination.

Files go to a folder under the shared checkpoint folder through ``pyarrow.fs``, so a
local mount or an object store both work. Their names hold the task attempt: a task
that is run again writes other files, and only files named in the task's result, the
manifest, are ever read, so lost executors and speculative attempts do no harm.

Defined cases: null html is an empty payload, deduplicated like any other; a null
url is left out; a null ``page_id`` is left out and never preferred as the response
(if all ids are null, all are responses); repeated rows that carry the largest id
are all responses; an empty table gives no archive and no rows; other columns are
ignored. A record whose payload does not match its digest raises.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, write_shared

CRLF, GZIP, CHUNK, INPUT = b"\r\n", 31, 1 << 20, 1 << 16
MIN_REVISIT_BYTES = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in headers), b"Content-Length: %d" % len(block)]
    return CRLF.join(lines) + CRLF * 2 + block + CRLF * 2


def page_record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, written: str) -> bytes:
    payload = (html or "").encode("utf-8", "surrogatepass")
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"),
               ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", written),
               ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"), ("X-Payload-Length", str(len(payload))),
               ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        headers.append(("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)))
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-ID", str(refers_to))]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    return record(headers, http + (payload if refers_to is None else b""))


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(CRLF * 2)
    lines = head.split(CRLF)
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines[1:])}
    return headers, rest[:int(headers["content-length"])]


def inflated(stream) -> Iterator[bytes]:
    """The content of a gzip file of any number of members, in parts of ``CHUNK`` at most, however well it is compressed.

    A file that ends inside a member raises; zeros after a member are padding.
    """
    gz = None
    while part := stream.read(INPUT):  # what is left of it is copied for every part inflated
        while part:
            if gz is None:
                part = part.lstrip(b"\0")
                if not part:
                    break
                gz = zlib.decompressobj(GZIP)
            yield gz.decompress(part, CHUNK)
            while gz.unconsumed_tail:
                yield gz.decompress(gz.unconsumed_tail, CHUNK)
            part = gz.unused_data
            if gz.eof:
                gz = None
    if gz is not None:
        while rest := gz.decompress(gz.unconsumed_tail, CHUNK):
            yield rest
        if not gz.eof:
            raise ValueError("an archive ends inside a gzip member")


def split_records(parts: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records out of a stream of parts; holds one record and one part at a time."""
    held, need = bytearray(), 0
    for part in parts:
        held += part
        while len(held) >= max(need, 1):
            if not need:
                end = held.find(CRLF * 2)
                if end < 0:
                    break
                size = next(int(x.partition(b":")[2]) for x in bytes(held[:end]).split(CRLF)
                            if x.lower().startswith(b"content-length:"))
                need = end + 4 + size + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held.strip():
        raise ValueError("an archive ends inside a record")


def _manifest(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()),
                                       pa.array([r[1] for r in rows], pa.int64())], names=["archive", "records"])


def with_targets(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, refers_to): which stored page a page's payload repeats, if any.

    The digests are counted from a written table of their own, so the join's sides are two
    plain tables: a payload that a third of all pages share is split by Spark.
    """
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("sha"))
    digests = write_shared(keyed.where(F.octet_length("html") >= MIN_REVISIT_BYTES).select("sha", "page_id"), "payload-digests")
    stored = (digests.groupBy("sha").agg(F.max("page_id").alias("stored"), F.count("*").alias("n")).where("n > 1").drop("n"))
    stored = write_shared(stored, "stored-payloads")
    return (keyed.join(stored, "sha", "left")
            .select("page_id", "url", "html",
                    F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("stored")), F.col("stored")).alias("refers_to")))


def write_monolithic(pages: DataFrame, folder: str, archive_bytes: int = 64 << 20) -> DataFrame:
    """Write every page as a WARC record; the written manifest (archive, records)."""
    written = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        task, made, out, gz, size, n = TaskContext.get(), 0, None, None, 0, 0
        name = ""
        for batch in batches:
            for page in batch.to_pylist():
                raw = page_record(page["page_id"], page["url"], page["html"], page["refers_to"], written)
                if out is None:
                    name = f"{base}/mono-{task.partitionId():06d}-{task.taskAttemptId()}-{made}.warc.gz"
                    out, gz, size, n = store.open_output_stream(name, compression=None), zlib.compressobj(6, zlib.DEFLATED, GZIP), 0, 0
                out.write(gz.compress(raw))
                size, n = size + len(raw), n + 1
                if size >= archive_bytes:
                    out.write(gz.flush())
                    out.close()
                    yield _manifest([(name, n)])
                    out, made = None, made + 1
        if out is not None:
            out.write(gz.flush())
            out.close()
            yield _manifest([(name, n)])

    return write_shared(with_targets(pages).mapInArrow(rows, "archive string, records long"), "warc-manifest")


def _spread(manifest: DataFrame) -> DataFrame:
    """One archive a task as far as possible: the rows are tiny, the work behind them is not."""
    return manifest.repartition(max(1, min(manifest.count(), 10_000)))


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive with one gzip member per record and a sidecar index; the new manifest."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        for batch in batches:
            for i, source in enumerate(batch.column(0).to_pylist()):
                name = f"{base}/norm-{task.partitionId():06d}-{task.taskAttemptId()}-{i}-{uuid.uuid4().hex[:8]}.warc.gz"
                offset = n = 0
                with (store.open_input_stream(source, compression=None) as stream,
                      store.open_output_stream(name, compression=None) as out,
                      store.open_output_stream(f"{name}.idx", compression=None) as index):
                    for raw in split_records(inflated(stream)):
                        gz = zlib.compressobj(6, zlib.DEFLATED, GZIP)
                        member = gz.compress(raw) + gz.flush()
                        out.write(member)
                        index.write(json.dumps({"record": n, "offset": offset, "length": len(member)}).encode() + b"\n")
                        offset, n = offset + len(member), n + 1
                yield _manifest([(name, n)])

    return write_shared(_spread(manifest.select("archive", "records")).mapInArrow(rows, "archive string, records long"), "warc-normal")


RECORD = ("archive string, record long, offset long, length long, page_id long, url string, record_type string, "
          "payload_bytes long, payload_digest string, refers_to long")


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of normalised archives, each fetched by its index entry."""
    def one(store, archive: str, file, entry: dict) -> dict:
        file.seek(entry["offset"])
        headers, block = parse(zlib.decompress(file.read(entry["length"]), GZIP))
        number = lambda k: int(headers[k]) if k in headers else None
        digest, size = headers["warc-payload-digest"].removeprefix("sha1:"), number("x-payload-length")
        if headers["warc-type"] == "response":
            payload = block.partition(CRLF * 2)[2]
            if payload_digest(payload) != digest or len(payload) != size:
                raise ValueError(f"record {entry['record']} of {archive} does not match its digest")
        return {"archive": archive, **entry, "page_id": number("x-page-id"), "url": headers.get("warc-target-uri"),
                "record_type": headers["warc-type"], "payload_bytes": size, "payload_digest": digest,
                "refers_to": number("x-refers-to-page-id")}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        schema = pa.schema([(f.split()[0], pa.string() if f.split()[1] == "string" else pa.int64()) for f in RECORD.split(", ")])
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                held = []
                with store.open_input_stream(f"{archive}.idx", compression=None) as index, store.open_input_file(archive) as file:
                    for line in _lines(index):
                        held.append(one(store, archive, file, json.loads(line)))
                        if len(held) >= 5000:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return _spread(manifest.select("archive", "records")).mapInArrow(rows, RECORD)


def _lines(stream) -> Iterator[bytes]:
    rest = b""
    while part := stream.read(CHUNK):
        *whole, rest = (rest + part).split(b"\n")
        yield from whole


def new_folder(spark) -> str:
    """A new folder for archives under the shared folder."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    store, base = fs.FileSystem.from_uri(path)
    store.create_dir(base)
    return path


def round_trip(pages: DataFrame) -> DataFrame:
    """Write, normalise and read back all pages."""
    folder = new_folder(pages.sparkSession)
    return read_records(normalise(write_monolithic(pages, folder), folder), folder)
