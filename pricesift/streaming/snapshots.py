"""Versioned tables with an atomically published manifest (M2).

A version is a set of written tables and one manifest, ``manifest-<number>.json``, that
names them. Readers take the manifest with the highest number; a writer writes its tables
into new folders first and publishes the manifest last, by a rename that fails if the
number is taken. So a reader never sees half a version, a run that is killed leaves the
old version readable, and of two writers that started from one version the second is told.
``clean`` removes folders that none of the newest versions names.

All paths go through Hadoop's file system, so a local mount and an object store both work.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class ConcurrentCommit(RuntimeError):
    """Another writer has published the version that this one was to become."""


class SnapshotStore:
    """Versions of named tables under ``base``."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.base).getFileSystem(self._conf)
        self._fs.mkdirs(self._path(self.base))

    def _names(self, prefix: str) -> list[str]:
        return [f.getPath().getName() for f in self._fs.listStatus(self._path(self.base)) if f.getPath().getName().startswith(prefix)]

    def versions(self) -> list[int]:
        return sorted(int(n.removeprefix("manifest-").removesuffix(".json")) for n in self._names("manifest-"))

    def manifest(self, version: int | None = None) -> dict | None:
        """The manifest of a version, by default the current one."""
        known = self.versions()
        if not known:
            return None
        lines = self.spark.read.option("wholetext", True).text(f"{self.base}/manifest-{known[-1] if version is None else version:010d}.json")
        return json.loads(lines.first()[0])

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """A table of a version, by default the current one; None if there is none."""
        about = (self.manifest(version) or {}).get("tables", {}).get(table)
        if about is None:
            return None
        return self.spark.read.schema(T.StructType.fromJson(about["schema"])).parquet(f"{self.base}/{about['folder']}")

    def new_folder(self, name: str) -> str:
        """A folder that no version names yet."""
        return f"{self.base}/{name}-{uuid.uuid4().hex}"

    def commit(self, tables: Mapping[str, DataFrame], after: int | None) -> int:
        """Write ``tables`` and publish them as the version that follows ``after`` (None: the first)."""
        written = {}
        for name, df in tables.items():
            folder = self.new_folder(f"data-{name}")
            df.write.parquet(folder)
            written[name] = {"folder": folder.rsplit("/", 1)[-1], "schema": df.schema.jsonValue()}
        number = 0 if after is None else after + 1
        draft, final = self._path(self.new_folder("draft")), self._path(f"{self.base}/manifest-{number:010d}.json")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps({"version": number, "tables": written}).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf)
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        to = self.spark.sparkContext._gateway.new_array(rename, 1)
        to[0] = rename.NONE  # fails if the number is taken
        try:
            context.rename(draft, final, to)
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(final):
                raise ConcurrentCommit(f"version {number} has been published by another writer") from e
            raise
        return number

    def clean(self, keep: int = 2) -> list[str]:
        """Remove the manifests before the newest ``keep`` and the folders that no remaining one names."""
        for old in self.versions()[:-keep]:
            self._fs.delete(self._path(f"{self.base}/manifest-{old:010d}.json"), False)
        named = {t["folder"] for v in self.versions() for t in self.manifest(v)["tables"].values()}
        gone = [n for n in self._names("") if n.split("-")[0] in ("data", "draft", "log") and n not in named]
        for name in gone:
            self._fs.delete(self._path(f"{self.base}/{name}"), True)
        return gone
