"""Tables under one folder that change together: immutable Parquet folders and a log of versions.

`data/` holds what was written, each write in a folder of its own. `log/00000001.json`, ... name the folders that make up
every table; a version counts once its file is there. A file is written aside and renamed to a name that must not exist,
so of two writers one wins and the other gets Conflict, and a job that dies leaves the version before as it was.

A table with a key is dealt out by the key's hash over a fixed number of buckets, so that a change reads and rewrites only
the buckets it touches. Others only grow or are replaced whole.
"""

from __future__ import annotations

import json
import time
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a table with a key, folders of one without a key before they are merged, versions that discard() keeps.
BUCKETS, FOLDERS, VERSIONS = 64, 50, 10
_BUCKET = "bucket__"


class Conflict(RuntimeError):
    """Another writer made a version meanwhile; read again and retry."""


class Tables:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _files(self, name: str) -> list:
        at = self._at(name)
        fs = at.getFileSystem(self.conf)
        return list(fs.listStatus(at)) if fs.exists(at) else []

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._files("log")]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def state(self, version: int | None = None) -> tuple[int, dict]:
        """(version, what makes up each table); version 0 has none."""
        version = version or max(self.versions(), default=0)
        if not version:
            return 0, {}
        at = self._at(f"log/{version:08d}.json")
        stream = at.getFileSystem(self.conf).open(at)
        try:
            return version, json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def has(self, *names: str) -> bool:
        held = self.state()[1]
        return all(n in held for n in names)

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """The table as its latest (or another) version has it; None if there is no such table."""
        return self._rows(self.state(version)[1].get(name))

    def _rows(self, table: dict | None, buckets=None) -> DataFrame | None:
        if table is None:
            return None
        schema = StructType.fromJson(table["schema"])
        folders = [f"{self.path}/data/{p}" for b, paths in table["parts"].items() if buckets is None or b == "" or int(b) in buckets for p in paths]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def change(self) -> Change:
        return Change(self)

    def discard(self, older_than: float = 3600) -> int:
        """Deletes versions but the last VERSIONS, and data folders that none of these names and that have stood for so many
        seconds (a change under way may still name younger ones). Gives the number of folders."""
        versions, fs, gone = self.versions(), self._at().getFileSystem(self.conf), 0
        used = {p.split("/")[0] for v in versions[-VERSIONS:] for t in self.state(v)[1].values() for paths in t["parts"].values() for p in paths}
        for v in versions[:-VERSIONS]:
            fs.delete(self._at(f"log/{v:08d}.json"), False)
        for s in self._files("data"):
            if s.getPath().getName() not in used and s.getModificationTime() / 1000 < time.time() - older_than:
                gone += bool(fs.delete(s.getPath(), True))
        return gone


class Change:
    """Writes that become one version when the with block ends; none of them if it raises."""

    def __init__(self, tables: Tables):
        self.tables = tables
        self.version, self.state = tables.state()

    def __enter__(self) -> Change:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self._commit()

    def read(self, name: str) -> DataFrame | None:
        """The table with what this change has done to it so far."""
        return self.tables._rows(self.state.get(name))

    def _write(self, name: str, rows: DataFrame, key: str | None, buckets: int) -> dict[str, list[str]]:
        folder = f"{name}-{uuid4().hex}"
        if key is None:
            rows.write.parquet(f"{self.tables.path}/data/{folder}")
            return {"": [folder]}
        rows = rows.withColumn(_BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).hint("rebalance", _BUCKET)
        rows.write.partitionBy(_BUCKET).parquet(f"{self.tables.path}/data/{folder}")
        names = [s.getPath().getName() for s in self.tables._files(f"data/{folder}")]
        return {n.partition("=")[2]: [f"{folder}/{n}"] for n in names if n.startswith(_BUCKET)}

    def _put(self, name: str, rows: DataFrame, parts: dict, key: str | None, buckets: int) -> None:
        self.state = self.state | {name: {"schema": rows.schema.jsonValue(), "parts": parts, "key": key, "buckets": buckets}}

    def replace(self, name: str, rows: DataFrame, key: str | None = None, buckets: int = BUCKETS) -> DataFrame:
        """The table is these rows from now on; gives them as they were written."""
        self._put(name, rows, self._write(name, rows, key, buckets), key, buckets)
        return self.read(name)

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows to a table without a key. Nothing else is read, but once in FOLDERS times, when all are merged."""
        held = self.state.get(name)
        parts = held["parts"].get("", []) if held else []
        if len(parts) >= FOLDERS:
            self.replace(name, self.read(name).unionByName(rows, allowMissingColumns=True))
        else:
            self._put(name, self.read(name).limit(0).unionByName(rows, allowMissingColumns=True) if held else rows, {"": parts + self._write(name, rows, None, 0)[""]}, None, 0)

    def upsert(self, name: str, rows: DataFrame, key: str, keys: DataFrame | None = None, buckets: int = BUCKETS) -> None:
        """Takes out all rows with one of `keys` (a frame with that column; those of rows if there is none) and adds rows.
        Doing it again changes nothing. Only buckets that a key falls in are read and written."""
        held = self.state.get(name)
        keys = (rows if keys is None else keys).select(key).distinct()
        if held is None:
            self.replace(name, rows, key, buckets)
            return
        if held["key"] is None:  # it is dealt out once
            rows = self.read(name).join(keys, key, "left_anti").unionByName(rows, allowMissingColumns=True)
            self.replace(name, rows, key, buckets)
            return
        if held["key"] != key:
            raise ValueError(f"table {name} has the key {held['key']}")
        buckets = held["buckets"]
        both = keys.union(rows.select(key)).select(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("b")).distinct()
        touched = {r.b for r in both.collect()}  # at most `buckets`
        old = self.tables._rows(held, touched)
        rows = old.join(keys, key, "left_anti").select(*old.columns).unionByName(rows, allowMissingColumns=True)
        parts = {b: p for b, p in held["parts"].items() if int(b) not in touched}
        self._put(name, rows, parts | self._write(name, rows, key, buckets), key, buckets)

    def _commit(self) -> None:
        t = self.tables
        fs = t._at().getFileSystem(t.conf)
        aside, after = t._at(f"log/.{uuid4().hex}"), t._at(f"log/{self.version + 1:08d}.json")
        stream = fs.create(aside, False)
        stream.write(json.dumps(self.state).encode())
        stream.close()
        context = t.jvm.org.apache.hadoop.fs.FileContext.getFileContext(after.toUri() if after.isUriPathAbsolute() and after.toUri().getScheme() else fs.getUri(), t.conf)
        never = t.spark.sparkContext._gateway.new_array(t.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(aside), fs.makeQualified(after), never)
        except Exception as e:
            fs.delete(aside, False)
            if fs.exists(after):
                raise Conflict(f"version {self.version + 1} of {t.path} was made by another writer") from e
            raise
