"""What the training-data operators share: scratch space, lineage cuts, Arrow batches, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import BATCH_BYTES, runs, small_batches
from ..sources.scratch import discard_scratch, scratch, shared_dir, tidied, written

__all__ = ["BATCH_BYTES", "discard_scratch", "runs", "scratch", "shared_dir", "small_batches", "tidied", "written"]

#: Rows that one step of a Python operator holds at once, next to BATCH_BYTES of text.
BATCH_ROWS = 1024


def map_rows(df: DataFrame, make: Callable[[], Callable[[list[list]], list[list]]], schema: str) -> DataFrame:
    """mapInArrow in slices of at most BATCH_ROWS rows and about BATCH_BYTES of strings.

    make runs once a task and gives the function from columns (lists) to columns (lists).
    """
    fields = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for columns in slices(batches):
            out = step(columns)
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(out, fields, strict=True)], schema=fields)

    return small_batches(df).mapInArrow(run, schema)


def slices(batches: Iterable[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[list[list]]:
    """The columns as lists, of at most BATCH_ROWS rows and about `most` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = 0
        while at < batch.num_rows:
            rows = min(BATCH_ROWS, batch.num_rows - at)
            part = batch.slice(at, rows)
            while rows > 1 and part.nbytes > most:
                rows = max(1, rows // 2)
                part = batch.slice(at, rows)
            yield [c.to_pylist() for c in part.columns]
            at += rows


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl), timestamp_utc=True)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads 64-bit values evenly."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class WordHashes:
    """64-bit hashes of words (bytes), kept for words seen lately."""

    def __init__(self, most: int = 200_000):
        import xxhash

        self.hash, self.seen, self.most = xxhash.xxh3_64_intdigest, {}, most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        seen, new = self.seen, self.hash
        if len(seen) > self.most:
            seen.clear()
        out = np.empty(len(words), np.uint64)
        try:
            out[:] = [seen[w] for w in words]
        except KeyError:
            for w in words:
                if w not in seen:
                    seen[w] = new(w)
            out[:] = [seen[w] for w in words]
        return out


def rolling(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash for each run of k consecutive word hashes: a polynomial, built up from runs of powers of two."""
    n, base = len(words) - k + 1, (0x9E3779B97F4A7C15 + 2 * seed) % (1 << 64)
    if n <= 0 or k <= 0:
        return np.empty(0, np.uint64)
    power, size, out, done = words.astype(np.uint64), 1, None, 0
    while True:
        if k & size:
            part = power[done : done + n]
            out = part.copy() if out is None else out * np.uint64(pow(base, size, 1 << 64)) + part
            done += size
        if 2 * size > k:
            break
        power = power[:-size] * np.uint64(pow(base, size, 1 << 64)) + power[size:]
        size *= 2
    return mix64(out + np.uint64(seed))


def components(edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """(node, component) of the undirected edges (u, v); component is the smallest node reachable.

    Alternates large-star and small-star steps. Every step keeps at most as many edges as it got, aggregates
    before it shuffles, and is written to the shared folder. Nodes without edges don't appear. Null ends are dropped.
    """
    spark = edges.sparkSession
    now = written(edges.where("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct(), f"{name}-edges")
    for _ in range(rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The minima are written so that both sides of each join are plain shuffles, which Spark can split at hubs.
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-low")
        large = written(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{name}-large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-low")
        ends = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        after = written(large.join(low, "u").select(ends.alias("e")).select("e.u", "e.v").where("u <> v").distinct(), f"{name}-stars")
        sums = [x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (now, after)]
        now = after
        if sums[0] == sums[1]:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def qualified(spark: SparkSession, path: str) -> str:
    """path with its file system, as pyarrow.fs.FileSystem.from_uri takes it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


class Files:
    """Files in the shared folder, opened from executors through the file system of their URI."""

    def __init__(self, folder: str):
        from pyarrow.fs import FileSystem

        self.fs, self.root = FileSystem.from_uri(folder)
        self.folder = folder

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def create(self, name: str):
        self.fs.create_dir(self.root, recursive=True)
        return self.fs.open_output_stream(self.path(name), compression=None)

    def open(self, name: str):
        return self.fs.open_input_file(self.path(name))


def attempt_name(kind: str) -> str:
    """A file name that no other attempt of the task uses, so that retries and speculation never share a file."""
    return f"{kind}-{uuid.uuid4().hex}"
