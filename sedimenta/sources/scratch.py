"""Tables that cut a plan's lineage, in a folder that driver and executors share."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the session's checkpoint folder, else a folder in its warehouse; all shared on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/") if held.isDefined() else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def discard_scratch(spark: SparkSession) -> int:
    """Deletes what this application's plans have left in the shared folder; gives the number of paths. For when results
    are saved elsewhere: frames that were returned read these tables."""
    made = _MADE.get(spark.sparkContext.applicationId, [])
    gone = 0
    while made:
        gone += _delete(spark, made.pop())
    return gone


def tidied(make):
    """Decorates a function that gives a frame: once it is made, the scratch tables behind it that the frame doesn't read
    are deleted. Not for frames whose Python code reads scratch files by path."""

    @functools.wraps(make)
    def run(*args, **kwargs) -> DataFrame:
        before = {p for paths in _MADE.values() for p in paths}
        out = make(*args, **kwargs)
        spark, read = out.sparkSession, {part for f in out.inputFiles() for part in f.split("/")[-3:]}
        made = _MADE.get(spark.sparkContext.applicationId, [])
        for path in [p for p in made if p not in before and p.rsplit("/", 1)[-1] not in read]:
            made.remove(path)
            _delete(spark, path)
        return out

    return run


def _delete(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True))


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it again."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
