import os

from pyspark.sql import functions as F
from sedimenta.sources import scratch


def test_folder_and_discard(spark):
    held = scratch.written(spark.range(3), "test-scratch")
    assert held.count() == 3 and scratch.scratch(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert scratch.discard_scratch(spark) > 0 and scratch.discard_scratch(spark) == 0


def test_a_shared_folder_without_settings(spark, monkeypatch):
    class Unset:
        conf = type("C", (), {"get": staticmethod(lambda name, *other: "hdfs://n/warehouse/" if name == "spark.sql.warehouse.dir" else None)})
        sparkContext = spark.sparkContext

    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    assert scratch.shared_dir(Unset) == (held.get() if held.isDefined() else "hdfs://n/warehouse/_scratch")


def test_what_a_result_does_not_read_goes(spark):
    paths = {}

    def put(n):
        out = scratch.written(spark.range(n), f"tidy{n}")
        paths[n] = scratch._MADE[spark.sparkContext.applicationId][-1].removeprefix("file://")
        return out

    @scratch.tidied
    def inner():
        put(2)
        return put(3).union(put(4))

    @scratch.tidied
    def outer(first):
        out = inner().join(first, "id", "left").withColumn("n", F.lit(1))
        put(5)
        return out

    first = put(1)
    out = outer(first)
    assert {n for n, p in paths.items() if os.path.isdir(p)} == {1, 3, 4} and out.count() == 7
    scratch.discard_scratch(spark)
    assert not any(map(os.path.isdir, paths.values()))
