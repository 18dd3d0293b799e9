import os

from pyspark.sql import functions as F

from quillmill.plans import scratch


def test_scope_and_drop(spark):
    place = lambda d: d.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    kept = scratch.materialize(spark.range(3))
    with scratch.scope(spark):
        inner = scratch.materialize(spark.range(4))
        at = place(inner)
        assert inner.count() == 4
    assert not os.path.exists(at) and kept.count() == 3
    at = place(kept)
    scratch.drop(kept)
    assert not os.path.exists(at)


def test_row_keys_see_maps(spark):
    df = spark.range(4).select("id", F.create_map(F.lit("a"), F.col("id") % 2).alias("m"), F.struct(F.create_map(F.lit("b"), F.lit(1)).alias("n")).alias("s")).drop("id")
    assert scratch.with_row_key(df).select(*scratch.ROW_KEY).distinct().count() == 2
