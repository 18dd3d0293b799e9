"""Tables that cut lineage, written where the driver and every executor can read them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
#: Tables that this process has written and not dropped.
_written: set[str] = set()
#: Columns that with_row_key adds.
ROW_KEY = ["_row_a", "_row_b"]


def with_row_key(df: DataFrame) -> DataFrame:
    """Adds 128 bits of hash over the whole row, nulls included: rows agree on them exactly if they are equal. (Columns with
    maps, which can't be hashed, count by their JSON text.)"""
    of = lambda f: F.to_json(F.struct(F.col(f"`{f.name}`").alias("m"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
    cells = [x for f in df.schema for x in (of(f), F.col(f"`{f.name}`").isNull())]
    return df.withColumns({k: F.xxhash64(F.lit(i), *cells) for i, k in enumerate(ROW_KEY)})


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where it is unset, local sessions (tests) get a temporary folder of their own; elsewhere that is an error, because
    executors would not share it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if master not in _own:
        _own[master] = tempfile.mkdtemp(prefix="spark-scratch-")
    return _own[master]


def materialize(df: DataFrame, name: str = "scratch") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: later stages survive the loss of any executor
    without computing df again, and two readers of the result do not compute it twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.add(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop(df: DataFrame) -> None:
    """Delete the files of a table that `materialize` wrote and nothing reads any more."""
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, parent)
        _written.difference_update({p for p in _written if p.rpartition("/")[2] == parent.rpartition("/")[2]})


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, all tables that were written within it. Results that read them must be written before."""
    before = set(_written)
    try:
        yield
    finally:
        for path in _written - before:
            _delete(spark, path)
        _written.intersection_update(before)
