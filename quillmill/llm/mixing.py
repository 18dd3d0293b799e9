"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Every source gets a share of all words by its weight, but at most `max_epochs` times its own words; what a clamped
source leaves goes to the others by weight, until none is above its limit. A source whose target is r times its size
is taken floor(r) times whole, and documents in seeded hash order give the fraction that is left.

Defined results: a null text has size 0; rows with a null source form a source of their own, last in the order;
repeated rows are separate documents; ids may be null (the
text then gives the place in the order) or shared by documents; of equal places the given order decides, and reruns agree;
texts are measured whole; columns other than doc_id, text, source and `carry` are not read; an empty table gives an empty
result; sources without words get target 0.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.plans.prefix import range_offsets
from quillmill.plans.scratch import ROW_KEY, materialize, with_row_key

WORD = r"[^\x20\x09-\x0D]+"
#: Documents in one bucket of the hash order, about; only a source's last, split bucket is ordered row by row.
BUCKET = 2_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycle_weights(cycle: list[float]) -> Callable[[Column], Column]:
    """Weight of the source at position i (from 0): the cycle's values in turn."""
    return lambda i: F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (i % len(cycle)).cast("int") + 1)


def targets(sizes: DataFrame, weight: Callable[[Column], Column], max_epochs: float = 3.0, share: float = 1.0) -> DataFrame:
    """sizes: (source, source_size, docs), one row for each source. Adds weight and target.

    Water level: the sum of min(max_epochs * size, level * weight) is `share` of all words. Each round clamps the
    sources that the level floods and raises it for the rest; two sums a round reach the driver.
    """
    ranked = range_offsets(sizes.withColumn("_last", F.col("source").isNull()), ["_last", "source"], F.lit(1).cast("long"), "position").drop("_last")
    table = materialize(ranked.withColumn("weight", weight(F.col("position"))), "weights")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    limit, level = F.col("source_size") * max_epochs, 0.0
    while True:
        free = limit > F.col("weight") * level
        clamped, weights = table.agg(F.sum(F.when(~free, limit).otherwise(0.0)), F.sum(F.when(free, F.col("weight")).otherwise(0.0))).first()
        if not weights:
            break
        higher = (total * share - clamped) / weights
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    return table.withColumn("target", F.least(limit, F.col("weight") * level))


def _whole(target: Column, size: Column) -> Column:
    return F.when(size > 0, F.floor(target / size)).otherwise(0).cast("long")


def _take(sizes: list[int], goal: float, extra: list[int], at: list[int]) -> float:
    """Mark, in the order of `at`, each document that still fits into goal, and one more if that comes nearer."""
    left, over = goal, None
    for i in at:
        if sizes[i] <= left:
            extra[i], left = 1, left - sizes[i]
        elif over is None or sizes[i] < sizes[over]:
            over = i
    if over is not None and sizes[over] - left < left:
        extra[over], left = 1, left - sizes[over]
    return goal - left


def _fill(rows: pa.Table) -> pa.Table:
    """Documents in hash order until what the source lacks is filled: first the share of the long ones, whose sizes
    leave gaps, then the others."""
    rows = rows.sort_by([(c, "ascending") for c in ("_h", "doc_id", "size", *ROW_KEY) if c in rows.column_names])
    sizes, goal, extra = rows["size"].to_pylist(), float(rows["_left"][0].as_py()), [0] * len(rows)
    long = [i for i, n in enumerate(sizes) if 50 * n > goal]
    got = _take(sizes, goal * sum(sizes[i] for i in long) / max(1, sum(sizes)), extra, long)
    _take(sizes, goal - got, extra, [i for i, n in enumerate(sizes) if 50 * n <= goal])
    return rows.append_column("extra", pa.array(extra, pa.int64()))


def mix(docs: DataFrame, weight: Callable[[Column], Column], max_epochs: float = 3.0, share: float = 1.0, seed: int = 42, carry: list[str] = []) -> DataFrame:
    """doc_id, source, size, source_size, target, times (repetitions of the document), taken (= times * size) and `carry`.

    No task holds a whole source: the hash order is cut into buckets whose sums tell which are taken whole; only the
    bucket in which a source's fraction ends, of about BUCKET documents whatever the source's size, is walked through.
    """
    h = F.xxhash64(F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.col("text")), F.lit(seed))  # nulls leave a hash as it is
    slim = materialize(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), h.alias("_h"), *carry), "mix")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    goal = materialize(targets(sizes, weight, max_epochs, share), "targets")
    goal = goal.withColumn("whole", _whole(F.col("target"), F.col("source_size")))
    goal = goal.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    goal = goal.withColumn("buckets", F.ceil(F.col("docs") / BUCKET)).select("source", "source_size", "target", "whole", "rest", "buckets").alias("g")
    rows = slim.alias("s").join(goal, F.col("s.source").eqNullSafe(F.col("g.source"))).drop(F.col("g.source"))
    rows = materialize(rows.withColumn("bucket", F.pmod("_h", "buckets")), "mix-rows")

    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("v"), F.first("rest").alias("rest"))
    # one row for each source and bucket: a source with B buckets has its B rows in order in one window
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    upto = sums.withColumn("upto", F.sum("v").over(w))
    fate = upto.select(
        F.col("source").alias("f_source"), F.col("bucket").alias("f_bucket"), (F.col("rest") - F.col("upto") + F.col("v")).alias("_left"),
        F.when(F.col("upto") <= F.col("rest"), 1).when(F.col("upto") - F.col("v") < F.col("rest"), None).otherwise(0).cast("long").alias("extra"),
    )
    fate = materialize(fate, "mix-buckets")
    marked = rows.join(fate, F.col("source").eqNullSafe(F.col("f_source")) & (F.col("bucket") == F.col("f_bucket"))).drop("f_source", "f_bucket")
    split = marked.where("extra is null").drop("extra")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in split.schema)
    filled = split.groupBy("source").applyInArrow(_fill, f"{fields}, extra long")
    out = marked.where("extra is not null").unionByName(filled)
    times = F.col("whole") + F.col("extra")
    return out.select("doc_id", "source", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"), *carry)


def repeat_documents(docs: DataFrame, weight: Callable[[Column], Column], **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; documents that it leaves out go. Ids need not be unique."""
    keyed = with_row_key(docs)
    taken = mix(keyed, weight, carry=ROW_KEY, **options).where("times > 0").groupBy(*ROW_KEY).agg(F.sum("times").alias("_times"))
    # equal rows share a key: one of them takes the repetitions of all
    first = keyed.withColumn("_twin", F.row_number().over(Window.partitionBy(*ROW_KEY).orderBy(ROW_KEY[0]))).where("_twin = 1")
    rows = first.join(materialize(taken, "mix-times").hint("merge"), ROW_KEY)
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select(*docs.columns)


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, cycle_weights([5, 2, 1])).select("doc_id", "size", "source_size", "target", "taken")
