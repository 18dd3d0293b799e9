"""Correlations of wide tables: hundreds of columns in one pass over the rows.

A task keeps, for every pair of columns, the count of the rows that have both, the means, and the sums of squares and
products about them. Batches are added to these by the rule for moments of two samples, so nothing is squared before it
is centred. A task gives one row for each column, with arrays over the columns after it; these rows are merged by the same
rule, first those of up to FAN tasks, then all of a column. Plans don't grow with the columns, and no task holds more
than columns x columns numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.plans.prefix import range_offsets
from quillmill.plans.scratch import materialize
from quillmill.plans.skew import join_counted

#: Tasks whose sums are merged at once.
FAN = 64
#: Rows of a batch that are multiplied together.
ROWS = 4096
PAIRS = ["n", "ma", "mb", "va", "vb", "c"]


def packed(df: DataFrame, values: list[str], *keep: str) -> DataFrame:
    """The columns of `keep`, and `x`: the values as an array of doubles."""
    return df.select(*keep, F.array(*[F.col(v).cast("double") for v in values]).alias("x"))


def as_matrix(column: pa.Array, p: int) -> np.ndarray:
    """Arrays of p doubles each as rows; nulls are nan."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), p)


def _moments(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """(count, mean, squares, products) of every pair (i, j): mean and squares are i's, over the rows that have j, too."""
    some = ~np.isnan(x)
    seen = some.any(axis=0)
    low, high = np.min(x, axis=0, where=some, initial=np.inf), np.max(x, axis=0, where=some, initial=-np.inf)
    count = some.sum(axis=0)
    z = np.where(some, x, 0.0)
    centre = np.where(seen, np.where(low == high, low, z.sum(axis=0) / np.maximum(count, 1)), 0.0)
    z = np.where(some, x - centre, 0.0)
    if some.all():
        n = np.full((x.shape[1],) * 2, float(len(x)))
        s, q = (np.repeat(v[:, None], x.shape[1], axis=1) for v in (z.sum(axis=0), (z * z).sum(axis=0)))
    else:
        m = some.astype(float)
        n, s, q = m.T @ m, z.T @ m, (z * z).T @ m
    at = np.maximum(n, 1)
    squares = q - s * s / at
    squares[squares <= 1e-13 * q] = 0.0  # what rounding leaves of a constant
    return n, centre[:, None] + s / at, squares, z.T @ z - s * s.T / at


def _merge(a: tuple, b: tuple) -> tuple:
    """Both as (count, mean of i, mean of j, squares of i, squares of j, products)."""
    n = a[0] + b[0]
    w = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    di, dj = b[1] - a[1], b[2] - a[2]
    both = a[0] * w
    return n, a[1] + di * w, a[2] + dj * w, a[3] + b[3] + di * di * both, a[4] + b[4] + dj * dj * both, a[5] + b[5] + di * dj * both


def pair_moments(rows: DataFrame, p: int) -> DataFrame:
    """rows (x: array of p doubles; null and nan are missing) → i, and arrays over j = i, i + 1, ..., p - 1: n (rows that have
    both), ma and mb (means), va and vb (squares about them), c (products). One row for each i; none for an empty table."""
    names = ", ".join(f"{v} array<double>" for v in PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums = None
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                n, mean, squares, products = _moments(as_matrix(b.column(0).slice(at, ROWS), p))
                own = (n, mean, mean.T, squares, squares.T, products)
                sums = own if sums is None else _merge(sums, own)
        if sums is not None:
            fan = TaskContext.get().partitionId() // FAN
            arrays = [pa.array([v[i, i:] for i in range(p)], pa.list_(pa.float64())) for v in sums]
            yield pa.record_batch([pa.array(np.arange(p, dtype=np.int32)), pa.array(np.full(p, fan, np.int32)), *arrays], names=["i", "fan", *PAIRS])

    def merge(d: pd.DataFrame) -> pd.DataFrame:
        sums = None
        for row in d[PAIRS].itertuples(index=False):
            own = tuple(np.asarray(v, float) for v in row)
            sums = own if sums is None else _merge(sums, own)
        return pd.DataFrame([(d["i"].iloc[0], *sums)], columns=["i", *PAIRS])

    tasks = max(1024, 4 * rows.sparkSession.sparkContext.defaultParallelism)  # sums are a row a task, so tasks are bounded
    parts = rows.select("x").coalesce(tasks).mapInArrow(run, f"i int, fan int, {names}")
    parts = parts.groupBy("fan", "i").applyInPandas(merge, f"i int, {names}")
    return parts.groupBy("i").applyInPandas(merge, f"i int, {names}")


def _coefficients(moments: DataFrame, values: list[str]) -> DataFrame:
    """(x, y, n, r) of all pairs; r is null where a column doesn't vary over the rows that have both."""
    name = lambda at: F.element_at(F.array(*map(F.lit, values)), at)
    cells = moments.select("i", F.posexplode(F.arrays_zip("n", "va", "vb", "c")).alias("k", "m")).where("k > 0")
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("m.c") / F.sqrt(F.col("m.va")) / F.sqrt(F.col("m.vb"))))
    r = F.when((F.col("m.va") > 0) & (F.col("m.vb") > 0), r)
    return cells.select(name(F.col("i") + 1).alias("x"), name(F.col("i") + F.col("k") + 1).alias("y"), F.col("m.n").cast("long").alias("n"), r.alias("r"))


def pearson(df: DataFrame, values: list[str]) -> DataFrame:
    """(x, y, n, r) for all pairs of columns, x before y in `values`, over the rows that have both (nan is missing)."""
    return _coefficients(pair_moments(packed(df, values), len(values)), values)


def ranks(df: DataFrame, values: list[str]) -> DataFrame:
    """x: for each row that has all values, the array of their average ranks among such rows.

    All cells of the table are counted by column and value and dealt out by one range sort; ranks are prefix sums of the
    counts. They get back to the rows by a join on column and value in which frequent values (zeros, above all) are
    broadcast.
    """
    whole = packed(df, values).where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    rows = materialize(whole.withColumn("row", F.monotonically_increasing_id()), "rank-rows")  # written once, so that a row keeps its number
    cells = rows.select("row", F.posexplode("x").alias("at", "v"))
    counts = cells.groupBy("at", "v").agg(F.count("*").alias("c"))
    before = range_offsets(counts, ["at", "v"], F.col("c"), "before")
    first = before.groupBy("at").agg(F.min("before").alias("first"))  # a row for each column
    table = before.join(F.broadcast(first), "at").select("at", "v", "c", (F.col("before") - F.col("first") + (F.col("c") + 1) / 2.0).alias("rank"))
    told = join_counted(cells, materialize(table, "ranks"), ["at", "v"], "c")
    wide = told.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "rank"))).alias("cells"))
    return wide.select(F.transform("cells", lambda c: c["rank"]).alias("x"))


def spearman_all(df: DataFrame, values: list[str]) -> DataFrame:
    """(x, y, n, r): rank correlations of all pairs of columns, over the rows that have all values."""
    return _coefficients(pair_moments(ranks(df, values), len(values)), values)


def square(df: DataFrame, values: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(count, means, products about the means) of the rows that have all values; only these reach the driver."""
    p = len(values)
    whole = packed(df, values).where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    n, mean, products = 0, np.zeros(p), np.zeros((p, p))
    for r in pair_moments(whole, p).select("i", "n", "ma", "c").collect():  # p rows
        n, mean[r.i] = int(r.n[0]), r.ma[0]
        products[r.i, r.i :] = products[r.i :, r.i] = r.c
    return n, mean, products


def summed(rows: DataFrame, p: int, products: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """rows (x: array of p doubles) → the sum over all rows of `products`, which makes a matrix of a few rows; the
    matrices of tasks are added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                own = products(as_matrix(b.column(0).slice(at, ROWS), p))
                total = own if total is None else total + own
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    tasks = max(1024, 4 * rows.sparkSession.sparkContext.defaultParallelism)
    cells = rows.select("x").coalesce(tasks).mapInArrow(run, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
    found = cells.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # a row for each place of the matrix
    out = np.zeros((1 + max((r.i for r in found), default=-1), 1 + max((r.j for r in found), default=-1)))
    for r in found:
        out[r.i, r.j] = r.v
    return out
