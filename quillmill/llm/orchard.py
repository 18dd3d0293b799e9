"""Centroid clustering in exact integers; the nearest centroid is found by Orchard's search.

Every centroid has the list of the others, nearest first, with their distances. A vector starts at some centroid and reads
that one's list; whenever it meets a centroid that is closer (or as close, with a smaller number), it goes on with that
one's list from its start. Centroids that it has measured are marked and not measured again. Once the next one in the list
lies strictly beyond twice the vector's distance, no other can be as close (triangle inequality), so ties are never lost.
All distances are squares in 64-bit integers, so "beyond twice" is "more than four times" and nothing is rounded. The
vectors of a batch make their steps side by side in numpy; each starts at the centroid nearest to it along the axis on
which the centroids differ most.

On Spark: scaled vectors are written once. A round reads them, assigns them in their tasks and sums by cluster there; a
task gives one row for each cluster, and the rows are added up by Spark. Centroids, bounded by their number and dimension,
are all that reaches the driver. A lost executor costs the tasks it ran.

Defined results: vectors that are null, of another dimension, or hold null or non-finite components take no part; repeated
rows count each; rows with equal vec_id are ordered as seeds by their components; a null vec_id counts as the empty
string; fewer vectors than clusters make as many clusters as vectors; a cluster without vectors keeps its centroid; an empty
table gives an empty result; other columns are not read. Scaled components beyond 2^26 raise OverflowError, since sums of their
squares may not fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.mtree import quantized
from quillmill.plans.scratch import materialize

#: Vectors that make their steps together.
STEP = 4096
LIMIT = 1 << 26


class Orchard:
    def __init__(self, centroids: np.ndarray):
        c = self.centroids = centroids.astype(np.int64)
        k = len(c)
        apart = np.array([((c - x) ** 2).sum(axis=1) for x in c]).reshape(k, k)
        # each list without its own centroid, nearest first
        self.lists = np.array([[j for j in np.argsort(row, kind="stable") if j != i] for i, row in enumerate(apart)], np.int64).reshape(k, max(0, k - 1))
        self.apart = np.take_along_axis(apart, self.lists, axis=1) if k > 1 else np.zeros((k, 0), np.int64)
        self.axis = int(np.argmax(c.max(axis=0) - c.min(axis=0)))
        self.along = np.argsort(c[:, self.axis], kind="stable")
        self.middles = (c[self.along][1:, self.axis] + c[self.along][:-1, self.axis]) / 2

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number of the nearest centroid, squared distance) of each row, ties to the smaller number; distances computed."""
        n, k = len(x), len(self.centroids)
        now = self.along[np.searchsorted(self.middles, x[:, self.axis])]
        best = ((x - self.centroids[now]) ** 2).sum(axis=1)
        seen = np.zeros((n, k), bool)
        seen[np.arange(n), now] = True
        at, rows, measured = np.zeros(n, np.int64), np.arange(n), n
        while True:
            rows = rows[at[rows] < k - 1]
            rows = rows[self.apart[now[rows], at[rows]] <= 4 * best[rows]]
            if not len(rows):
                return now, best, measured
            other = self.lists[now[rows], at[rows]]
            at[rows] += 1
            fresh = ~seen[rows, other]
            r, c = rows[fresh], other[fresh]
            seen[r, c] = True
            d = ((x[r] - self.centroids[c]) ** 2).sum(axis=1)
            measured += len(r)
            closer = (d < best[r]) | ((d == best[r]) & (c < now[r]))
            r = r[closer]
            now[r], best[r], at[r] = c[closer], d[closer], 0


def _rows(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) and max(flat.max(), -flat.min()) > LIMIT:
        raise OverflowError("components too large for exact distances in 64 bits")
    return flat.reshape(len(column), -1)


def _assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Orchard(centroids)
        for b in batches:
            for at in range(0, b.num_rows, STEP):
                part = b.slice(at, STEP)
                near, far, _ = index.nearest(_rows(part.column(1)))
                yield pa.record_batch([part.column(0), pa.array(near.astype(np.int32)), pa.array(far)], names=["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "v").mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def _sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sum of every cluster that has vectors."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, count, total = Orchard(centroids), np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, STEP):
                x = _rows(b.column(0).slice(at, STEP))
                near = index.nearest(x)[0]
                count += np.bincount(near, minlength=k)
                for c in np.unique(near):
                    total[c] += x[near == c].sum(axis=0)
        some = np.flatnonzero(count)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    # a row for each task and cluster; sums of all tasks may pass 64 bits
    parts = vectors.select("v").mapInArrow(run, "cluster int, n long, total array<long>")
    cells = parts.select("cluster", F.posexplode(F.array_insert("total", 1, F.col("n"))).alias("at", "x"))
    found = cells.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("x")).collect()  # clusters x (dimension + 1)
    out: dict[int, list[int]] = {}
    for r in found:
        out.setdefault(r.cluster, [0] * (dim + 1))[r.at] = int(r.x)
    return {c: (v[0], v[1:]) for c, v in out.items()}


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3) -> tuple[DataFrame, np.ndarray]:
    """vectors (vec_id, v array of integers, all of one dimension) → (vec_id, cluster, distance) and the centroids."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.select(key.alias("h"), "v").orderBy("h", "v").limit(k).collect()  # k rows
    if not first:
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, 0), np.int64)
    centroids = np.array([r.v for r in first], np.int64).reshape(len(first), -1)
    for _ in range(rounds):
        sums = _sums(vectors, centroids)
        later = centroids.copy()
        for c, (n, total) in sums.items():
            later[c] = [t // n for t in total]
        if (later == centroids).all():
            break  # every further round would give the same
        centroids = later
    return _assign(vectors, centroids), centroids


def op11_orchard(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.size("embedding") == 64)
    rows = rows.select("vec_id", quantized(F.col("embedding")).alias("v")).where("v is not null")
    vectors = materialize(rows, "orchard-vectors")
    found, centroids = cluster(vectors)
    found = materialize(found, "orchard-clusters")
    named = spark.createDataFrame([(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    whole = lambda of: F.sum(F.col(of).cast("decimal(20,0)"))
    per = found.groupBy("cluster").agg(whole("distance").alias("s"))  # a row for each cluster
    total = per.agg(whole("s").cast("long").alias("inertia"))
    per = per.join(F.broadcast(named), "cluster").crossJoin(F.broadcast(total))  # one row
    per = per.select("cluster", F.col("s").cast("long").alias("cluster_inertia"), "inertia", "centroid_sha256")
    return found.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 8, rounds: int = 10) -> str:
    assign = lambda i: f"a{i} AS MATERIALIZED (SELECT key, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT e.key, m.c, CAST(list_sum(list_transform(list_zip(e.v, m.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM e, m{i} AS m) GROUP BY key)"
    parts = [
        "e AS MATERIALIZED (SELECT row_number() OVER () AS key, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM e ORDER BY h, v LIMIT {k}))",
    ]
    for i in range(rounds):
        parts += [
            assign(i),
            f"s{i} AS MATERIALIZED (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT a.c, unnest(e.v) AS x, unnest(range(1, 65)) AS i FROM a{i} AS a JOIN e USING (key)) GROUP BY c, i)",
            f"m{i + 1} AS MATERIALIZED (SELECT m.c, coalesce(u.v, m.v) AS v FROM m{i} AS m LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{i} GROUP BY c) AS u USING (c))",
        ]
    parts.append(assign(rounds))
    return "WITH " + ",\n".join(parts) + f"\nSELECT e.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256 FROM a{rounds} AS a JOIN e USING (key) JOIN m{rounds} AS m USING (c)"


OP11_SQL = _sql()
