"""Exact top-k inner products by best-first search in M-trees.

An inner product is no metric, so vectors get one more component, sqrt(M^2 - |v|^2) with M the largest norm in their
tree, and queries a 0: the squared distance |q|^2 + M^2 - 2 <q, v> then falls as the product rises. A tree has a root
page of routing entries (pivot, covering radius, distance to the root's pivot) and leaf pages whose entries keep their
distance to the leaf's pivot. A search opens pages in the order of their lower bounds; |d(q, parent) - d(entry,
parent)| bounds an entry before its own distance is computed, and what can't reach the k-th result is skipped. Scores
are exact integer products; bounds carry a margin for rounding, and ties are never pruned.

On Spark: pivots from a bounded sample give each vector a tree (salted, so that many equal vectors fill several
bounded trees), each tree is one row, and queries come in blocks of bounded size. First each query searches one tree of
the pivot nearest to it; its k-th score there then bounds the search when every tree meets every block once. A tree is a
join key of its own, so trees spread over as many tasks as there are.

Defined results: vectors that are null or hold null or non-finite components take no part; repeated rows are separate
candidates; fewer than k candidates give all of them; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.plans.scratch import materialize

#: Vectors of a tree, entries of a leaf page, and queries of a block, at most or about.
TREE, PAGE, BLOCK = 4096, 64, 256
#: Pivots that deal vectors out to trees: one for each TREE vectors, within these bounds.
PIVOTS, MOST_PIVOTS = 128, 2048


def quantized(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component; null where the vector is null or has null or non-finite components."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(embedding.isNotNull() & ~bad, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products a @ b.T: in doubles where no sum can pass 2^53."""
    most = (np.abs(a).max(initial=0).item()) * (np.abs(b).max(initial=0).item()) * max(1, a.shape[-1])
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < 2**53 else a @ b.T


class MTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((ids,))
        ids, v = ids[order], vectors[order].astype(np.int64)
        square = (v.astype(float) ** 2).sum(axis=1)
        self.top = float(square.max(initial=0.0))
        x = np.column_stack([v.astype(float), np.sqrt(np.maximum(self.top - square, 0))])
        pages = [p for p in self._split(x, np.arange(len(x))) if len(p)]
        pivots = np.array([x[p].mean(axis=0) for p in pages]).reshape(len(pages), x.shape[1])
        self.root = pivots.mean(axis=0) if len(pages) else np.zeros(x.shape[1])
        self.pivots = pivots
        self.to_root = np.linalg.norm(pivots - self.root, axis=1)
        self.parent = [np.linalg.norm(x[p] - c, axis=1) for p, c in zip(pages, pivots)]
        self.radius = np.array([d.max(initial=0.0) for d in self.parent])
        small = np.int32 if np.abs(v).max(initial=0) < 2**31 else np.int64
        self.pages = [(ids[p], v[p].astype(small)) for p in pages]

    @staticmethod
    def _split(x: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        """Pages of at most PAGE rows: halves by the distance to two far points until they are small enough."""
        todo, out = [rows], []
        while todo:
            r = todo.pop()
            if len(r) <= PAGE:
                out.append(r)
                continue
            a = x[r[np.linalg.norm(x[r] - x[r[0]], axis=1).argmax()]]
            b = x[r[np.linalg.norm(x[r] - a, axis=1).argmax()]]
            side = np.linalg.norm(x[r] - a, axis=1) - np.linalg.norm(x[r] - b, axis=1)
            cut = np.argsort(side, kind="stable")
            todo += [r[cut[: len(r) // 2]], r[cut[len(r) // 2 :]]]
        return out

    def search(self, query: np.ndarray, own: int | None, k: int, counts: dict | None = None, least: int | None = None) -> list[tuple[int, int]]:
        """(score, id) of the k best candidates other than `own`, by score, then by smaller id; of those below the score
        `least`, if given, some may lack."""
        q = np.append(query.astype(float), 0.0)
        q2 = float((q * q).sum())
        far = q2 + self.top
        slack = 1e-6 * (1 + np.sqrt(far))
        from_root = float(np.linalg.norm(q - self.root))
        cheap = np.maximum(np.abs(from_root - self.to_root) - self.radius, 0)
        queue = [(b, i, -1.0) for i, b in enumerate(cheap.tolist())]
        heapq.heapify(queue)
        best: list[tuple[int, int]] = []
        reach = np.inf if least is None else float(np.sqrt(max(0.0, far - 2.0 * least)))  # distance of the k-th result
        computed = opened = 0
        while queue:
            bound, i, d = heapq.heappop(queue)
            if bound > reach + slack:
                break
            if d < 0:  # only bounded through the root so far
                d = float(np.linalg.norm(q - self.pivots[i]))
                heapq.heappush(queue, (max(bound, d - self.radius[i]), i, d))
                computed += 1
                continue
            ids, v = self.pages[i]
            some = (np.abs(d - self.parent[i]) <= reach + slack) & ((ids != own) if own is not None else True)
            at = np.flatnonzero(some)
            computed += len(at)
            opened += 1
            if len(at):
                got = products(v[at].astype(np.int64), query[None, :])[:, 0]
                best = heapq.nsmallest(k, best + list(zip((-got).tolist(), ids[at].tolist())))
                if len(best) == k:
                    reach = min(reach, float(np.sqrt(max(0.0, far + 2.0 * best[-1][0]))))
        if counts is not None:
            counts["computed"] = counts.get("computed", 0) + computed
            counts["opened"] = counts.get("opened", 0) + opened
        return [(-s, i) for s, i in best]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.int64).reshape(len(column), -1)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """vectors (vec_id long, v array<long>), queries (query_id long, q array<long>) → query_id, rank, vec_id, score.

    A query's candidates are all vectors of its dimension but those with its own id.
    """
    pivots = min(MOST_PIVOTS, max(PIVOTS, vectors.count() // TREE))
    sample = [r.v for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()]  # bounded
    by_size: dict[int, np.ndarray] = {}
    for v in sample:
        by_size.setdefault(len(v), []).append(v)
    by_size = {n: np.array(vs, float) for n, vs in by_size.items()}

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        out = np.zeros(len(v), np.int64)
        for n, at in v.groupby(v.map(len)).groups.items():
            if n in by_size:
                x, p = np.array(v.loc[at].tolist(), float), by_size[n]
                out[v.index.get_indexer(at)] = ((p * p).sum(axis=1)[None, :] - 2 * x @ p.T).argmin(axis=1)
        return pd.Series(out, dtype="int32")

    n_dim = F.size("v").alias("n")
    placed = materialize(vectors.select("vec_id", "v", n_dim, nearest("v").alias("pivot")), "mtree-vectors")
    sizes = sorted((r.n, r.pivot, -(-r["count"] // TREE)) for r in placed.groupBy("n", "pivot").count().collect())  # a row for each pivot
    first = np.cumsum([0] + [salts for _, _, salts in sizes]).tolist()
    table = vectors.sparkSession.createDataFrame([(*x, at) for x, at in zip(sizes, first)], "n int, pivot int, salts long, first long")
    dealt = placed.join(F.broadcast(table), ["n", "pivot"]).select("n", "vec_id", "v", (F.col("first") + F.pmod(F.xxhash64("vec_id", F.lit(5)), F.col("salts"))).alias("tree_no"))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        tree = MTree(rows["vec_id"].to_numpy(np.int64), _matrix(rows["v"]))
        return pd.DataFrame({"n": [int(rows["n"].iloc[0])], "tree_no": [int(rows["tree_no"].iloc[0])], "tree": [pickle.dumps(tree)]})

    trees = materialize(dealt.groupBy("n", "tree_no").applyInPandas(build, "n int, tree_no long, tree binary"), "mtrees")

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        least = [None if x is None or x != x else int(x) for x in rows["least"]]
        return pd.DataFrame({"n": [int(rows["n"].iloc[0])], "tree_no": [int(rows["tree_no"].iloc[0])], "block": [pickle.dumps((rows["query_id"].to_numpy(np.int64), _matrix(rows["q"]), least))]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, q in zip(b.column(0), b.column(1)):
                tree, (ids, block, least) = pickle.loads(t.as_py()), pickle.loads(q.as_py())
                out = [(i, v, s) for i, x, l in zip(ids.tolist(), block, least) for s, v in tree.search(x, i, k, None, l)]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], [], []))], names=["query_id", "vec_id", "score"])

    def packed(asked: DataFrame) -> DataFrame:
        many = max(1, -(-asked.count() // BLOCK))
        return asked.withColumn("b", F.pmod(F.xxhash64("query_id"), F.lit(many))).groupBy("n", "tree_no", "b").applyInPandas(pack, "n int, tree_no long, block binary")

    found_in = lambda blocks: trees.join(blocks, ["n", "tree_no"]).select("tree", "block").mapInArrow(run, "query_id long, vec_id long, score long")
    asked = queries.select("query_id", "q", F.size("q").alias("n"), nearest("q").alias("pivot"))
    # one tree of the nearest pivot; where its dimension has no vector there, no bound
    near = asked.join(F.broadcast(table.select("n", "pivot", F.col("first").alias("tree_no"))), ["n", "pivot"]).select("query_id", "q", "n", "tree_no", F.lit(None).cast("double").alias("least"))
    bound = found_in(packed(near)).groupBy("query_id").agg(F.count("*").alias("c"), F.min("score").cast("double").alias("least")).where(F.col("c") >= k)
    asked = materialize(asked.join(bound.select("query_id", "least"), "query_id", "left").select("query_id", "q", "n", F.lit(0).cast("long").alias("tree_no"), "least"), "mtree-queries")
    every = trees.select("n", F.col("tree_no").alias("t")).groupBy("n").agg(F.collect_list("t").alias("t"))  # numbers alone
    blocks = packed(asked).drop("tree_no").join(every, "n").select("n", F.explode("t").alias("tree_no"), "block")
    found = found_in(blocks)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op5_topk(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", quantized(F.col("embedding")).alias("v")).where("v is not null")
    return search(rows, rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")))


OP5_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, CAST(list_dot_product(q.v, e.v) AS BIGINT) AS score
      FROM e AS q JOIN e ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10
"""
