import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import mtree


def brute(ids, v, k=10):
    out = []
    for i, q in zip(ids, v):
        if i % 100 == 0:
            s = sorted((-int(np.dot(q, x)), j) for j, x in zip(ids, v) if j != i)[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("tree", [4096, 100])
def test_equals_brute_force_with_ties(spark, tree, monkeypatch):
    monkeypatch.setattr(mtree, "TREE", tree)
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.2, (700, 16)).round(2)
    x[100:400] = x[100]  # equal vectors
    rows = [(i, [float(c) for c in r], "n") for i, r in enumerate(x)]
    rows += [(700, None, "n"), (800, [float("nan")] * 16, "n"), (900, [None] + [0.0] * 15, "n"), (1000, [float("inf")] * 16, "n")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string").select("vec_id", mtree.quantized(F.col("embedding")).alias("v")).where("v is not null")
    got = mtree.search(df, df.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")))
    v = np.floor(1024 * np.float32(x).astype(float)).astype(int)
    assert sorted(map(tuple, got.collect())) == brute(range(700), v)
    assert mtree.search(df.limit(0), df.limit(0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))).count() == 0


def test_bounds_avoid_distances():
    rng = np.random.default_rng(1)
    centres = rng.integers(-1000, 1000, (20, 8))
    v = (centres[rng.integers(0, 20, 2000)] + rng.integers(-10, 10, (2000, 8)))
    t, counts = mtree.MTree(np.arange(2000), v), {}
    for i in range(0, 2000, 100):
        want = sorted((-int(np.dot(v[i], x)), j) for j, x in enumerate(v) if j != i)[:5]
        assert t.search(v[i], i, 5, counts) == [(-s, j) for s, j in want]
    assert counts["computed"] < 0.5 * 20 * 2000
