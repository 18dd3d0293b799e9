import hashlib
import random

import numpy as np
import pytest

from quillmill.llm import orchard


def brute(x, c):
    d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


@pytest.mark.parametrize("k,dim,width", [(1, 3, 9), (2, 1, 3), (8, 2, 4), (40, 3, 30), (64, 16, 5000)])
def test_nearest_equals_brute_force_with_ties(k, dim, width):
    rng = np.random.default_rng(k)
    c, x = rng.integers(-width, width, (k, dim)), rng.integers(-width, width, (700, dim))
    if k > 4:
        c[k // 2] = c[1]  # equal centroids
    near, far, measured = orchard.Orchard(c).nearest(x)
    want, distance = brute(x, c)
    assert (near == want).all() and (far == distance).all() and measured <= k * len(x)


def test_search_measures_less_than_all():
    rng = np.random.default_rng(1)
    c = rng.integers(-50_000, 50_000, (200, 4))
    x = c[rng.integers(0, 200, 3000)] + rng.integers(-300, 300, (3000, 4))
    near, far, measured = orchard.Orchard(c).nearest(x)
    assert (near == brute(x, c)[0]).all() and measured < 3000 * 200 / 4


def lloyd(rows, k, rounds):
    order = sorted(rows, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [list(v) for _, v in order[:k]]
    dist = lambda v, m: sum((a - b) ** 2 for a, b in zip(v, m))
    near = lambda v: min(range(len(c)), key=lambda j: (dist(v, c[j]), j))
    for _ in range(rounds):
        of = [near(v) for _, v in rows]
        for j in range(len(c)):
            own = [v for (_, v), o in zip(rows, of) if o == j]
            c[j] = [sum(col) // len(own) for col in zip(*own)] if own else c[j]
    return sorted(((i if i is not None else -1), near(v), dist(v, c[near(v)])) for i, v in rows), c


@pytest.mark.parametrize("n,k", [(300, 8), (5, 8), (1, 3)])
def test_clusters_equal_the_plain_loop(spark, n, k):
    rng = random.Random(n)
    rows = [(i, [rng.randint(-40, 40) for _ in range(3)]) for i in range(n)]
    rows += rows[:1] * 40 + [(None, rows[0][1]), (0, [1, 2, 3])]  # copies, a null id and another vector of one id
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, v array<long>, cluster string").repartition(3)
    got, c = orchard.cluster(df, k=k, rounds=10)
    want, centroids = lloyd(rows, k, 10)
    assert c.tolist() == centroids
    assert sorted(((r.vec_id if r.vec_id is not None else -1), r.cluster, r.distance) for r in got.collect()) == want


def test_query_on_awkward_vectors(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(64)], "e") for i in range(60)]
    rows += [(100, None, "e"), (101, [0.0] * 63, None), (102, [0.0] * 63 + [None], "e"), (103, [float("nan")] * 64, "e"), (104, [float("inf")] + [0.0] * 63, "e"), rows[0]]
    schema = "vec_id long, embedding array<float>, v string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = orchard.op11_orchard(spark, str(tmp_path)).collect()
    kept = sorted([*range(60), 0])
    assert sorted(r.vec_id for r in out) == kept
    assert len({r.inertia for r in out}) == 1 and out[0].inertia == sum(r.distance for r in out)
    for r in out:
        assert r.cluster_inertia == sum(x.distance for x in out if x.cluster == r.cluster)
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert orchard.op11_orchard(spark, f"{tmp_path}/none").count() == 0


def test_too_large(spark):
    df = spark.createDataFrame([(1, [1 << 40]), (2, [5])], "vec_id long, v array<long>")
    with pytest.raises(Exception, match="too large"):
        orchard.cluster(df, k=2)[0].collect()
