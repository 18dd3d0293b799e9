import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.operators import selection, statistics
from quillmill.plans.prefix import range_offsets


def test_hc3_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    y = 1 + x @ [2, -1] + rng.normal(size=200) * (1 + abs(x[:, 0]))
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    d = np.column_stack([np.ones(200), x])
    inv = np.linalg.inv(d.T @ d)
    beta = inv @ d.T @ y
    e = (y - d @ beta) / (1 - np.einsum("ij,jk,ik->i", d, inv, d))
    se = np.sqrt(np.diag(inv @ (d.T * e**2) @ d @ inv))
    rows = statistics.ols_hc3(df, "y", ["a", "b"]).collect()
    assert [r.coef for r in rows] == pytest.approx(beta, abs=1e-5) and [r.se for r in rows] == pytest.approx(se, abs=1e-5)
    r = statistics.bootstrap_difference(df.select(F.when(F.col("a") > 0, "p").otherwise("q").alias("g"), "y"), "g", "p", "q", "y", 200).first()
    assert r.low < r.difference < r.high and r.replicates == 200


def test_adjust(spark):
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.5])], "fam string, i int, p double")
    got = {r.i: r for r in statistics.adjust(df, "fam", "p", ["i"]).collect()}
    assert [got[i].holm for i in range(4)] == pytest.approx([0.04, 0.09, 0.09, 0.5]) and [got[i].bh for i in range(4)] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5])


def test_adjust_looks_back_only_and_deals_families_out(spark):
    """Against the definition, with a family that lies in several parts, one of null, equal p values and a null p; no frame
    ends at a window's last row, and no window is a whole family of tests."""
    rng = np.random.default_rng(3)
    rows = [(f, i, round(float(rng.random()), 2)) for f, n in (("a", 400), ("b", 3), (None, 5)) for i in range(n)]
    df = spark.createDataFrame(rows + [("b", 9, None)], "fam string, i int, p double")
    out = statistics.adjust(df, "fam", "p", ["i"])
    got = {(r.fam, r.i): r for r in out.collect()}
    assert len(got) == len(rows) + 1
    for fam in ("a", "b", None):
        tests = sorted((-1.0 if r.p is None else r.p, i) for (f, i), r in got.items() if f == fam)
        m, most = len(tests), 0.0
        for k, (p, i) in enumerate(tests, 1):
            if p < 0:
                continue
            most = max(most, (m - k + 1) * p)
            least = min(m / (k + j) * q for j, (q, _) in enumerate(tests[k - 1 :]))
            assert got[fam, i].holm == pytest.approx(min(1, most)) and got[fam, i].bh == pytest.approx(min(1, least))
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
    parts = {f.rpartition("/")[0] for f in out.inputFiles()}
    assert max(spark.read.parquet(p).where("fam = 'a'").groupBy("_part").count().agg({"*": "count"}).first()[0] for p in parts if "_part" in spark.read.parquet(p).columns) > 1


def test_merge_and_align(spark):
    rows = [(1, 0, 5, False, False, False), (1, 1, 3, False, True, False), (1, 2, 9, False, False, False), (2, 0, 9, False, False, True), (2, 1, 1, False, False, False), (3, 0, 1, True, False, False), (3, 1, 9, False, True, False)]
    df = spark.createDataFrame(rows, "k int, p int, score int, verified boolean, hint boolean, backup boolean")
    assert {r.k: r.p for r in selection.merge_sources(df, ["k"], "p").collect()} == {1: 2, 2: 1, 3: 0}
    one = spark.createDataFrame([(1, 2)], "b int, a int")
    assert selection.align_columns(one, ["a", "x_rate", "b"], ".*_rate").columns == ["a", "x_rate", "b"]
    with pytest.raises(ValueError):
        selection.align_columns(one, ["a", "other"], ".*_rate")
    assert selection.same_keys(one, one, ["a"]) and not selection.same_keys(one, one.where("a = 0"), ["a"])


def test_quota_spreads_evenly(spark):
    counts = spark.createDataFrame([("s", "x", 10), ("s", "y", 1), ("s", "z", 10), ("t", "x", 3)], "s string, u string, n long")
    got = {(r.s, r.u): r.quota for r in selection.least_taken_first(counts, ["s"], "u", 6).collect()}
    assert got == {("s", "y"): 1, ("s", "z"): 3, ("s", "x"): 2, ("t", "x"): 3}


def test_range_offsets(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("v"))
    got = {r.id: r.before for r in range_offsets(df, ["id"], F.col("v"), "before").collect()}
    assert got == {i: sum(j % 7 for j in range(i)) for i in range(100)}


def test_tails():
    """Points of printed tables."""
    assert statistics.t_tail(2.228, 10) == pytest.approx(0.05, abs=2e-5) and statistics.t_tail(1.96, 1e7) == pytest.approx(0.05, abs=1e-4)
    assert statistics.f_tail(3.478, 4, 10) == pytest.approx(0.05, abs=2e-4) and statistics.f_tail(161.45, 1, 1) == pytest.approx(0.05, abs=1e-4)
    assert statistics.t_point(0.05, 10) == pytest.approx(2.2281, abs=1e-4) and statistics.t_tail(0, 5) == pytest.approx(1)


def test_bootstrap_of_equal_groups(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(10, 5, 200)
    df = spark.createDataFrame([(g, float(v)) for g in "pq" for v in x for _ in range(5)], "g string, y double").repartition(7)
    r = statistics.bootstrap_difference(df, "g", "p", "q", "y").first()
    half = 1.96 * np.sqrt(2 * x.var() / 1000)
    assert r.replicates == 2000 and abs(r.difference) < 1e-9 and abs(r.g) < 1e-9
    assert r.low == pytest.approx(-half, rel=0.15) and r.high == pytest.approx(half, rel=0.15)
    assert statistics.bootstrap_difference(df.where("g = 'p'"), "g", "p", "q", "y").count() == 0


def test_congruence_of_disjoint_features(spark):
    a = spark.createDataFrame([("x", "f", 1.0), ("y", "g", 1.0)], "feature string, factor string, loading double")
    b = spark.createDataFrame([("x", "h", 2.0), ("z", "k", 1.0)], "feature string, factor string, loading double")
    c = statistics.congruence(a, b)
    assert sorted(map(tuple, c.collect())) == [("f", "h", 1.0), ("f", "k", 0.0), ("g", "h", 0.0), ("g", "k", 0.0)]
    assert sorted(map(tuple, statistics.assigned(c).collect())) == [("f", "h", 1.0), ("g", "k", 0.0)]


def test_filter_scores_and_sensitivity(spark):
    df = spark.createDataFrame([(i, float(i), 2.0 * i + (i % 2) * 0.1, float((i * 7) % 5), 3.0) for i in range(20)], "id long, a double, b double, c double, d double")
    got = {r.variable: (r.kept, r.conflict) for r in statistics.correlation_filter(df, ["a", "b", "c", "d"]).collect()}
    assert got == {"a": (True, None), "b": (False, "a"), "c": (True, None), "d": (True, None)}
    l = spark.createDataFrame([("a", "f", 0.9), ("c", "f", -0.8), ("d", "f", 0.1)], "feature string, factor string, loading double")
    s = statistics.dimension_scores(df, l, "id").toPandas()
    assert len(s) == 20 and s.score.mean() == pytest.approx(0) and s.score.std() == pytest.approx(1)
    assert statistics.agreement(statistics.dimension_scores(df, l, "id"), statistics.dimension_scores(df, l, "id"), ["id"], "score").first().r == pytest.approx(1)


def test_quota_carries_over(spark):
    """Equal to a walk over rows."""
    rows = [(s, u, 2 + (i * j) % 5) for i, s in enumerate("stvw", 1) for j, u in enumerate("abcdef", 1)]
    got = selection.balanced_quota(spark.createDataFrame(rows, "s string, u string, n long"), ["s"], "u", 9).collect()
    n = {(s, u): k for s, u, k in rows}
    assert {s: sum(r.quota for r in got if r.s == s) for s in "stvw"} == {s: 9 for s in "stvw"}
    assert all(1 <= r.quota <= n[r.s, r.u] for r in got)
    total = {u: sum(r.quota for r in got if r.u == u) for u in "abcdef"}
    assert max(total.values()) - min(total.values()) <= 2
    few = selection.balanced_quota(spark.createDataFrame(rows, "s string, u string, n long"), ["s"], "u", 4).collect()
    assert len(few) == 16 and {sum(1 for r in few if r.u == u) for u in "abcdef"} == {2, 3}  # rarest so far first


def test_scan_stops_when_there_are_enough(spark):
    df = spark.createDataFrame([("g", i, i % 2 == 0) for i in range(10)] + [("h", i, True) for i in range(10)] + [("k", 0, True)], "g string, i long, ok boolean")
    got = selection.scanned_pools(df, "g", "ok", [F.col("i")], 8, ["g", "h", "k"])
    by = {r.g: (r.n, r.k) for r in got.groupBy("g").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("k")).collect()}
    assert by == {"g": (10, 5), "h": (5, 5), "k": (1, 1)}


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(v)) for g in ("a", "b", None) for v in rng.integers(0, 9, 37)] + [("c", 4.0), ("c", None), ("d", None)]
    points = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    got = {r.g: r.q for r in statistics.quantiles(spark.createDataFrame(rows, "g string, x double").repartition(3), ["g"], "x", points).collect()}
    assert set(got) == {"a", "b", None, "c"}
    for g in got:
        assert got[g] == pytest.approx(np.quantile([x for h, x in rows if h == g and x is not None], points))
