import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmill.operators import correlation, statistics
from quillmill.plans.skew import join_counted


def rows_of(df):
    return {(r.x, r.y): r for r in df.collect()}


@pytest.mark.parametrize("missing", [0.0, 0.3])
def test_pearson_equals_pandas_with_nulls(spark, missing):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 12)) @ rng.normal(size=(12, 12)) + 1e6  # far from 0
    x[:, 3] = 7.1  # never varies
    x[rng.random(x.shape) < missing] = np.nan
    x[:, 5] = np.where(rng.random(3000) < 0.9, 0, x[:, 5])
    names = [f"c{i}" for i in range(12)]
    pdf = pd.DataFrame(x, columns=names)
    df = spark.createDataFrame(pdf.where(pdf.notna(), None).values.tolist(), ", ".join(f"{c} double" for c in names)).repartition(7)
    got, want = rows_of(correlation.pearson(df, names)), pdf.corr()
    assert len(got) == 66
    for (a, b), r in got.items():
        assert names.index(a) < names.index(b) and r.n == int((pdf[a].notna() & pdf[b].notna()).sum())
        assert (r.r is None) if "c3" in (a, b) else r.r == pytest.approx(want.loc[a, b], abs=1e-9)


def test_spearman_equals_pandas_with_ties(spark, monkeypatch):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"a": rng.integers(0, 5, 900), "b": rng.normal(size=900), "z": np.where(rng.random(900) < 0.95, 0.0, rng.random(900)), "w": 1.0})
    pdf["c"] = pdf["b"] ** 3 + rng.normal(size=900)
    pdf.loc[::50, "b"] = None
    names = ["a", "b", "c", "z", "w"]
    df = spark.createDataFrame(pdf[names].astype(object).where(pdf[names].notna(), None).values.tolist(), "a long, b double, c double, z double, w double").repartition(5)
    want = pdf.dropna().corr("spearman")
    for hot in (10_000, 20):  # the second broadcasts frequent values
        monkeypatch.setattr("quillmill.plans.skew.HOT", hot)
        got = rows_of(correlation.spearman_all(df, names))
        assert len(got) == 10 and {r.n for r in got.values()} == {882}
        for (a, b), r in got.items():
            assert (r.r is None) if "w" in (a, b) else r.r == pytest.approx(want.loc[a, b], abs=1e-12)


def test_empty_and_single_rows(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert correlation.pearson(df, ["a", "b"]).count() == 0 and correlation.spearman_all(df, ["a", "b"]).count() == 0
    one = spark.createDataFrame([(1.0, None), (None, 2.0), (3.0, 4.0)], "a double, b double")
    r = correlation.pearson(one, ["a", "b"]).first()
    assert (r.n, r.r) == (1, None)
    n, mean, products = correlation.square(one, ["a", "b"])
    assert n == 1 and mean.tolist() == [3.0, 4.0] and not products.any()
    assert correlation.square(df, ["a"])[0] == 0
    assert statistics.ols_hc3(df, "a", ["b"]).count() == 0


def test_four_hundred_columns(spark):
    p, n = 400, 10_000
    made = spark.range(n).repartition(4).select(*[(F.xxhash64("id", F.lit(i // 2)) % 1000 + (F.xxhash64("id", F.lit(1000 + i)) % 300)).cast("double").alias(f"v{i}") for i in range(p)])
    df = spark.createDataFrame(made.toPandas())
    names = df.columns
    began = time.time()
    got = correlation.pearson(df, names).toPandas()
    assert len(got) == p * (p - 1) // 2 and time.time() - began < 90
    want = np.corrcoef(df.toPandas().to_numpy(), rowvar=False)
    at = {c: i for i, c in enumerate(names)}
    assert np.abs(want[got["x"].map(at), got["y"].map(at)] - got["r"]).max() < 1e-12


def test_filter_takes_unrounded_coefficients(spark):
    """Just below the limit is kept, though it would round to it."""
    x = np.arange(2000.0)
    y = x + 800 * np.sin(x * 12.9)
    pdf = pd.DataFrame({"a": x, "b": y})
    r = pdf.corr().iloc[0, 1]
    df = spark.createDataFrame(pdf)
    assert [q.kept for q in statistics.correlation_filter(df, ["a", "b"], limit=r + 1e-8).collect()] == [True, True]
    assert [q.kept for q in statistics.correlation_filter(df, ["a", "b"], limit=r - 1e-8).collect()] == [True, False]


def test_many_regressors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 30))
    y = x @ rng.normal(size=30) + rng.normal(size=600) * (1 + np.abs(x[:, 0]))
    names = [f"x{i}" for i in range(30)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(y=y)).repartition(5)
    d = np.column_stack([np.ones(600), x])
    inv = np.linalg.inv(d.T @ d)
    beta = inv @ d.T @ y
    e = (y - d @ beta) / (1 - ((d @ inv) * d).sum(axis=1))
    se = np.sqrt(np.diag(inv @ (d.T * e**2) @ d @ inv))
    rows = statistics.ols_hc3(df, "y", names).collect()
    assert [r.coef for r in rows] == pytest.approx(beta, abs=1e-10) and [r.se for r in rows] == pytest.approx(se, abs=1e-10)


@pytest.mark.parametrize("hot", [10_000, 3])
def test_join_counted(spark, hot):
    rows = [(i, None if i % 5 == 0 else f"k{i % 5}" if i % 2 else "hot") for i in range(60)]
    df = spark.createDataFrame(rows, "i int, k string")
    table = df.groupBy("k").agg(F.count("*").alias("c")).where("k is null or k <> 'k3'")
    want = sorted((i, k or "", sum(x == k for _, x in rows)) for i, k in rows if k != "k3")
    assert sorted((r.i, r.k or "", r.c) for r in join_counted(df, table, ["k"], "c", hot).collect()) == want
