"""Statistics of wide tables: moments, tests, corrections, ranks, regressions, resampling."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillmill.operators.correlation import packed, pearson, summed
from quillmill.plans.prefix import range_offsets
from quillmill.plans.scratch import materialize


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b), by its continued fraction."""
    if not x > 0:
        return 0.0 if x <= 0 else math.nan
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or 1e-300)
    value = d
    for m in range(1, 100_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + step * d) or 1e-300)
            c = (1 + step / c) or 1e-300
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def t_tail(t: float, df: float) -> float:
    """P(|T| > |t|) of Student's t."""
    return beta_share(df / 2, 0.5, df / (df + t * t)) if t == t and df > 0 else math.nan


def f_tail(f: float, df1: float, df2: float) -> float:
    """P(F > f)."""
    return beta_share(df2 / 2, df1 / 2, df2 / (df2 + df1 * f)) if f == f and df2 > 0 else math.nan


def t_point(p: float, df: float) -> float:
    """The t that |T| exceeds with chance p."""
    low, high = 0.0, 1.0
    while t_tail(high, df) > p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_tail(mid, df) > p else (low, mid)
    return (low + high) / 2


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_tail(x, n) for x, n in zip(t, df)], dtype=float)


@F.pandas_udf(DoubleType())
def f_p(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series([f_tail(*x) for x in zip(f, df1, df2)], dtype=float)


def long_form(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.select(*keys, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(keys, values, "variable", "x")


def moments(df: DataFrame, group: str, values: list[str]) -> DataFrame:
    return long_form(df, [group], values).groupBy(group, "variable").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("var"))


def quantiles(long: DataFrame, keys: list[str], value: str, points: list[float]) -> DataFrame:
    """keys and q (an array, one for each point, interpolated between neighbours) over the values that are not null.

    Exact without a group in one task: values are counted, dealt out by range, and ranked by distributed prefix sums; only
    the values that stand next to a point's rank are kept.
    """
    counts = long.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    at = range_offsets(counts, [*keys, value], F.col("_c"), "_at")
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    ends = at.groupBy(*named).agg(F.min("_at").alias("_first"), F.sum("_c").alias("_n"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    j = at.join(F.broadcast(ends), same).select(*keys, F.col(value).alias("_x"), (F.col("_at") - F.col("_first")).alias("_a"), "_c", "_n")  # a row for each group
    need = lambda p: F.lit(float(p)) * (F.col("_n") - 1)
    holds = lambda rank: (F.col("_a") <= rank) & (rank < F.col("_a") + F.col("_c"))
    low, high = [[F.max(F.when(holds(f(need(p))), F.col("_x"))) for p in points] for f in (F.floor, F.ceil)]
    some = F.lit(False)
    for p in points:
        some = some | holds(F.floor(need(p))) | holds(F.ceil(need(p)))
    g = j.where(some).groupBy(*keys).agg(F.max("_n").alias("_n"), F.array(*low).alias("_l"), F.array(*high).alias("_h"))
    q = [F.col("_l")[i] + (F.col("_h")[i] - F.col("_l")[i]) * (need(p) - F.floor(need(p))) for i, p in enumerate(points)]
    return g.select(*keys, F.array(*[x.cast("double") for x in q]).alias("q"))


def descriptives(df: DataFrame, group: str, values: list[str]) -> DataFrame:
    long = long_form(df, [group], values)
    out = long.groupBy(group, "variable").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    q = quantiles(long, [group, "variable"], "x", [0.25, 0.5, 0.75]).select(F.col(group).alias("_g"), F.col("variable").alias("_v"), "q")
    j = out.join(F.broadcast(q), F.col(group).eqNullSafe(F.col("_g")) & (F.col("variable") == F.col("_v")), "left")  # a row for each cell
    return j.select(group, "variable", "n", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), F.round(F.col("q")[1], 4).alias("median"), F.round(F.col("q")[2] - F.col("q")[0], 4).alias("iqr"))


def welch(df: DataFrame, group: str, values: list[str]) -> DataFrame:
    """Welch t, its degrees of freedom and p, and Hedges g for each pair of groups; only the small moments are joined.
    g is 0 where nothing varies."""
    m = moments(df, group, values)
    a = m.select(F.col(group).alias("a"), "variable", F.col("n").alias("na"), F.col("mean").alias("ma"), F.col("var").alias("va"))
    b = m.select(F.col(group).alias("b"), "variable", F.col("n").alias("nb"), F.col("mean").alias("mb"), F.col("var").alias("vb"))
    j = a.join(b, "variable").where("a < b")
    sa, sb, diff = F.col("va") / F.col("na"), F.col("vb") / F.col("nb"), F.col("ma") - F.col("mb")
    n = F.col("na") + F.col("nb")
    pooled = F.sqrt(F.try_divide((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb"), n - 2))
    dof = F.try_divide((sa + sb) ** 2, F.try_divide(sa**2, F.col("na") - 1) + F.try_divide(sb**2, F.col("nb") - 1))
    g = F.when(pooled > 0, diff / pooled * (1 - 3 / F.greatest(F.lit(1), 4 * n - 9))).otherwise(0.0)
    out = j.select("variable", "a", "b", diff.alias("difference"), F.try_divide(diff, F.sqrt(sa + sb)).alias("t"), dof.alias("df"), g.alias("g"))
    return out.withColumn("p", t_p("t", "df"))


def welch_anova(df: DataFrame, group: str, values: list[str]) -> DataFrame:
    """Welch's F with its degrees of freedom and p, and omega squared (0 at least), of each variable over the groups."""
    m = moments(df, group, values).withColumn("w", F.try_divide("n", "var"))
    rows, within = F.sum("n"), F.sum((F.col("n") - 1) * F.col("var"))
    total = m.groupBy("variable").agg(F.count("*").alias("k"), F.sum("w").alias("sw"), (F.sum(F.col("w") * F.col("mean")) / F.sum("w")).alias("grand"), rows.alias("rows"), within.alias("within"), (F.sum(F.col("n") * F.col("mean")) / rows).alias("plain"))
    j = m.join(F.broadcast(total), "variable")  # one row for each variable
    square = lambda c: F.sum(F.col(c[0]) * (F.col("mean") - F.col(c[1])) ** 2)
    out = j.groupBy("variable", "k", "rows", "within").agg(square(("w", "grand")).alias("between"), square(("n", "plain")).alias("ssb"), F.sum(F.try_divide((1 - F.col("w") / F.col("sw")) ** 2, F.col("n") - 1)).alias("lam"))
    k, lam = F.col("k"), F.col("lam")
    f = F.try_divide(F.col("between"), (k - 1) * (1 + F.try_divide(2 * (k - 2), k**2 - 1) * lam))
    ms = F.coalesce(F.col("within") / F.when(F.col("rows") > k, F.col("rows") - k), F.lit(0.0))
    base = F.col("ssb") + F.col("within") + ms
    omega = F.when(base > 0, F.greatest(F.lit(0.0), (F.col("ssb") - (k - 1) * ms) / base)).otherwise(0.0)
    out = out.select("variable", f.alias("f"), (k - 1).alias("df1"), F.try_divide(k**2 - 1, 3 * lam).alias("df2"), omega.alias("omega2")).withColumn("p", f_p("f", "df1", "df2"))
    return out.select("variable", "f", "df1", "df2", "omega2", "p")


def adjust(df: DataFrame, family: str, p: str, key: list[str]) -> DataFrame:
    """Adds holm (running maximum of (m - i + 1) p) and bh (running minimum from the end of m / i p), both 1 at most.

    Tests are dealt by range of (family, p, key) and written with their part's number, so a large family is the work of many
    tasks; what the parts of a family before and after a part hold comes from one row for each family and part. Both windows
    only look back in their order: Spark computes a frame that ends at the last row anew for every row.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(n, family, p, *key).withColumn("_part", F.spark_partition_id()), "tests")
    within = Window.partitionBy("_part", family)
    up, down = within.orderBy(p, *key), within.orderBy(F.col(p).desc(), *[F.col(k).desc() for k in key])
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    per = Window.partitionBy(family)
    before = per.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    after = per.orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)

    sizes = dealt.groupBy(family, "_part").agg(F.count("*").alias("_n"))
    sizes = sizes.select(F.col(family).alias("_family"), F.col("_part").alias("_of"), F.sum("_n").over(Window.partitionBy(family)).alias("_m"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    same = lambda: F.col(family).eqNullSafe(F.col("_family")) & (F.col("_part") == F.col("_of"))
    i = F.col("_first") + F.row_number().over(up)
    d = dealt.join(sizes, same()).withColumn("_i", i).drop("_family", "_of", "_first")
    d = d.withColumn("_h", F.max((F.col("_m") - F.col("_i") + 1) * F.col(p)).over(past(up)))
    d = materialize(d.withColumn("_b", F.min(F.col("_m") / F.col("_i") * F.col(p)).over(past(down))), "tests")
    ends = d.groupBy(family, "_part").agg(F.max("_h").alias("_most"), F.min("_b").alias("_least"))
    ends = ends.select(F.col(family).alias("_family"), F.col("_part").alias("_of"), F.max("_most").over(before).alias("_most"), F.min("_least").over(after).alias("_least"))
    d = d.join(ends, same())
    # greatest and least pass nulls over
    d = d.withColumn("holm", F.least(F.lit(1.0), F.greatest("_most", "_h"))).withColumn("bh", F.least(F.lit(1.0), F.least("_least", "_b")))
    return d.select(*df.columns, "holm", "bh")


def correlation(df: DataFrame, values: list[str]) -> DataFrame:
    """(x, y, r) for all pairs, x before y in `values`, over the rows that have both; r is null where a column doesn't vary.
    Hundreds of columns take one pass, see `operators.correlation`."""
    return pearson(df, values).select("x", "y", "r")


def mid_ranks(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """(group, value, out): average rank of each value, from value counts and distributed prefix sums: values are dealt
    by range, so a group with many different values is the work of many tasks."""
    counts = df.groupBy(*group, value).agg(F.count("*").alias("_c"))
    first = range_offsets(counts, [*group, value], F.col("_c"), "_before")
    start = first.groupBy(*group).agg(F.min("_before").alias("_start"))
    j = first.join(F.broadcast(start), group) if group else first.withColumn("_start", F.lit(0))  # a row for each group
    return j.select(*group, value, (F.col("_before") - F.col("_start") + (F.col("_c") + 1) / 2.0).alias(out))


def spearman(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    pairs = df.select(group, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(group, x, y).agg(F.count("*").alias("c"))
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    j = pairs.join(mid_ranks(rows, [group], x, "rx"), [group, x]).join(mid_ranks(rows, [group], y, "ry"), [group, y])
    n, s = F.sum("c"), lambda e: F.sum(F.col("c") * e)
    rx, ry = F.col("rx"), F.col("ry")
    cov = n * s(rx * ry) - s(rx) * s(ry)
    return j.groupBy(group).agg(n.alias("n"), F.round(F.try_divide(cov, F.sqrt((n * s(rx * rx) - s(rx) ** 2) * (n * s(ry * ry) - s(ry) ** 2))), 6).alias("rho"))


def screen(df: DataFrame, values: list[str], zero_share: float = 0.95) -> DataFrame:
    """variable, zeros (share), sd, kept: not constant and not nearly always zero; one aggregate over all columns."""
    row = df.agg(*[e for v in values for e in (F.avg((F.col(v) == 0).cast("double")).alias(f"{v}|z"), F.stddev_samp(F.col(v).cast("double")).alias(f"{v}|s"))])
    stack = F.array(*[F.struct(F.lit(v).alias("variable"), F.round(F.col(f"`{v}|z`"), 6).alias("zeros"), F.round(F.col(f"`{v}|s`"), 4).alias("sd")) for v in values])
    return row.select(F.inline(stack)).withColumn("kept", (F.col("sd") > 1e-12) & (F.col("zeros") < zero_share))


def project(target: DataFrame, reference: DataFrame, key: str, signs: dict[str, int]) -> DataFrame:
    """Sum of signed z-scores of target's rows under the reference's means and sds (sd of 0 counts as 1)."""
    p = reference.agg(*[e for v in signs for e in (F.avg(F.col(v).cast("double")).alias(f"m_{v}"), F.stddev_samp(F.col(v).cast("double")).alias(f"s_{v}"))])
    d = target.crossJoin(F.broadcast(p))  # a single row of parameters
    z = lambda v: (F.col(v) - F.col(f"m_{v}")) / F.when(F.col(f"s_{v}") <= 1e-12, 1.0).otherwise(F.col(f"s_{v}"))
    return d.select(key, F.round(reduce(lambda a, b: a + b, [s * z(v) for v, s in signs.items()]), 4).alias("score"))


def ols_hc3(df: DataFrame, y: str, xs: list[str], dummies: dict[str, list] | None = None, logs: list[str] = (), level: float = 0.95) -> DataFrame:
    """Ordinary least squares with HC3 errors: term, coef, se, stat, p and interval by t, p_normal by the normal law, n,
    r2 and adjusted r2. `dummies` names columns with the levels that get a term each (the level left out is the base);
    `logs` are columns that enter as the logarithm of at least 1. Rows with a null take no part. Two passes: sums of
    products, then of weighted products; only p x p matrices reach the driver."""
    terms = {"intercept": F.lit(1.0), **{x: F.col(x).cast("double") for x in xs}, **{f"log_{x}": F.log(F.greatest(F.col(x).cast("double"), F.lit(1.0))) for x in logs}}
    terms |= {f"{c}={v}": (F.col(c) == v).cast("double") for c, vs in (dummies or {}).items() for v in vs}
    names, p = list(terms), len(terms)
    rows = packed(df.dropna(subset=[y, *xs, *logs, *(dummies or {})]).select(*[c.alias(f"_{i}") for i, c in enumerate([*terms.values(), F.col(y).cast("double")])]), [f"_{i}" for i in range(p + 1)])

    schema = "term string, coef double, se double, stat double, p double, low double, high double, p_normal double, n long, r2 double, adjusted_r2 double"
    first = summed(rows, p + 1, lambda x: x.T @ x)  # of the terms and y
    n = int(round(first[0, 0])) if len(first) else 0
    if n <= p:
        return df.sparkSession.createDataFrame([], schema)
    inverse = np.linalg.pinv(first[:p, :p])
    beta = inverse @ first[:p, p]

    def weighted(x: np.ndarray) -> np.ndarray:
        x, residual = x[:, :p], x[:, p] - x[:, :p] @ beta
        w = residual / (1 - ((x @ inverse) * x).sum(axis=1))
        return np.vstack([(x * (w * w)[:, None]).T @ x, np.full((1, p), (residual * residual).sum())])

    second = summed(rows, p + 1, weighted)
    se = np.sqrt(np.diag(inverse @ second[:p] @ inverse))
    spread = float(first[p, p] - first[0, p] ** 2 / n)
    r2 = 1 - float(second[p, 0]) / spread if spread > 0 else 0.0
    adjusted, point = 1 - (1 - r2) * (n - 1) / (n - p), t_point(1 - level, n - p)
    out = []
    for t, b, s in zip(names, beta.tolist(), se.tolist()):
        stat = b / s if s > 0 else math.nan
        out.append((t, b, s, stat, t_tail(stat, n - p), b - point * s, b + point * s, math.erfc(abs(stat) / math.sqrt(2)), n, r2, adjusted))
    return df.sparkSession.createDataFrame(out, schema)


def bootstrap_difference(df: DataFrame, group: str, a: str, b: str, value: str, replicates: int = 2000, seed: int = 20260830) -> DataFrame:
    """Mean difference of groups a and b and Hedges g, as observed, each with a 95 % interval over `replicates`.

    Each task draws Poisson(1) weights for its rows, from a seed of its own, group and batch, and sums weights, weighted
    values and squares by replicate; it gives one row for each replicate and group, whatever its rows. So no replicate
    is ever materialised. The observed values don't depend on how rows are dealt out; the intervals do, within their
    sampling error. Without rows in both groups there is no result row.
    """
    sides = [a, b]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        sums = np.zeros((2, 3, replicates))
        for number, d in enumerate(batches):
            for side in (0, 1):
                x = d["x"].to_numpy()[d["side"].to_numpy() == side]
                rng = np.random.default_rng([seed, part, number, side])
                for k in range(0, len(x), 1024):
                    part_x = x[k : k + 1024]
                    w = rng.poisson(1.0, (replicates, len(part_x))).astype(np.float64)
                    sums[side] += w.sum(axis=1), w @ part_x, w @ part_x**2
        for side in (0, 1):
            yield pd.DataFrame({"replicate": np.arange(replicates), "side": side, "w": sums[side, 0], "wx": sums[side, 1], "wxx": sums[side, 2]})

    x = F.col(value).cast("double")
    side = F.when(F.col(group) == a, 0).when(F.col(group) == b, 1)
    rows = df.select(side.cast("int").alias("side"), x.alias("x")).where("side is not null and x is not null and not isnan(x)")
    seen = rows.groupBy().agg(*[e for i in (0, 1) for e in (F.count(F.when(F.col("side") == i, 1)).alias(f"n{i}"), F.avg(F.when(F.col("side") == i, F.col("x"))).alias(f"m{i}"), F.var_samp(F.when(F.col("side") == i, F.col("x"))).alias(f"v{i}"))])
    seen = seen.where("n0 > 0 and n1 > 0")
    shift = seen.select(((F.col("m0") + F.col("m1")) / 2).alias("shift"))  # near the values, so that squares stay exact
    centred = rows.crossJoin(F.broadcast(shift)).select("side", (F.col("x") - F.col("shift")).alias("x"))  # one row
    sums = centred.mapInPandas(run, "replicate int, side int, w double, wx double, wxx double").groupBy("replicate")
    pick = lambda i, c: F.sum(F.when(F.col("side") == i, F.col(c)))
    sums = sums.agg(*[pick(i, c).alias(f"{c}{i}") for i in (0, 1) for c in ("w", "wx", "wxx")]).where("w0 > 1 and w1 > 1")
    mean = lambda i: F.col(f"wx{i}") / F.col(f"w{i}")
    var = lambda i: (F.col(f"wxx{i}") - F.col(f"wx{i}") * mean(i)) / (F.col(f"w{i}") - 1)
    each = sums.select((mean(0) - mean(1)).alias("d"), _hedges(F.col("w0"), F.col("w1"), mean(0) - mean(1), var(0), var(1)).alias("g"))
    ends = each.agg(*[F.percentile(c, p).alias(f"{c}_{n}") for c in ("d", "g") for n, p in (("low", 0.025), ("high", 0.975))], F.count("d").alias("replicates"))
    observed = seen.select((F.col("m0") - F.col("m1")).alias("difference"), _hedges(F.col("n0"), F.col("n1"), F.col("m0") - F.col("m1"), F.col("v0"), F.col("v1")).alias("g"))
    return observed.crossJoin(F.broadcast(ends)).select("difference", F.col("d_low").alias("low"), F.col("d_high").alias("high"), "g", "g_low", "g_high", "replicates")  # one row each


def _hedges(n1: Column, n2: Column, difference: Column, v1: Column, v2: Column) -> Column:
    pooled = ((n1 - 1) * F.coalesce(v1, F.lit(0.0)) + (n2 - 1) * F.coalesce(v2, F.lit(0.0))) / F.greatest(F.lit(1), n1 + n2 - 2)
    return F.when(pooled > 0, difference / F.sqrt(pooled) * (1 - 3 / F.greatest(F.lit(1), 4 * (n1 + n2) - 9))).otherwise(0.0)


def congruence(a: DataFrame, b: DataFrame) -> DataFrame:
    """(factor_a, factor_b, c) of loadings (feature, factor, loading): Tucker's coefficient over the union of features,
    for every pair of factors; 0 where they share no feature or a norm is 0."""
    x = a.select("feature", F.col("factor").alias("factor_a"), F.col("loading").alias("x"))
    y = b.select("feature", F.col("factor").alias("factor_b"), F.col("loading").alias("y"))
    nx, ny = x.groupBy("factor_a").agg(F.sum(F.col("x") ** 2).alias("nx")), y.groupBy("factor_b").agg(F.sum(F.col("y") ** 2).alias("ny"))
    s = x.join(y, "feature").groupBy("factor_a", "factor_b").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    pairs = nx.crossJoin(ny).join(s, ["factor_a", "factor_b"], "left")  # a few factors on either side
    size = F.sqrt(F.col("nx") * F.col("ny"))
    return pairs.select("factor_a", "factor_b", F.when(size > 0, F.coalesce("s", F.lit(0.0)) / size).otherwise(0.0).alias("c"))


def assigned(c: DataFrame) -> DataFrame:
    """(factor_a, factor_b, c) of `congruence` → one partner for each factor, so that the sum of |c| is greatest; left
    over ones of the longer side go. The table of factor pairs is a few rows, and is matched on the driver."""
    from quillmill.operators.factors import best_match

    rows = c.collect()
    left, right = sorted({r.factor_a for r in rows}), sorted({r.factor_b for r in rows})
    score = np.zeros((len(left), len(right)))
    value = {(r.factor_a, r.factor_b): r.c for r in rows}
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            score[i, j] = abs(value[x, y])
    found = [(left[i], right[j], value[left[i], right[j]]) for i, j in enumerate(best_match(score)) if j >= 0] if rows else []
    return c.sparkSession.createDataFrame(found, c.schema)


def correlation_filter(df: DataFrame, values: list[str], limit: float = 0.85) -> DataFrame:
    """values in order of priority → variable, kept, conflict (the kept one with the greatest |r|, of limit or more), r.

    A variable goes if it correlates at |r| >= limit with one that is kept. The correlations come from one pass over the
    rows; the choice over a few hundred names is the driver's. A variable that doesn't vary has no correlation.
    """
    rows = correlation(df, values).collect()
    r = {frozenset((x.x, x.y)): x.r for x in rows}
    kept: list[str] = []
    out = []
    for v in values:
        clash = [(abs(c), -i, k, c) for i, k in enumerate(kept) if (c := r[frozenset((v, k))]) is not None and c == c and abs(c) >= limit]
        if clash:
            out.append((v, False, *max(clash)[2:]))
        else:
            kept.append(v)
            out.append((v, True, None, None))
    return df.sparkSession.createDataFrame(out, "variable string, kept boolean, conflict string, r double")


def dimension_scores(df: DataFrame, loadings: DataFrame, key: str, least: float = 0.3) -> DataFrame:
    """loadings (feature, factor, loading) → key, factor, raw, score: every feature counts for the factor of its greatest
    |loading|, if that is `least` or more, with its sign; raw is the sum of its z-scores, score is raw as a z-score.

    Sds below 1e-12 count as 1; a null feature value makes the raw score null. One aggregate gives all means and sds, the
    table is read once for the sums and once for the final scaling.
    """
    ranked = loadings.groupBy("feature").agg(F.max_by(F.struct("factor", "loading"), F.struct(F.abs("loading"), "factor")).alias("m")).select("feature", "m.*").where(F.abs("loading") >= least)
    rows = [(r.feature, r.factor, 1 if r.loading >= 0 else -1) for r in ranked.collect()]  # a row for each feature
    names = sorted(f for f, _, _ in rows)
    if not names:
        return df.select(key, F.lit(None).cast("string").alias("factor"), F.lit(None).cast("double").alias("raw"), F.lit(None).cast("double").alias("score")).limit(0)
    one = df.agg(*[e for i, f in enumerate(names) for e in (F.avg(F.col(f).cast("double")).alias(f"m{i}"), F.stddev_samp(F.col(f).cast("double")).alias(f"s{i}"))]).first()
    at = {f: i for i, f in enumerate(names)}
    flat = lambda v: v if v is not None and v > 1e-12 else 1.0
    z = lambda f: (F.col(f).cast("double") - float(one[f"m{at[f]}"] or 0.0)) / flat(one[f"s{at[f]}"])
    of: dict = {}
    for f, factor, sign in sorted(rows):
        of.setdefault(factor, []).append(sign * z(f))
    wide = df.select(key, *[reduce(lambda a, b: a + b, cs).alias(f"f{i}") for i, cs in enumerate(of.values())])
    two = wide.agg(*[e for i in range(len(of)) for e in (F.avg(f"f{i}").alias(f"m{i}"), F.stddev_samp(f"f{i}").alias(f"s{i}"))]).first()
    each = F.array(*[F.struct(F.lit(str(factor)).alias("factor"), F.col(f"f{i}").alias("raw"), ((F.col(f"f{i}") - float(two[f"m{i}"] or 0.0)) / flat(two[f"s{i}"])).alias("score")) for i, factor in enumerate(of)])
    return wide.select(key, F.inline(each))


def projection_parameters(reference: DataFrame, signs: dict[str, int]) -> DataFrame:
    """variable, sign, mean, sd of the reference rows, and the raw score's mean and sd, by which others are scaled."""
    one = reference.agg(*[e for v in signs for e in (F.avg(F.col(v).cast("double")), F.stddev_samp(F.col(v).cast("double")))]).first()
    flat = lambda v: v if v is not None and v > 1e-12 else 1.0
    rows = [(v, s, float(one[2 * i] or 0.0), float(flat(one[2 * i + 1]))) for i, (v, s) in enumerate(signs.items())]
    raw = reduce(lambda a, b: a + b, [s * (F.col(v).cast("double") - m) / sd for v, s, m, sd in rows])
    two = reference.agg(F.avg(raw), F.stddev_samp(raw)).first()
    return reference.sparkSession.createDataFrame([(*r, float(two[0] or 0.0), float(flat(two[1]))) for r in rows], "variable string, sign int, mean double, sd double, raw_mean double, raw_sd double")


def project_scaled(target: DataFrame, parameters: DataFrame, key: str) -> DataFrame:
    """key, raw, score of target's rows under `projection_parameters` of others; null where a variable is null."""
    rows = parameters.collect()  # a row for each variable
    raw = reduce(lambda a, b: a + b, [r.sign * (F.col(r.variable).cast("double") - r.mean) / r.sd for r in rows])
    return target.select(key, raw.alias("raw")).withColumn("score", (F.col("raw") - rows[0].raw_mean) / rows[0].raw_sd)


def agreement(scores: DataFrame, other: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Correlation of two versions of a score, joined one to one, the rows that they share, and the greatest difference."""
    j = scores.select(*keys, F.col(score).alias("a")).join(other.select(*keys, F.col(score).alias("b")), keys)
    return j.agg(F.count("*").alias("n"), F.try_divide(F.covar_samp("a", "b"), F.stddev_samp("a") * F.stddev_samp("b")).alias("r"), F.max(F.abs(F.col("a") - F.col("b"))).alias("greatest_error"))


def sensitivity(df: DataFrame, samples: dict[str, Column], group: str, side: Column, values: list[str]) -> DataFrame:
    """sample, group, variable, difference: mean of the rows where `side` holds less that of the others, within each
    labelled sub-sample; every cell of the grid has a row, null where a side is empty."""
    flags = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in samples.items()])
    rows = df.select(F.col(group), side.alias("_side"), *values, F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("sample"))
    sums = long_form(rows, [group, "_side", "sample"], values).groupBy("sample", group, "variable").agg((F.avg(F.when(F.col("_side"), F.col("x"))) - F.avg(F.when(~F.col("_side"), F.col("x")))).alias("difference"))
    spark = df.sparkSession
    grid = spark.createDataFrame([(s, v) for s in samples for v in values], "sample string, variable string").crossJoin(F.broadcast(df.select(group).distinct()))  # labels, variables, groups
    return grid.join(sums, ["sample", group, "variable"], "left").select("sample", group, "variable", "difference")
