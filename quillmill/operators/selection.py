"""Candidate merging, quotas, balanced and matched sampling, alignment and quality checks."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_candidates(df: DataFrame, keys: list[str], score: str, arrival: str) -> DataFrame:
    """The row with the highest score of each key; of equal ones the first to arrive."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), arrival)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def first_valid(df: DataFrame, group: str, valid: str, order: list, desired: int, salts: int = 16) -> DataFrame:
    """The first `desired` valid rows of each group in `order`, in two levels, so that few groups keep many tasks busy."""
    d = df.where(F.col(valid)).withColumn("_s", F.pmod(F.xxhash64(*[c for c in df.columns]), F.lit(salts)))
    for keys in ([group, "_s"], [group]):
        d = d.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= desired)
    return d.drop("_s")


def scanned_pools(df: DataFrame, group: str, valid: str, order: list, desired: int, groups: list, salts: int = 16) -> DataFrame:
    """df with kept, of the rows that a scan in `order` sees before it has enough valid ones: groups are scanned in the
    order of `groups`, and what is enough shrinks to the fewest valid ones that an earlier group had."""
    have = {r[0]: r[1] for r in df.where(F.col(valid)).groupBy(group).count().collect()}  # a row for each group
    enough, limits = desired, []
    for g in groups:
        limits.append((g, enough))
        enough = min(enough, have.get(g, 0))
    table = F.create_map(*[F.lit(x) for gl in limits for x in gl])
    picked = first_valid(df, group, valid, order, desired, salts).where(F.col("rank") <= table[F.col(group)])
    ends = picked.groupBy(group).agg(F.max(F.struct(*[F.struct(c.alias("x")).alias(f"o{i}") for i, c in enumerate(order)])).alias("_last"), F.count("*").alias("_n"))
    here = F.struct(*[F.struct(c.alias("x")).alias(f"o{i}") for i, c in enumerate(order)])
    j = df.where(F.col(group).isin(groups)).join(F.broadcast(ends), group, "left")  # a row for each group
    full = F.col("_n") >= table[F.col(group)]
    seen = F.col("_last").isNull() | ~F.coalesce(full, F.lit(False)) | (here <= F.col("_last"))
    return j.where(seen).withColumn("kept", F.col(valid) & (F.col("_last").isNotNull()) & (here <= F.col("_last"))).drop("_last", "_n")


def merge_sources(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Fold of candidates (score, verified, hint, backup) in source order: a backup loses, a verified one wins, a new
    hint beats none, else the strictly higher score wins."""
    row = F.struct(F.col(position).alias("p"), "score", "verified", "hint", "backup")
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def step(a, x):
        wins = F.when(x["backup"] != a["backup"], a["backup"]).when(x["verified"] != a["verified"], x["verified"]).when(x["hint"] & ~a["hint"], True).otherwise(x["score"] > a["score"])
        return F.when(wins, x).otherwise(a)

    return rows.select(*keys, F.aggregate(F.slice("rows", 2, F.greatest(F.lit(1), F.size("rows"))), F.col("rows")[0], step).alias("m")).select(*keys, "m.*")


def balanced_quota(counts: DataFrame, stratum: list[str], unit: str, sizes: DataFrame | int, seed: int = 42) -> DataFrame:
    """counts (stratum, unit, n), sizes (stratum, size) or one size → quota of each unit in each stratum.

    Strata are taken in the order of a seeded hash, and what a unit got in earlier ones counts against it. Within a
    stratum every unit gets one row, those with the least so far first; then the unit with the least of (so far + here,
    here, so far) gets the next, while it has rows; ties go by seeded hash. A stratum with fewer rows than its size gives
    all. Only the table of counts, a row for each stratum and unit, is walked through on the driver.
    """
    spark = counts.sparkSession
    order = F.xxhash64(*stratum, F.lit(seed))
    rows = counts.where("n > 0").select(*stratum, unit, "n", order.alias("_o"), F.xxhash64(*stratum, unit, F.lit(seed)).alias("_t"))
    rows = rows.withColumn("_size", F.lit(sizes)) if isinstance(sizes, int) else rows.join(sizes.select(*stratum, F.col("size").alias("_size")), stratum)
    taken: dict = {}
    groups: dict = {}
    for r in rows.collect():
        groups.setdefault((r["_o"], tuple(str(r[c]) for c in stratum)), []).append(r)
    out = []
    for _, rs in sorted(groups.items()):
        size, so_far = min(rs[0]["_size"], sum(r["n"] for r in rs)), {r[unit]: taken.get(r[unit], 0) for r in rs}
        first = sorted(rs, key=lambda r: (so_far[r[unit]], r["_t"], str(r[unit])))[:size]
        here = {r[unit]: 1 for r in first}
        place = lambda r: (so_far[r[unit]] + here[r[unit]], here[r[unit]], so_far[r[unit]], r["_t"], str(r[unit]))  # noqa: E731, B023
        waiting = [(place(r), i) for i, r in enumerate(first) if here[r[unit]] < r["n"]]
        heapq.heapify(waiting)
        for _ in range(size - len(here)):
            i = waiting[0][1]
            here[first[i][unit]] += 1
            if here[first[i][unit]] < first[i]["n"]:
                heapq.heapreplace(waiting, (place(first[i]), i))
            else:
                heapq.heappop(waiting)
        for r in first:
            taken[r[unit]] = taken.get(r[unit], 0) + here[r[unit]]
            out.append((*[r[c] for c in stratum], r[unit], here[r[unit]]))
    schema = ", ".join(f"{c} {counts.schema[c].dataType.simpleString()}" for c in [*stratum, unit])
    return spark.createDataFrame(out, f"{schema}, quota long")


def least_taken_first(counts: DataFrame, stratum: list[str], unit: str, size: int) -> DataFrame:
    """As `balanced_quota` for independent strata, without a walk: the units of a stratum take turns, the rarest over all
    strata first."""
    total = counts.groupBy(unit).agg(F.sum("n").alias("_all"))
    turns = counts.join(total, unit).withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(size)).cast("int"))))
    w = Window.partitionBy(*stratum).orderBy("k", "_all", unit)
    return turns.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= size).groupBy(*stratum, unit).agg(F.count("*").alias("quota"))


def draw(rows: DataFrame, quota: DataFrame, keys: list[str], row_id: str, seed: int = 42) -> DataFrame:
    """`quota` rows of each key, by seeded hash."""
    w = Window.partitionBy(*keys).orderBy(F.xxhash64(F.col(row_id), F.lit(seed)), row_id)
    return rows.join(quota, keys).withColumn("_r", F.row_number().over(w)).where("_r <= quota").drop("_r", "quota")


def equal_sizes(df: DataFrame, score: str, group: str) -> DataFrame:
    """(score, n): the smallest count of the score over all groups of the full grid; a missing cell counts 0."""
    grid = df.select(score).distinct().crossJoin(df.select(group).distinct())  # two small dimensions
    counts = df.groupBy(score, group).count()
    return grid.join(counts, [score, group], "left").groupBy(score).agg(F.min(F.coalesce("count", F.lit(0))).alias("n"))


def quantile_targets(df: DataFrame, group: str, value: str, n: int) -> DataFrame:
    """n targets at (i + 0.5) / n, interpolated, halves to even."""
    from quillmill.operators.statistics import quantiles

    q = quantiles(df.select(group, F.col(value).cast("double").alias("_x")), [group], "_x", [(i + 0.5) / n for i in range(n)])
    return q.select(group, F.posexplode("q").alias("i", "x")).select(group, "i", F.bround(F.round("x", 6), 0).cast("long").alias("target"))


def align_columns(df: DataFrame, target: list[str], dynamic: str) -> DataFrame:
    """df with target's columns in order; missing ones that match `dynamic` become 0, any other difference is an error."""
    import re

    extra, missing = [c for c in df.columns if c not in target], [c for c in target if c not in df.columns]
    wrong = extra + [c for c in missing if not re.fullmatch(dynamic, c)]
    if wrong:
        raise ValueError(f"columns differ: {wrong}")
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(0).alias(c) for c in target])


def violations(df: DataFrame, checks: dict[str, str]) -> DataFrame:
    """(check, violations): rows for which each SQL condition does not hold; null counts as a violation."""
    row = df.agg(*[F.sum(F.when(F.coalesce(F.expr(c), F.lit(False)), 0).otherwise(1)).alias(k) for k, c in checks.items()])
    return row.unpivot([], list(checks), "check", "violations")


def table_checks(df: DataFrame, unique: list[list[str]] = (), equal: dict[str, tuple[str, str]] | None = None, sizes: list[str] = (), distributions: list[tuple[str, str]] = ()) -> DataFrame:
    """(check, violations): repeated keys, rows whose sums differ (name → two SQL expressions), groups of other sizes than
    the largest one, and groups whose distribution of another column is not that of all groups together."""
    parts = [df.groupBy(*k).count().where("count > 1").agg(F.lit("unique " + ", ".join(k)).alias("check"), F.count("*").alias("violations")) for k in unique]
    parts += [df.agg(F.lit(n).alias("check"), F.count(F.when(~F.coalesce(F.abs(F.expr(a) - F.expr(b)) <= 1e-9, F.lit(False)), 1)).alias("violations")) for n, (a, b) in (equal or {}).items()]
    for g in sizes:
        c = df.groupBy(g).count()
        parts.append(c.crossJoin(F.broadcast(c.agg(F.max("count").alias("_m")))).agg(F.lit(f"equal {g}").alias("check"), F.count(F.when(F.col("count") != F.col("_m"), 1)).alias("violations")))  # one row
    for g, v in distributions:
        cells, groups, values = df.groupBy(g, v).count(), df.groupBy(g).agg(F.count("*").alias("_g")), df.groupBy(v).agg(F.count("*").alias("_v"))
        grid = groups.crossJoin(values).join(cells, [g, v], "left").crossJoin(F.broadcast(df.agg(F.count("*").alias("_n"))))  # two small dimensions, one row
        bad = grid.where(F.coalesce("count", F.lit(0)) * F.col("_n") != F.col("_g") * F.col("_v")).select(g).distinct()
        parts.append(bad.agg(F.lit(f"{v} alike in {g}").alias("check"), F.count("*").alias("violations")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> bool:
    """Whether both tables hold the same set of keys."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return not x.exceptAll(y).limit(1).count() and not y.exceptAll(x).limit(1).count()
