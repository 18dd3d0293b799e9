"""Joins with cardinality checks, derived columns and summary tables over samples, scores and loadings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys; a key that is missing on either side, repeated or null is an error that names a few."""
    sides = [d.groupBy(*keys).agg(F.count("*").alias(n)) for d, n in ((left, "_l"), (right, "_r"))]
    j = sides[0].join(sides[1], keys, "full_outer")
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    bad = j.where(null | ~(F.col("_l").eqNullSafe(1) & F.col("_r").eqNullSafe(1))).limit(10).collect()
    if bad:
        raise ValueError(f"not one to one: {[tuple(r) for r in bad]}")
    return left.join(right, keys)


def greatest_error(a: DataFrame, b: DataFrame, keys: list[str], value: str, most: float = 1e-9) -> float:
    """Greatest difference of a value that two tables hold under the same keys; over `most` it is an error."""
    j = one_to_one(a.select(*keys, F.col(value).alias("_a")), b.select(*keys, F.col(value).alias("_b")), keys)
    found = j.agg(F.max(F.abs(F.col("_a") - F.col("_b")))).first()[0] or 0.0
    if found > most:
        raise ValueError(f"{value} differs by {found}")
    return found


def mapped(df: DataFrame, column: str, pairs: dict, out: str) -> DataFrame:
    """Adds the partner of a column's value, null where there is none."""
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return df.withColumn(out, table[F.col(column)])


def labelled_union(tables: dict[str, DataFrame], label: str = "source") -> DataFrame:
    """Rows of all tables, by column name, with the name of their table."""
    out = None
    for name, d in tables.items():
        part = d.withColumn(label, F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def lexicon_union(a: DataFrame, b: DataFrame, features: list[str]) -> DataFrame:
    """Both lexicons; a feature of `features` without a term, another feature, or a repeated (feature, term) is an error."""
    out = a.unionByName(b)
    seen = out.groupBy("feature").agg(F.count("*").alias("n"), F.countDistinct("term").alias("d")).collect()  # a row a feature
    wrong = [r.feature for r in seen if r.n != r.d or r.feature not in features] + [f for f in features if f not in {r.feature for r in seen}]
    if wrong:
        raise ValueError(f"features missing, unknown or with repeated terms: {sorted(wrong)}")
    return out


def deviations(df: DataFrame, value: str, target: str, sd: str, limits: tuple[float, float, float]) -> DataFrame:
    """Adds relative_deviation, sd_deviation and three flags: beyond the limits of the first, of the second, of both."""
    off = F.abs(F.col(value) - F.col(target))
    d = df.withColumns({"relative_deviation": off / F.greatest(F.col(target), F.lit(1)), "sd_deviation": off / F.greatest(F.col(sd), F.lit(1))})
    far, wide = F.col("relative_deviation") > limits[0], F.col("sd_deviation") > limits[1]
    return d.withColumns({"far": far, "wide": wide, "out_of_range": far & wide | (F.col("relative_deviation") > limits[2])})


def override(pages: DataFrame, listed: DataFrame, key: str, verified: str, columns: list[str]) -> DataFrame:
    """pages with each of `columns` taken from their listing where that is verified and holds a value."""
    l = listed.select(key, F.col(verified).alias("_v"), *[F.col(c).alias(f"_{c}") for c in columns])
    take = lambda c: F.when(F.coalesce("_v", F.lit(False)) & (F.coalesce(F.col(f"_{c}"), F.lit("")) != ""), F.col(f"_{c}")).otherwise(F.col(c))
    return pages.join(l, key, "left").select(*[take(c).alias(c) if c in columns else F.col(c) for c in pages.columns])


def verified_pages(pages: DataFrame, listed: DataFrame, key: str, library: str, trail: list[str], stages: dict[str, list[str]], unknown: str = "unverified") -> DataFrame:
    """pages (key, breadcrumb, grade, genre, source, published) with what their listing (key, verified, grade, genre, day)
    tells: where that is verified, its grade and genre if told, a breadcrumb made of `trail` and both, and `library` as the
    source, with the page's own in brackets if that is another one. A page without a date takes its listing's. `stage` is the
    first of `stages` (name → terms) with a term in the breadcrumb, else `unknown`."""
    told = listed.select(key, F.coalesce("verified", F.lit(False)).alias("_v"), *[F.col(c).alias(f"_{c}") for c in ("grade", "genre", "day")])
    j = pages.join(told, key, "left").withColumn("_v", F.coalesce("_v", F.lit(False)))
    text = lambda c: F.coalesce(c, F.lit(""))
    take = lambda c: F.when(F.col("_v") & (text(F.col(f"_{c}")) != ""), F.col(f"_{c}")).otherwise(F.col(c))
    own = text(F.col("source"))
    source = F.when(F.col("_v"), F.when((own == "") | (own == library), library).otherwise(F.concat(F.lit(f"{library}（"), own, F.lit("）")))).otherwise(F.col("source"))
    crumb = F.when(F.col("_v"), F.concat_ws(" > ", *map(F.lit, trail), text(F.col("_grade")), text(F.col("_genre")))).otherwise(F.col("breadcrumb"))
    new = {"breadcrumb": crumb, "grade": take("grade"), "genre": take("genre"), "source": source, "published": F.when(text(F.col("published")) != "", F.col("published")).otherwise(F.col("_day"))}
    out = j.select(*[new[c].alias(c) if c in new else F.col(c) for c in pages.columns])
    stage = F.lit(unknown)
    for name, terms in reversed(stages.items()):
        found = F.lit(False)
        for t in terms:
            found = found | text(F.col("breadcrumb")).contains(t)
        stage = F.when(found, name).otherwise(stage)
    return out.withColumn("stage", stage)


def numbered(df: DataFrame, group: str, order: list, name: str = "filename", width: int = 3, salts: int = 64) -> DataFrame:
    """Adds `{group}_{number}` by order within the group. Counts and ranks are taken in ranges of the order, so that a few
    groups keep many tasks busy."""
    from quillmill.plans.prefix import range_offsets

    at = range_offsets(df, [group, *order], F.lit(1), "_at")
    first = at.groupBy(group).agg(F.min("_at").alias("_first"))
    j = at.join(F.broadcast(first), at[group].eqNullSafe(first[group])).drop(first[group])  # a row for each group
    return j.withColumn(name, F.concat(F.col(group), F.lit("_"), F.lpad((F.col("_at") - F.col("_first") + 1).cast("string"), width, "0"))).drop("_at", "_first")


def count_map(column: str, values: list) -> Column:
    """How many rows hold each value, 0 included, as a map."""
    return F.map_from_arrays(F.array(*[F.lit(v) for v in values]), F.array(*[F.count(F.when(F.col(column) == v, 1)) for v in values]))


def sampling_audit(df: DataFrame, group: str, length: str, tier: str, tiers: list, flag: Column, deviation: str) -> DataFrame:
    """Of each group: rows, mean and median length, rows of each tier, flagged ones, mean deviation."""
    counts = [F.count(F.when(F.col(tier) == t, 1)).alias(f"tier_{t}") for t in tiers]
    out = df.groupBy(group).agg(F.count("*").alias("n"), F.avg(length).alias("mean_length"), *counts, F.count(F.when(flag, 1)).alias("flagged"), F.avg(deviation).alias("mean_deviation"))
    return with_median(out, df, group, length).select(group, "n", "mean_length", "median_length", *[f"tier_{t}" for t in tiers], "flagged", "mean_deviation")


def with_median(summary: DataFrame, df: DataFrame, group: str, value: str, out: str = "median_length") -> DataFrame:
    """summary (a row for each group) with the median of df's values, told by distributed ranks: no group is one task's."""
    from quillmill.operators.statistics import quantiles

    q = quantiles(df.select(group, F.col(value).cast("double").alias("_x")), [group], "_x", [0.5]).select(F.col(group).alias("_g"), F.col("q")[0].alias(out))
    return summary.join(F.broadcast(q), F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")  # a row for each group


def mean_difference(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> Column:
    """Standardised by the root of the mean of both variances (0 with one row); 0 where nothing varies."""
    var = lambda n, v: F.when(n > 1, v).otherwise(0.0)
    pooled = F.sqrt((var(n1, v1) + var(n2, v2)) / 2)
    return F.when(pooled > 0, (m1 - m2) / pooled).otherwise(0.0)


def selection_summary(chosen: DataFrame, wanted: DataFrame, group: str, length: str, year: str, maps: dict[str, list]) -> DataFrame:
    """Of each group of `chosen`: rows, how many hold each value of the columns in `maps`, range of years, mean and median
    length, and the standardised difference of its lengths from those of `wanted`."""
    stats = lambda d, n: d.groupBy(group).agg(F.count("*").alias(f"n{n}"), F.avg(length).alias(f"m{n}"), F.var_samp(length).alias(f"v{n}"))
    c = chosen.groupBy(group).agg(F.count("*").alias("n"), *[count_map(k, v).alias(k) for k, v in maps.items()], F.min(year).alias("first_year"), F.max(year).alias("last_year"))
    j = with_median(c, chosen, group, length).join(stats(chosen, 1), group).join(stats(wanted, 2), group, "left")
    smd = F.when(F.col("n2").isNotNull(), mean_difference(*[F.col(x) for x in ("n1", "m1", "v1", "n2", "m2", "v2")]))
    return j.select(group, "n", *maps, "first_year", "last_year", F.col("m1").alias("mean_length"), "median_length", smd.alias("length_difference"))


def profile(df: DataFrame, by: list[list[str]], values: list[str]) -> DataFrame:
    """Means of the values by each list of columns, in one pass: columns that a list leaves out are null in its rows, and
    `level` tells the list's number."""
    keys = list(dict.fromkeys(c for b in by for c in b))
    g = df.groupingSets([[F.col(c) for c in b] for b in by], *[F.col(c) for c in keys]).agg(F.grouping_id().alias("_id"), *[F.avg(F.col(v).cast("double")).alias(v) for v in values])
    number = F.lit(None).cast("int")
    for i, b in enumerate(by):
        bits = sum(1 << (len(keys) - 1 - k) for k, c in enumerate(keys) if c not in b)
        number = F.when(F.col("_id") == bits, i).otherwise(number)
    return g.select(number.alias("level"), *keys, *values)


def main_loadings(loadings: DataFrame, factors: list) -> DataFrame:
    """(feature, factor, loading) → feature, a column for each factor, main (of the greatest |loading|) and its loading."""
    best = F.max_by(F.struct("factor", "loading"), F.struct(F.abs("loading"), F.col("factor")))
    g = loadings.groupBy("feature").agg(best.alias("m"), *[F.max(F.when(F.col("factor") == f, F.col("loading"))).alias(f"f{f}") for f in factors])
    return g.select("feature", *[f"f{f}" for f in factors], F.col("m.factor").alias("main"), F.col("m.loading").alias("main_loading"))


def top_loadings(loadings: DataFrame, least: float = 0.3, first: int = 6) -> DataFrame:
    """(factor, sign, place, feature, loading): the strongest positive and negative loadings of each factor."""
    d = loadings.where(F.abs("loading") >= least).withColumn("sign", F.signum("loading").cast("int"))
    w = Window.partitionBy("factor", "sign").orderBy(F.desc(F.abs("loading")), "feature")  # loadings are a small table
    return d.withColumn("place", F.row_number().over(w)).where(F.col("place") <= first).select("factor", "sign", "place", "feature", "loading")


def strongest(effects: DataFrame, effect: str, key: list[str], first: int, group: str | None = None, salts: int = 16) -> DataFrame:
    """The rows with the greatest |effect|, in each group or in all, ties by key; in two levels, so that few groups keep many
    tasks busy."""
    order = [F.desc(F.abs(effect)), *[F.asc(k) for k in key]]
    if group is None:
        return effects.orderBy(*order).limit(first)
    d = effects.withColumn("_s", F.pmod(F.xxhash64(*key), F.lit(salts)))
    for keys in ([group, "_s"], [group]):
        d = d.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= first)
    return d.drop("_r", "_s")


def representatives(scores: DataFrame, key: str, dimensions: list[str], points: dict[str, float]) -> DataFrame:
    """(dimension, pole, key, score): for each dimension and quantile in turn, the row nearest to it that stands for no
    earlier one (the nearest of all if none is left); ties go to the smaller key.

    Quantiles come from one aggregate; for each target Spark keeps as many nearest rows as there are targets, so the
    choice among them is the driver's. Null scores take no part.
    """
    targets = [(d, p, q) for d in dimensions for p, q in points.items()]
    row = scores.agg(*[F.percentile(d, F.array(*[F.lit(q) for q in points.values()])).alias(d) for d in dimensions]).first()
    goal = {(d, p): row[d][i] for d in dimensions for i, p in enumerate(points)}
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(d).cast("double").alias("score"), F.abs(F.col(d) - F.lit(goal[d, p])).alias("far")) for i, (d, p, _) in enumerate(targets) if goal[d, p] is not None])
    long = scores.select(F.col(key).alias("k"), F.inline(cells)).where("score is not null")
    near = long.withColumn("_s", F.pmod(F.xxhash64("k"), F.lit(32)))
    for extra in (["_s"], []):  # two levels: targets are few
        near = near.withColumn("r", F.row_number().over(Window.partitionBy("i", *extra).orderBy("far", "k"))).where(F.col("r") <= len(targets))
    near, used, out = sorted((r.i, r.far, r.k, r.score) for r in near.collect()), set(), []
    for i, (d, p, _) in enumerate(targets):
        mine = [x for x in near if x[0] == i]
        if mine:
            best = next((x for x in mine if x[2] not in used), mine[0])
            used.add(best[2])
            out.append((d, p, best[2], best[3]))
    kind = scores.schema[key].dataType.simpleString()
    return scores.sparkSession.createDataFrame(out, f"dimension string, pole string, {key} {kind}, score double")


def examples(df: DataFrame, group: str, order: list, text: str, cut: int = 18) -> DataFrame:
    """One row of each group, the first in order, with the start of its first sentence."""
    w = Window.partitionBy(group).orderBy(*order)
    sentence = F.regexp_extract(F.trim(F.coalesce(F.col(text), F.lit(""))), r"^[^.!?。！？\n]*[.!?。！？]?", 0)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").withColumn("excerpt", F.when(F.length(sentence) > cut, F.concat(F.substring(sentence, 1, cut), F.lit("…"))).otherwise(sentence))


def frequent(df: DataFrame, column: str, first: int = 15) -> DataFrame:
    """The most frequent values and their counts, ties by value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(first)


def screening_status(candidates: DataFrame, removed: DataFrame, kept: DataFrame, key: str = "feature") -> DataFrame:
    """candidates (key, status, reason, communality) with the chosen model's verdict: kept ones and removed ones take its
    status, reason and communality, others stay as they are."""
    r = removed.select(key, F.lit("removed").alias("_s"), F.col("reason").alias("_r"), F.col("communality").alias("_c"))
    k = kept.select(key, F.lit("kept").alias("_s"), F.lit(None).cast("string").alias("_r"), F.col("communality").alias("_c"))
    j = candidates.join(r.unionByName(k), key, "left")
    new = F.col("_s").isNotNull()
    return j.select(key, *[F.when(new, F.col(n)).otherwise(F.col(o)).alias(o) for n, o in (("_s", "status"), ("_r", "reason"))], F.coalesce("_c", "communality").alias("communality"))


def chosen_columns(df: DataFrame, info: list[str], dictionary: DataFrame, features: list[str]) -> list[str]:
    """info and, in df's order, the columns that `dictionary` (feature, columns joined by ;) names for the features."""
    named = {c.strip() for r in dictionary.where(F.col("feature").isin(features)).select("columns").collect() for c in (r[0] or "").split(";")}
    if missing := sorted(named - set(df.columns) - {""}):
        raise ValueError(f"columns not in the table: {missing}")
    return info + [c for c in df.columns if c in named and c not in info]


def direct_metrics(names: list[str], suffix: str, markers: list[str], dropped: list[str], category: dict[str, str], allowed: list[str]) -> list[str]:
    """Features that are rates or ratios by their name, in an allowed category and not in the drop list."""
    return [n for n in names if (n.endswith(suffix) or any(m in n for m in markers)) and n not in dropped and category.get(n) in allowed]


def serial_gaps(df: DataFrame, serial: str, expected: int) -> DataFrame:
    """(serial, n): numbers of 1 to expected that are missing (n = 0) or repeated, and others that should not be there."""
    have = df.groupBy(F.col(serial).cast("long").alias("serial")).agg(F.count("*").alias("n"))
    want = df.sparkSession.range(1, expected + 1).toDF("serial").withColumn("_w", F.lit(True))
    j = want.join(have, "serial", "full_outer")
    return j.where(~(F.col("n").eqNullSafe(1) & F.col("_w").isNotNull())).select("serial", F.coalesce("n", F.lit(0)).alias("n"))
