"""Slots filled by cost, and samples matched on length without replacement."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.plans.scratch import materialize

#: Rows of a range whose scores a task holds, at most, and iterations that it goes through with them.
HELD, BLOCK = 200_000, 50

# What a row without grade, of a grade without quota, or over its quota costs.
NO_GRADE, FREE_UNGRADED, UNGRADED_STEP = 0.16, 9, 2.0
NO_QUOTA, FULL, FULL_STEP = 0.12, 0.28, 0.08


#: What a row costs by topic tier and beyond the preferred stage; without a year; the most that years away
#: from the preferred ones cost, a year's part and how many count; the greatest topic score that counts, and its divisor.
TIER_COST = {"exact": 0.0, "near": 0.16, "extended": 0.38, "broad": 0.68}
OTHER_STAGE, NO_YEAR, MOST_YEARS, A_YEAR, YEARS, MOST_SCORE, SCORE_PART = 0.55, 0.20, 0.35, 0.02, 15, 140, 3000


def slot_cost(tier: Column, published: Column, preferred: Column, score: Column, first: int, last: int) -> Column:
    """What a row costs in any slot: by its topic tier, the years that its publication is away from those asked, its stage,
    and less for a high topic score. Rows of no known tier have no cost and can't be chosen: it is null."""
    from quillmill.functions.text import publication_year

    year = publication_year(published)
    years = F.when(year.between(first, last), 0.0).when(year == 9999, NO_YEAR).otherwise(F.least(F.lit(MOST_YEARS), A_YEAR * F.least(F.abs(year - last), F.lit(YEARS))))
    tiers = F.lit(None).cast("double")
    for name, c in TIER_COST.items():
        tiers = F.when(tier == name, c).otherwise(tiers)
    stage = F.when(F.coalesce(preferred, F.lit(False)), 0.0).otherwise(OTHER_STAGE)
    return tiers + years + stage - F.least(F.coalesce(score, F.lit(0)), F.lit(MOST_SCORE)) / SCORE_PART


def _cheapest(d: DataFrame, per: list[str], count: int, salts: int) -> DataFrame:
    """The `count` rows of least (c, key) of each class, in two salted levels."""
    d = d.withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(salts)))
    for extra in (["_salt"], []):
        d = d.withColumn("_r", F.row_number().over(Window.partitionBy(*per, *extra).orderBy("c", "key"))).where(F.col("_r") <= count)
    return d.drop("_r", "_salt")


def slot_candidates(pool: DataFrame, targets: DataFrame, group: str, key: str, length: str, cost: Column, preferred: Column, grade: Column, quotas: dict[str, int], count: int, salts: int = 16) -> DataFrame:
    """g, i, target, preferred, grade, key, n, c (cost with that of the length): for each target the `count` cheapest rows of
    each class (preferred, grade), which are all that its slot can take.

    Of rows of one class and length, the order is the same for every target, so `count` of each length are kept before any
    target is looked at. The pool is read once; only what is left, bounded by the different lengths, meets the targets.
    """
    known = F.when(grade.isNull(), "?").when(grade.isin(*quotas), grade).otherwise("other")
    p = pool.select(F.col(group).alias("g"), F.col(key).alias("key"), F.col(length).alias("n"), F.coalesce(cost, F.lit(0.0)).cast("double").alias("c"), F.coalesce(preferred, F.lit(False)).alias("preferred"), known.alias("grade"))
    t = targets.where(F.col("i") < count).groupBy(F.col(group).alias("g")).agg(F.collect_list(F.struct("i", "target")).alias("t"))
    few = _cheapest(p, ["g", "preferred", "grade", "n"], count, salts)
    d = few.join(t, "g").select("*", F.explode("t").alias("s")).select("g", "key", "n", "preferred", "grade", "s.i", "s.target", (F.col("c") + F.abs(F.col("n") - F.col("s.target")) / F.greatest("s.target", F.lit(1))).alias("c"))
    return _cheapest(d, ["g", "i", "preferred", "grade"], count, salts)


def select_slots(pool: DataFrame, targets: DataFrame, group: str, key: str, length: str, cost: Column, preferred: Column, grade: Column, quotas: dict[str, int], count: int, salts: int = 16) -> DataFrame:
    """(group, i, target, key): for each target (group, i, target) in order, the cheapest row left in the pool.

    A row costs `cost` + |length - target| / max(target, 1) + a penalty that depends on the grades taken so far; while
    enough preferred rows are left for the open slots, only those count. Ties go to the smaller key. That penalty is
    one constant for a (preferred, grade) class, so `slot_candidates` suffice, and what is left of a group has a fixed bound.
    """
    d = slot_candidates(pool, targets, group, key, length, cost, preferred, grade, quotas, count, salts)
    p = pool.select(F.col(group).alias("g"), F.coalesce(preferred, F.lit(False)).alias("preferred"))
    sizes = p.where("preferred").groupBy("g").agg(F.count("*").alias("rich"))
    d = d.join(sizes, "g", "left").na.fill(0, ["rich"])

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        taken, used, rich, out = {}, set(), int(rows["rich"].iloc[0]), []
        slots = rows[["i", "target"]].drop_duplicates().sort_values("i")

        def penalty(g: str) -> float:
            have = taken.get(g, 0)
            if g == "?":
                return NO_GRADE + max(0, have - FREE_UNGRADED) * UNGRADED_STEP
            if g == "other":
                return NO_QUOTA
            return FULL + (have - quotas[g]) * FULL_STEP if have >= quotas[g] else 0.0

        for i, target in slots.itertuples(index=False):
            here = rows[(rows["i"] == i) & ~rows["key"].isin(used)]
            if rich >= count - len(out):
                here = here[here["preferred"]]
            if here.empty:
                break
            total = here["c"] + here["grade"].map({g: penalty(g) for g in here["grade"].unique()})
            best = here.assign(total=total).sort_values(["total", "key"]).iloc[0]
            used.add(best["key"])
            taken[best["grade"]] = taken.get(best["grade"], 0) + 1
            rich -= bool(best["preferred"])
            out.append((best["g"], i, target, best["key"]))
        return pd.DataFrame(out, columns=["g", "i", "target", "key"])

    kinds = {f.name: f.dataType.simpleString() for f in d.schema}
    return d.groupBy("g").applyInPandas(fill, f"g {kinds['g']}, i int, target long, key {kinds['key']}").select(F.col("g").alias(group), "i", "target", F.col("key").alias(key))


def take_nearest(have: dict[int, int], order: list[int], draw: Callable[[int, int], bool]) -> dict[int, int]:
    """Rows taken of each length: every wanted length, in this order, takes the nearest length that is left; of two equally
    near ones the shorter if `draw` (rows left of the shorter, of the longer) says so. Stops when nothing is left."""
    left, sizes, taken = sorted(have), dict(have), {}
    for x in order:
        if not left:
            break
        at = bisect_left(left, x)
        if at == len(left):
            at -= 1
        elif at and left[at] != x:
            below, above = x - left[at - 1], left[at] - x
            if below < above or below == above and draw(sizes[left[at - 1]], sizes[left[at]]):
                at -= 1
        pick = left[at]
        taken[pick] = taken.get(pick, 0) + 1
        sizes[pick] -= 1
        if not sizes[pick]:
            del left[at]
    return taken


def match_lengths(have: dict[int, int], wanted: list[int], rng: np.random.Generator) -> dict[int, int]:
    """`take_nearest` in random order; of two equally near lengths each in proportion to its rows left."""
    order = rng.permutation(np.array(wanted, np.int64)).tolist()
    return take_nearest(have, order, lambda a, b: rng.random() * (a + b) < a)


def cut_ranges(have: np.ndarray, supply: np.ndarray, wanted: np.ndarray, demand: np.ndarray) -> np.ndarray:
    """Places in `have` (different lengths, in order, with their supply) where a range of its own begins, the first one's 0.

    Let p < q be neighbouring lengths, none wanted between them. If p runs out while nobody crosses, the lengths just below
    it have run out, too, down to some length that has not (or to the first one), and all that was taken of them was wanted
    above that length: demand there reached supply. So p never runs out if the surplus up to p (supply less demand) is
    above the surplus up to every shorter length and above 0; the same holds for q from the other end. Then what wants p
    or less never looks at q, and what wants q or more never at p, in whatever order they come: a range begins at q.
    """
    stock, total = np.cumsum(supply), np.concatenate([[0], np.cumsum(demand)])
    upto = total[np.searchsorted(wanted, have, side="right")]  # wanted up to each length
    below = np.r_[total[np.searchsorted(wanted, have, side="left")][1:], total[-1]]  # and below the next one
    surplus, short = stock - upto, stock - below
    before = np.maximum.accumulate(np.r_[0, surplus[:-1]])
    after = np.minimum.accumulate(short[::-1])[::-1]
    holds = (surplus > before)[:-1] & (surplus[:-1] < after[1:]) & (upto == below)[:-1]
    return np.r_[0, np.flatnonzero(holds) + 1]


def _ranges(rows: pd.DataFrame) -> pd.DataFrame:
    """One group's histograms (g, n, have, want) → its ranges: g, at (first length), n, have, want."""
    rows = rows.sort_values("n")
    n, have, want = rows["n"].to_numpy(), rows["have"].to_numpy(), rows["want"].to_numpy()
    known, asked = np.flatnonzero(have > 0), np.flatnonzero(want > 0)
    if not len(known) or not len(asked):
        return pd.DataFrame(columns=["g", "at", "n", "have", "want"])
    if want.sum() >= have.sum():  # all is taken, in any order
        parts = [np.array([i]) for i in known]
        want = have
    else:
        starts = cut_ranges(n[known], have[known], n[asked], want[asked])
        edges = np.searchsorted(n, n[known][starts][1:])
        parts = [p for p in np.split(np.arange(len(n)), edges) if want[p].any()]
    return pd.DataFrame([(rows["g"].iloc[0], int(n[p[0]]), n[p].tolist(), have[p].tolist(), want[p].tolist()) for p in parts], columns=["g", "at", "n", "have", "want"])


def _runs(n: np.ndarray, have: np.ndarray, want: np.ndarray, at: int, it: int, seed: int) -> tuple[np.ndarray, ...]:
    """One iteration of a range: the lengths taken, in order, their rows, and the run of them that is taken: its first row
    and how many."""
    some, asked = have > 0, int(want.sum())
    if asked >= have.sum():  # all is taken, wherever a run begins
        return n[some], have[some], np.zeros(some.sum(), np.int64), have[some]
    rng = np.random.default_rng([seed, it, at & 0xFFFFFFFF, len(n), asked & 0xFFFFFFFF])
    if some.sum() == 1:
        lengths, size = n[some], have[some]
        c = np.minimum(size, asked)
    else:
        taken = match_lengths(dict(zip(n[some].tolist(), have[some].tolist())), np.repeat(n, want), rng)
        lengths = np.array(sorted(taken), np.int64)
        size, c = have[np.searchsorted(n, lengths)], np.array([taken[x] for x in lengths.tolist()], np.int64)
    return lengths, size, rng.integers(0, size), c


def length_matched(pool: DataFrame, wanted: DataFrame, group: str, key: str, length: str, score: str, iterations: int = 1000, seed: int = 20260830) -> DataFrame:
    """(group, difference, sd, low, high, length_gap, iterations): mean score of wanted minus that of a pool sample
    matched on length, over random orders.

    Matching sees only histograms of lengths, a row for each different length of a group. A group's histogram is cut into
    ranges that no match crosses (`cut_ranges`); each range and BLOCK iterations are a row, so one large group is the work of many
    tasks. A range of one length is a count; only where lengths run short are its wanted rows gone through one by one. Rows
    of one length stand in one hashed order; an iteration takes a run of them from a random start, around the end, whose
    sum is two lookups in prefix sums. A range of up to HELD rows has its scores with it, and what leaves the task is one row for
    an iteration; of larger ones the runs leave it and are joined with prefix sums. Rows with a null group, length or score take no part.
    """
    clean = lambda d: d.select(F.col(group).alias("g"), F.col(key).alias("key"), F.col(length).cast("long").alias("n"), F.col(score).cast("double").alias("x")).dropna()
    a, b = clean(pool), clean(wanted)
    kind = a.schema["g"].dataType.simpleString()
    sides = a.select("g", "n", F.lit(1).alias("h"), F.lit(0).alias("w")).unionByName(b.select("g", "n", F.lit(0).alias("h"), F.lit(1).alias("w")))
    histograms = sides.groupBy("g", "n").agg(F.sum("h").alias("have"), F.sum("w").alias("want"))
    ranges = materialize(histograms.groupBy("g").applyInPandas(_ranges, f"g {kind}, at long, n array<long>, have array<long>, want array<long>"), "length-ranges")
    rows = F.aggregate("have", F.lit(0).cast("long"), lambda t, x: t + x)
    ranges = ranges.withColumn("fits", rows <= HELD)

    def runs(d: pd.DataFrame):
        for g, at, n, have, want, block, x in d[["g", "at", "n", "have", "want", "block", "x"]].itertuples(index=False):
            n, have, want = (np.asarray(v, np.int64) for v in (n, have, want))
            for it in range(block * BLOCK + 1, min(iterations, (block + 1) * BLOCK) + 1):
                yield g, it, n, have, x, _runs(n, have, want, int(at), it, seed)

    def sums(batches):
        """Ranges with their scores: what an iteration takes of them."""
        for d in batches:
            out = []
            for g, it, n, have, x, (lengths, size, start, c) in runs(d):
                upto = np.concatenate([[0.0], np.cumsum(x)])
                first = (np.cumsum(have) - have)[np.searchsorted(n, lengths)]
                end = start + c
                s = upto[first + np.minimum(end, size)] - upto[first + start] + upto[first + np.maximum(end - size, 0)] - upto[first]
                out.append((g, it, float(s.sum()), int(c.sum()), int((lengths * c).sum())))
            yield pd.DataFrame(out, columns=["g", "iteration", "s", "c", "chars"])

    def picked(batches):
        """Ranges of too many rows for that: the runs."""
        for d in batches:
            for g, it, _, _, _, (lengths, size, start, c) in runs(d):
                yield pd.DataFrame({"g": [g] * len(c), "iteration": it, "n": lengths, "size": size, "start": start, "c": c})

    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-iterations // BLOCK) - 1)))
    parts = int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes and much work: without a number, they'd be merged into few tasks
    dealt = lambda d: d.withColumn("block", blocks).repartition(parts, "g", "at", "block")
    lengths = ranges.where("fits").select("g", "at", F.explode(F.arrays_zip("n", "have")).alias("z")).where("z.have > 0").select("g", "at", "z.n")
    held = a.join(lengths.hint("merge"), ["g", "n"]).groupBy("g", "at").agg(F.array_sort(F.collect_list(F.struct("n", F.xxhash64("key", F.lit(seed)).alias("h"), "key", "x"))).alias("held"))
    held = held.select("g", "at", F.transform("held", lambda r: r["x"]).alias("x"))
    taken = dealt(materialize(ranges.where("fits").join(held.hint("merge"), ["g", "at"]), "length-scores")).mapInPandas(sums, f"g {kind}, iteration int, s double, c long, chars long")

    large = ranges.where("not fits")
    picks = dealt(large.withColumn("x", F.lit(None).cast("array<double>"))).mapInPandas(picked, f"g {kind}, iteration int, n long, size long, start long, c long")
    order = Window.partitionBy("g", "n").orderBy(F.xxhash64("key", F.lit(seed)), "key")
    some = a.join(large.select("g", F.explode("n").alias("n")).hint("merge"), ["g", "n"], "left_semi")
    upto = some.select("g", "n", F.row_number().over(order).cast("long").alias("r"), F.sum("x").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    # a run is prefix(end) - prefix(start), plus the whole and the prefix of what goes around
    end = F.col("start") + F.col("c")
    term = lambda r, sign: F.struct(r.cast("long").alias("r"), F.lit(sign).alias("sign"))
    around = end > F.col("size")
    terms = F.array(term(F.least(end, F.col("size")), 1), term(F.col("start"), -1), term(F.when(around, end - F.col("size")).otherwise(0), 1))
    looked = picks.select("g", "iteration", "n", F.explode(terms).alias("t")).select("g", "iteration", "n", "t.r", "t.sign").where("r > 0").join(upto, ["g", "n", "r"])
    looked = looked.groupBy("g", "iteration").agg(F.sum(F.col("sign") * F.col("s")).alias("s")).join(picks.groupBy("g", "iteration").agg(F.sum("c").alias("c"), F.sum(F.col("n") * F.col("c")).alias("chars")), ["g", "iteration"])
    if large.limit(1).count():
        taken = taken.unionByName(looked)
    whole = taken.groupBy("g", "iteration").agg(F.sum("s").alias("s"), F.sum("c").alias("c"), F.sum("chars").alias("chars"))
    mean = b.groupBy("g").agg(F.avg("x").alias("mx"), F.avg("n").alias("mn"))
    d = whole.join(mean, "g").select("g", (F.col("mx") - F.col("s") / F.col("c")).alias("d"), (F.col("mn") - F.col("chars") / F.col("c")).alias("gap"))
    return d.groupBy(F.col("g").alias(group)).agg(F.avg("d").alias("difference"), F.stddev_samp("d").alias("sd"), F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"), F.avg("gap").alias("length_gap"), F.count("*").alias("iterations"))
