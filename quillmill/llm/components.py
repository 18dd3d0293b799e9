"""Connected components by alternating large-star and small-star rounds, all of it in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.plans.scratch import drop, materialize

#: Hub nodes spread over so many join keys.
SALTS = 16


def _lower_all(links: DataFrame) -> DataFrame:
    """links (u, v): rows with the smallest v of each u as m. The join is salted, since a hub may hold most links,
    and never broadcast: after explode, `low` is SALTS times the size that Spark estimates."""
    low = links.groupBy("u").agg(F.min("v").alias("m"))
    low = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(low.hint("merge"), ["u", "salt"]).drop("salt")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node long, root long) for every node with an edge; root is the smallest node reachable.

    edges: (a long, b long), any direction, repeats and loops allowed. Each round is written to the shared folder,
    so a lost executor costs one round at most. The only values that reach the driver are a count and a checksum.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now, seen = materialize(now, "links"), None
    while True:  # rounds grow with the logarithm of the longest path
        sign = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if sign == seen:
            break
        seen = sign
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lower_all(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = _lower_all(large)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        later = materialize(small.distinct(), "links")
        drop(now)
        now = later
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
