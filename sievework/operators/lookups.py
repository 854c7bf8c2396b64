"""Tiered lookups: candidates by the first of several keys that finds any, with a rule for ambiguous ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tiered_lookup(left: DataFrame, right: DataFrame, tiers: list[tuple[str, Column, Column]], left_id: str, right_id: str, fall_through: bool = False) -> DataFrame:
    """left_id, right_id, tier, status (matched, ambiguous, missing).

    tiers: (name, key of left, key of right); a null or empty key finds nothing. The first tier with a candidate
    decides; with fall_through the first tier with exactly one does. All tiers go through one join: both sides give a
    row per tier keyed by (tier, key), so left and right are each shuffled once. A key with many rows on the right is
    counted before the join, which therefore adds at most one row per tier and left row. Both joins grow with both
    tables, and Spark takes the size of well compressed files for that of their rows: they are asked for by merge, so that
    no such side is broadcast.
    """
    struct = lambda i, key: F.struct(F.lit(i).alias("t"), key.alias("k"))
    long = left.select(F.col(left_id).alias("left_id"), F.explode(F.array(*[struct(i, a) for i, (_, a, _) in enumerate(tiers)])).alias("x")).select("left_id", "x.*").filter("k <> ''")
    held = right.select(F.col(right_id).alias("right_id"), F.explode(F.array(*[struct(i, b) for i, (_, _, b) in enumerate(tiers)])).alias("x")).select("right_id", "x.*").filter("k <> ''")
    held = held.groupBy("t", "k").agg(F.count("*").alias("n"), F.min("right_id").alias("right_id"))
    found = long.join(held.hint("merge"), ["t", "k"])
    if fall_through:
        one = found.filter("n = 1").groupBy("left_id").agg(F.min_by(F.struct("t", "n", "right_id"), "t").alias("b"))
        rest = found.groupBy("left_id").agg(F.min_by(F.struct("t", "n", "right_id"), "t").alias("c"))
        best = rest.join(one.hint("merge"), "left_id", "left").select("left_id", F.coalesce("b", "c").alias("b"))
    else:
        best = found.groupBy("left_id").agg(F.min_by(F.struct("t", "n", "right_id"), "t").alias("b"))
    names = F.array(*[F.lit(n) for n, _, _ in tiers])
    out = left.select(F.col(left_id).alias("left_id")).join(best.hint("merge"), "left_id", "left")
    status = F.when(F.col("b").isNull(), "missing").when(F.col("b.n") == 1, "matched").otherwise("ambiguous")
    return out.select("left_id", F.when(F.col("b.n") == 1, F.col("b.right_id")).alias("right_id"), F.get(names, F.col("b.t")).alias("tier"), status.alias("status"))
