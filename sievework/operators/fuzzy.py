"""Fuzzy best match on token sets within a block.

Only scores above ``min_score - gap`` matter. Two sets with such a score share one of the rarest tokens of each: with
tokens in one order of their frequency in the block, one of the first n - ceil(t n) + 1. So candidates are joined on
(block, token) by these alone, and a token that all names of a block carry joins nothing but small sets; then the score
is computed from the whole sets. No stop word is dropped, as the score needs all tokens. Both sides are first reduced
to their distinct sets, so a name that a third of all rows carry is one set. All joins are by merge: every side grows
with its table, whose size Spark guesses from compressed files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def similar_sets(ls: DataFrame, rs: DataFrame, least: float) -> DataFrame:
    """ls, rs, ls_size, rs_size, both of all pairs of sets (block, tokens, ls) and (block, tokens, rs) of one block whose
    common share is ``least`` or more, and of some below it; ls and rs name distinct sets."""
    often = rs.select("block", F.explode("tokens").alias("token")).groupBy("block", "token").agg(F.count("*").alias("often"))

    def prefixes(sets: DataFrame, name: str) -> DataFrame:
        long = sets.select("block", name, "tokens", F.explode("tokens").alias("token")).join(often.hint("merge"), ["block", "token"], "left")
        order = F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "token")))
        held = long.groupBy("block", name, "tokens").agg(order.alias("order"))
        first = F.slice("order", 1, (F.size("order") - F.ceil(F.size("order") * least) + 1).cast("int"))
        return held.select("block", name, F.size("tokens").alias(f"{name}_size"), F.explode(F.transform(first, lambda x: x["token"])).alias("token"))

    pairs = prefixes(ls, "ls").join(prefixes(rs, "rs").hint("merge"), ["block", "token"])
    fits = F.least("ls_size", "rs_size") >= least * F.greatest("ls_size", "rs_size")
    pairs = pairs.filter(fits).select("ls", "rs", "ls_size", "rs_size").distinct()
    pairs = pairs.join(ls.select("ls", F.col("tokens").alias("l")).hint("merge"), "ls").join(rs.select("rs", F.col("tokens").alias("r")).hint("merge"), "rs")
    return pairs.select("ls", "rs", "ls_size", "rs_size", F.size(F.array_intersect("l", "r")).alias("both"))


def best_fuzzy_match(left: DataFrame, right: DataFrame, min_score: float, gap: float, policy: str = "gap") -> DataFrame:
    """left (id, block, tokens) against right (id, block, tokens, name, url): left_id, right_id, score, status.

    The best score of at least min_score wins. Policies for others within the gap: 'gap' allows none, 'distinct_name'
    those of one name, 'distinct_url' those of one name or one URL. status: matched, ambiguous or none.
    """
    ls = left.select("block", "tokens").distinct().withColumn("ls", F.xxhash64("block", "tokens"))
    rs = right.select("block", "tokens").distinct().withColumn("rs", F.xxhash64("block", "tokens"))
    pairs = similar_sets(ls, rs, max(min_score - gap, 1e-6) - 1e-9)
    pairs = pairs.select("ls", "rs", (F.col("both") / (F.col("ls_size") + F.col("rs_size") - F.col("both"))).alias("score"))
    best = F.max("score").over(Window.partitionBy("ls"))
    near = pairs.withColumn("best", best).filter((F.col("best") >= min_score) & (F.col("best") - F.col("score") < gap))
    rows = right.select(F.xxhash64("block", "tokens").alias("rs"), F.col("id").alias("right_id"), "name", "url")
    found = near.join(rows.hint("merge"), "rs").groupBy("ls").agg(
        F.max("best").alias("score"), F.count("*").alias("n"), F.count_distinct("name").alias("names"), F.count_distinct("url").alias("urls"),
        F.max_by("right_id", F.struct("score", -F.col("right_id"))).alias("right_id"),
    )
    one = {"gap": F.col("n") == 1, "distinct_name": F.col("names") == 1, "distinct_url": (F.col("names") == 1) | (F.col("urls") == 1)}[policy]
    found = found.select("ls", F.when(one, F.col("right_id")).alias("right_id"), "score", F.when(one, "matched").otherwise("ambiguous").alias("status"))
    return left.select(F.col("id").alias("left_id"), F.xxhash64("block", "tokens").alias("ls")).join(found.hint("merge"), "ls", "left").select("left_id", "right_id", "score", F.coalesce("status", F.lit("none")).alias("status"))
