"""Mixing sources to target weights along a time-varying curriculum.

Each source gets a share of the word budget by its weight, at most ``cap`` times its own size; what a capped
source cannot use is shared again by weight until no source is above its cap. Within a source documents are
taken whole in an order of hashes, pass after pass; the document at which the target is reached gives the words
that are still missing, so a source's words meet its target to the word.

A source's share of the stream changes with training time t in [0, 1] as a schedule that goes straight from a to
b (a + b = 2, so that it integrates to 1): it has given D(t) = a t + (b - a) t^2 / 2 of its words by t. The
stream has every copy at the inverse of D at the middle of the words that the copy adds, pass after pass, and is
range-sorted by it. The position that op4 reports (its SQL defines it) is the inverse of D within one pass: the first
copy's only where the target is at most the source's size, and no place in the stream where it is larger.

The cumulative sums run in two steps, over hash ranges within a source and then within one range, so that a
source with a third of all rows is no single task: no window sees more than about ``per_range`` documents. The hash is
of id and text, so that texts without an id, or under one, spread too; only rows that are equal in both stay together.

A null or blank text has size 0, takes 0 words and has no position; documents beyond their source's target too.
Null sources are one source, last in order. Rows with the same id and text share a hash; their order is then
immaterial, as they are equal. Very long texts count whole. Columns named as the added ones are replaced, others kept.
Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.llm.common import cut, doc_key, maybe_broadcast, set_aside, table, without, word_count

WEIGHTS = (5, 2, 1)
BUDGET_PERCENT = 150
CAP = 2
#: Documents in one hash range of a source, about.
PER_RANGE = 5_000
#: Schedules by the source's rank: early, steady, late. Start and end add to 2.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
ADDED = ("size", "source_size", "target", "taken", "copies", "position")
#: What places the copies of a document; only the stream uses these.
PLACE = ("before", "whole", "last", "goal", "starts", "ends", "mix_hash", "mix_tie")


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source (source, source_size) -> weight, target, schedule. Water-filling in closed form: in the
    order of cap over weight, sources are capped as long as the level of the rest is above their cap."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    rank = F.row_number().over(by_name) - 1
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (rank % len(values)).cast("int") + 1)
    ranked = sizes.select(
        "source", "source_size", pick(WEIGHTS).alias("weight"), pick([a for a, _ in SCHEDULES]).alias("starts"), pick([b for _, b in SCHEDULES]).alias("ends")
    ).withColumn("cap", F.col("source_size") * CAP)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, every = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(every) * BUDGET_PERCENT / 100 - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    free = ranked.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    #: Past the first free source all are free, at its level.
    level = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, 0))
    target = F.coalesce(level * F.col("weight"), F.col("cap").cast("double"))
    return free.select("source", "source_size", "starts", "ends", target.alias("target"), F.round(target).cast("long").alias("goal"))


def inverse(done: Column, starts: Column, ends: Column) -> Column:
    """Inverse of starts * t + (ends - starts) * t^2 / 2 at a share of the source's words."""
    bend = ends - starts
    curved = (F.sqrt(starts * starts + F.lit(2.0) * bend * done) - starts) / bend
    return F.when(bend == 0, done / starts).otherwise(curved)


def position(done: Column, starts: Column, ends: Column) -> Column:
    return F.round(inverse(done, starts, ends), 9)


def _placed(docs: DataFrame, per_range: int) -> DataFrame:
    """docs with their columns of ADDED and what places a copy: PLACE."""
    ranges = max(1, -(-docs.count() // per_range))
    share = F.conv(F.substring(F.col("mix_hash"), 1, 7), 16, 10).cast("long")
    sized = docs.withColumns({"size": word_count("text"), "mix_hash": F.md5(F.concat(doc_key(), F.lit("|"), F.coalesce("text", F.lit("")))), "mix_tie": F.xxhash64("doc_id", "text")})
    sized = sized.withColumn("mix_range", F.floor(share * ranges / F.lit(16**7)).cast("long"))
    # One row per source and range; this is all that is gathered before documents are placed.
    parts = cut(sized.groupBy("source", "mix_range").agg(F.sum("size").alias("words")))
    goals = source_targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")))
    ahead = F.sum("words").over(Window.partitionBy("source").orderBy("mix_range")) - F.col("words")
    starts = parts.withColumn("ahead", ahead).alias("p").join(goals.alias("g"), F.expr("p.source <=> g.source"))
    starts = cut(starts.select(F.col("p.source").alias("mix_source"), F.col("mix_range").alias("mix_part"), "ahead", "source_size", "starts", "ends", "target", "goal"))
    order = Window.partitionBy("source", "mix_range").orderBy("mix_hash", "size", "mix_tie")
    inner = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    few = maybe_broadcast(starts, starts.count())
    placed = sized.withColumn("inner", inner).join(few, F.expr("source <=> mix_source AND mix_range = mix_part"))
    before, size, goal, total = F.col("ahead") + F.col("inner"), F.col("size"), F.col("goal"), F.col("source_size")
    whole = F.when(total > 0, F.floor(goal / total)).otherwise(0).cast("long")
    last = F.greatest(F.lit(0), F.least(size, goal - whole * total - before)).cast("long")
    taken = whole * size + last
    middle = (before + F.when(whole > 0, size).otherwise(last) / F.lit(2.0)) / F.when(whole > 0, total).otherwise(goal)
    added = {
        "before": before,
        "whole": whole,
        "last": last,
        "taken": taken,
        "copies": F.when(size > 0, whole + F.when(last > 0, 1).otherwise(0)).otherwise(0).cast("int"),
        "position": F.when(taken > 0, position(middle, F.col("starts"), F.col("ends"))),
    }
    return placed.withColumns(added).select(*[F.col(f"`{c}`") for c in docs.columns], *ADDED, *PLACE)


def assign(docs: DataFrame, per_range: int = PER_RANGE) -> DataFrame:
    """docs (doc_id, text, source and others) with size, source_size, target, taken, copies and position."""
    docs, own = set_aside(without(docs, *ADDED), *PLACE)
    return _placed(docs, per_range).select(*own, *ADDED)


def copies(docs: DataFrame, per_range: int = PER_RANGE) -> DataFrame:
    """A row per copy that the mix takes, with mix_pass (from 0), the words it adds (mix_words) and its place t (mix_at)."""
    stream = _placed(docs, per_range).filter("copies > 0").withColumn("mix_pass", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    stream = stream.withColumn("mix_words", F.when(F.col("mix_pass") < F.col("whole"), F.col("size")).otherwise(F.col("last")))
    done = (F.col("mix_pass") * F.col("source_size") + F.col("before") + F.col("mix_words") / F.lit(2.0)) / F.col("goal")
    return stream.withColumn("mix_at", inverse(done, F.col("starts"), F.col("ends")))


def mix(docs: DataFrame, per_range: int = PER_RANGE) -> DataFrame:
    """The training stream: the columns of docs, each document as many times as the mix takes it, in order of position."""
    held, back = set_aside(docs, *ADDED, *PLACE, "mix_pass", "mix_words", "mix_at")
    order = ("mix_at", "mix_hash", "mix_tie")
    return copies(held, per_range).repartitionByRange(*order).sortWithinPartitions(*order).select(*back)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _placed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), PER_RANGE).select("doc_id", *ADDED, F.col("mix_tie").alias("tie"))
    # Id and hash split the documents without a position, which the mix does not take, over tasks.
    return placed.repartitionByRange("position", "doc_id", "tie").sortWithinPartitions("position", "doc_id", "tie").drop("tie")


_PICK = lambda values: f"list_extract([{', '.join(map(str, values))}], ((rank % {len(values)}) + 1)::INT)"
ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS h,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM totals
), weighed AS (
  SELECT source, source_size, {_PICK(WEIGHTS)} AS weight, {_PICK([f"{a}::DOUBLE" for a, _ in SCHEDULES])} AS a,
         {_PICK([f"{b}::DOUBLE" for _, b in SCHEDULES])} AS b, source_size * {CAP} AS cap FROM ranked
), levels AS (
  SELECT *, (sum(source_size) OVER () * {BUDGET_PERCENT} / 100 - coalesce(sum(cap) OVER before, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level FROM weighed
  WINDOW before AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goals AS (
  SELECT source, source_size, a, b, CASE WHEN l.level IS NULL THEN cap::DOUBLE ELSE l.level * weight END AS target FROM (
    SELECT *, first_value(CASE WHEN level * weight <= cap THEN level END IGNORE NULLS) OVER (
      ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lv FROM levels) x,
    LATERAL (SELECT x.lv AS level) l
), placed AS (
  SELECT s.doc_id, s.size, g.*, round(target)::BIGINT AS goal,
         (sum(size) OVER (PARTITION BY s.source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS before
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
), filled AS (
  SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS whole FROM placed
), counted AS (
  SELECT *, greatest(0, least(size, goal - whole * source_size - before)) AS last FROM filled
), middles AS (
  SELECT *, whole * size + last AS taken,
         (before + CASE WHEN whole > 0 THEN size ELSE last END / 2.0::DOUBLE) / nullif(CASE WHEN whole > 0 THEN source_size ELSE goal END, 0) AS m
  FROM counted
)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
       (CASE WHEN size > 0 THEN whole + CASE WHEN last > 0 THEN 1 ELSE 0 END ELSE 0 END)::INTEGER AS copies,
       CASE WHEN taken > 0 THEN round(CASE WHEN b = a THEN m / a ELSE (sqrt(a * a + 2.0::DOUBLE * (b - a) * m) - a) / (b - a) END, 9) END AS position
FROM middles
"""
