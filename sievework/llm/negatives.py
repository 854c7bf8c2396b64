"""Hard negatives by slot-decomposed selection.

Rows are scored against anchors by the integer inner product. An anchor's positives are the best rows of its label; each
positive p allows the negatives whose score lies between ``low`` and ``high`` percent of p's score. The upper limits of an
anchor's positives split scores into disjoint slots, and windows of different positives overlap only in whole slots. So
one pass keeps the best ``take`` rows of each slot, in every task and again after the shuffle; then the slots are merged from
the lowest up: the best of a window are the best of its slot followed by those of the slots below, cut at its lower
limit. No window is searched twice and no row that can't be in a result leaves its task.

Rows are quantised once into a table of the shared folder. Scores are matrix products of blocks: rows are dealt into
groups and anchors into blocks, and each task of the grid has one group and one block, of bounded size whatever the
table's; nothing is broadcast. Products are exact: in doubles below 2^53, else in Python's integers, cut off at the range of
a long.

Rows with a null id, label or vector, or with any null or non-finite component, take no part. Vectors meet only those of
their own length. Rows that are repeated are rows of their own, and may be given twice as positives or negatives; rows
with an anchor's id are no others of it, and equal anchors are one. Negative scores of positives allow nothing, a score
of zero allows zeros. Ties go to the smaller id. An empty table gives no rows; columns besides the three are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.llm.common import table, written

POSITIVES, TAKE, LOW, HIGH = 5, 10, 30, 90
#: Components are multiplied by this and rounded down.
SCALE = 256
#: Components of vectors in a group of rows, and in a block of anchors; scores that are worked at once.
GROUP, BLOCK, AT_ONCE = 1 << 22, 1 << 18, 1 << 21
#: Groups at least, so that small tables keep all cores busy.
SPREAD = 24
EXACT = 1 << 53


def quantised(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, q) of the rows that take part; rows: vec_id, label, embedding."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    part = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound
    q = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v))
    return rows.filter(part).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), q.alias("q"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer products (anchors x rows)."""
    if not anchors.shape[1]:
        return np.zeros((len(anchors), len(rows)), np.int64)
    most = float(np.abs(anchors.astype(float)).max(initial=0)) * float(np.abs(rows.astype(float)).max(initial=0)) * anchors.shape[1]
    if most < EXACT:
        return (anchors.astype(float) @ rows.astype(float).T).astype(np.int64)
    return np.clip(anchors.astype(object) @ rows.astype(object).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _best(key: np.ndarray, score: np.ndarray, vec_id: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first of each key, by score from the top, ties by id."""
    order = np.lexsort((vec_id, ~score, key))
    key = key[order]
    first = np.searchsorted(key, key)
    return order[np.arange(len(key)) - first < k]


class Kept:
    """The best rows of each key so far, and the score that a further one must reach."""

    def __init__(self, keys: int, k: int):
        self.k, self.least = k, np.full(keys, -(1 << 63), np.int64)
        self.key = self.score = self.vec_id = np.zeros(0, np.int64)

    def add(self, key: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        on = score >= self.least[key]
        key, score, vec_id = (np.concatenate(v) for v in ((self.key, key[on]), (self.score, score[on]), (self.vec_id, vec_id[on])))
        at = _best(key, score, vec_id, self.k)
        self.key, self.score, self.vec_id = key[at], score[at], vec_id[at]
        full = np.flatnonzero(np.bincount(self.key, minlength=len(self.least))[self.key] == self.k)
        self.least[self.key[full]] = np.minimum.reduceat(self.score[full], np.arange(0, len(full), self.k)).repeat(self.k) if len(full) else 0


def _steps(rows: int, anchors: int):
    """Growing slices of the rows: the first ones set the scores that later ones must reach."""
    at, size, most = 0, 64, max(64, AT_ONCE // max(anchors, 1))
    while at < rows:
        yield slice(at, at + size)
        at, size = at + size, min(2 * size, most)


def _grid(rows: DataFrame, anchors: DataFrame, schema: str, work) -> DataFrame:
    """work(anchors, rows) on each cell of groups of rows and blocks of anchors of one vector length."""
    found = rows.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(1))).first()
    wide = max(found[1], 1)
    per = max(1, min(GROUP // wide, -(-found[0] // SPREAD)))
    groups = max(1, -(-found[0] // per))
    blocks = max(1, -(-anchors.count() // max(1, BLOCK // wide)))
    spread = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), F.monotonically_increasing_id()), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("block", spread(blocks, 1)).withColumn("group", every(groups)).withColumn("size", F.size("q"))
    right = rows.withColumn("group", spread(groups, 2)).withColumn("block", every(blocks)).withColumn("size", F.size("q"))
    cell = ("group", "block", "size")
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(work, schema)


def positives(rows: DataFrame, anchors: DataFrame, k: int = POSITIVES) -> DataFrame:
    """(anchor, positive_id, score): the k best other rows of each anchor's label."""

    def work(a: pa.Table, r: pa.Table) -> pa.Table:
        held = Kept(a.num_rows, k)
        if a.num_rows and r.num_rows:
            left, right = _matrix(a["q"]), _matrix(r["q"])
            labels, own, ids, row_ids = (np.asarray(t[c]) for t, c in ((a, "label"), (r, "label"), (a, "vec_id"), (r, "vec_id")))
            # Rows meet the anchors of their label only.
            for label in np.intersect1d(labels, own):
                la, lr = np.flatnonzero(labels == label), np.flatnonzero(own == label)
                for part in _steps(len(lr), len(la)):
                    s = scores(left[la], right[lr[part]])
                    i, j = np.nonzero((s >= held.least[la][:, None]) & (ids[la][:, None] != row_ids[lr[part]][None, :]))
                    held.add(la[i], s[i, j], row_ids[lr[part]][j])
        return pa.table({"anchor": np.asarray(a["anchor"])[held.key], "positive_id": held.vec_id, "score": held.score})

    found = _grid(rows, anchors, "anchor long, positive_id long, score long", work)
    return _first(found, ["anchor"], "positive_id", k)


def _first(df: DataFrame, by: list[str], name: str, k: int) -> DataFrame:
    """The k first rows of each key, by score from the top, ties by id; tasks leave out others before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), name))
    return df.withColumn("__place", place).filter(F.col("__place") <= k).drop("__place")


def limits(score: Column, low: int = LOW, high: int = HIGH) -> tuple[Column, Column]:
    """The least and the largest score of a positive's negatives, exactly."""
    whole = score.cast("decimal(20,0)")
    return F.ceil(whole * low / 100).cast("long"), F.floor(whole * high / 100).cast("long")


def mine(rows: DataFrame, anchors: DataFrame, k: int = POSITIVES, take: int = TAKE, low: int = LOW, high: int = HIGH) -> DataFrame:
    """The hard negatives of the anchors among rows; both (vec_id, label, q), as quantised() gives them."""
    key = F.xxhash64("vec_id", "label", "q")
    rows = written(rows, "vectors")
    anchors = written(anchors.dropDuplicates(["vec_id", "label", "q"]).withColumn("anchor", key), "anchors")
    found = written(positives(rows, anchors, k), "positives")
    lower, upper = limits(F.col("score"), low, high)
    windows = found.withColumns({"lower": lower, "upper": upper}).filter("lower <= upper")
    slots = windows.groupBy("anchor").agg(F.array_sort(F.collect_set("upper")).alias("uppers"), F.min("lower").alias("floor"))
    slots = written(anchors.join(slots, "anchor"), "slots")

    def work(a: pa.Table, r: pa.Table) -> pa.Table:
        held = Kept(a.num_rows * (k + 1), take)
        if a.num_rows and r.num_rows:
            left, right = _matrix(a["q"]), _matrix(r["q"])
            labels, own, row_ids, least = (np.asarray(t[c]) for t, c in ((a, "label"), (r, "label"), (r, "vec_id"), (a, "floor")))
            uppers = np.full((a.num_rows, k), (1 << 63) - 1, np.int64)
            for i, u in enumerate(a["uppers"].to_pylist()):
                uppers[i, : len(u)] = u
            top = np.array([u[-1] for u in a["uppers"].to_pylist()], np.int64)
            for part in _steps(r.num_rows, a.num_rows):
                s = scores(left, right[part])
                i, j = np.nonzero((s >= least[:, None]) & (s <= top[:, None]) & (labels[:, None] != own[part][None, :]))
                value = s[i, j]
                slot = (value[:, None] > uppers[i]).sum(axis=1)  # the first upper limit that is not below the score
                held.add(i * (k + 1) + slot, value, row_ids[part][j])
        return pa.table({"anchor": np.asarray(a["anchor"])[held.key // (k + 1)], "slot": (held.key % (k + 1)).astype(np.int32), "negative_id": held.vec_id, "score": held.score})

    kept = _first(_grid(rows, slots, "anchor long, slot int, negative_id long, score long", work), ["anchor", "slot"], "negative_id", take)
    # From the lowest slot up: the best of a slot, then the best of those below.
    best = F.struct((-F.col("score").cast("decimal(20,0)")).alias("down"), F.col("negative_id").alias("id"), F.col("score").alias("score"))
    of_anchor = kept.groupBy("anchor", "slot").agg(F.array_sort(F.collect_list(best)).alias("best")).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "best"))).alias("by_slot"))
    held = slots.select("anchor", F.col("vec_id").alias("anchor_id"), "uppers").join(of_anchor, "anchor")
    none = F.filter(F.array(F.struct(F.lit(0).cast("decimal(20,0)").alias("down"), F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("score"))), lambda _: F.lit(False))
    merged = F.lit(None)
    for slot in range(k):
        below = none if slot == 0 else F.get(F.col("merged"), F.lit(slot - 1))
        merged = F.slice(F.concat(F.coalesce(F.try_element_at("by_slot", F.lit(slot)), none), below), 1, take)
        held = held.withColumn("merged", F.array(merged) if slot == 0 else F.concat("merged", F.array(merged)))
    asked = windows.join(held, "anchor").withColumn("window", F.get("merged", (F.array_position("uppers", F.col("upper")) - 1).cast("int")))
    asked = asked.select("anchor_id", "positive_id", F.col("score").alias("positive_score"), F.posexplode(F.filter("window", lambda x: x["score"] >= F.col("lower"))).alias("at", "r"))
    return asked.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("r.id").alias("negative_id"), "positive_score", F.col("r.score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, rows.filter(F.col("vec_id") % 100 == 0))


ORACLE = f"""
WITH q AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
    list_sum(list_transform(list_zip(a.q, r.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM q a JOIN q r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= {TAKE}
"""
