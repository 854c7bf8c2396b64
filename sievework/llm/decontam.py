"""Benchmark decontamination by SimHash of item-sized windows.

A window is as many words of a document as a benchmark item has; a shorter document is one window. Its SimHash (64
bits over its distinct shingles of five words) is cut into ``BLOCKS`` blocks with limits that add up, one more each, to
RADIUS + 1: two fingerprints within RADIUS lie within the limit in at least one block. Items are stored under every
value within the limit of each of their blocks, so the join on (item size, block, value) finds every item within the
radius of a window. Each pair found is measured exactly: the weighted Jaccard similarity of the two shingle sets, a
shingle weighing ln(1 + items / items that hold it), or ln(1 + items) where none does; a window that reaches SIMILARITY
is a leak. In the SimHash a shingle counts with the square root of that weight: then the cosine of two sets of
similarity J is at least 2 J / (1 + J), whatever the weights, and the radius fits the measured similarity.

Every start of a window counts, however words were inserted or taken out. Two bounds leave out, before any fingerprint,
windows that reach the similarity with no item: what a window shares with an item is at most the weight of its
shingles that any item of its size holds, and must be SIMILARITY times the least weight of such an item. As starts
move, this weight only changes where such a shingle enters or leaves, so it is a running sum over those events, for
each text and item size. The heavy part is thus one hash and one probe per word of the corpus; equal texts are worked
once. Everything is DataFrame expressions, and documents are never shuffled. Tables of the benchmark are broadcast
behind a check of their row counts (rows of a few dozen bytes).

Words are runs of anything but ASCII white space, A-Z lowered. Items and windows of fewer than five words are one
shingle. Null or blank texts and items match nothing; empty tables give an empty result. Rows with the same id are
one document: its best window for each item is reported, the first one of equals; so are documents without an id.
Repeated rows of the benchmark are one item; different texts under one item_id are items that are reported under it.
Other columns are not read.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.llm.common import SHINGLE, SIMILARITY, cut, let, maybe_broadcast, table, words

#: Windows of similarity 0.8 have a distance of about 10 of 64 bits; 19 is more than three deviations above.
RADIUS, BITS = 19, 64
#: Seven blocks of nine bits: an unrelated item meets a window in one of them with a chance of 0.44; an item has 287 rows.
BLOCKS = 7
#: Weights in whole millionths, so that running sums are exact.
MICRO = 1_000_000


def shingles(tokens: Column, k: int) -> Column:
    """Hashes of k words in a row; null where there are fewer."""
    at = lambda t: F.transform(F.sequence(F.lit(0), F.size(t) - k), lambda i: F.xxhash64(*[F.get(t, i + j) for j in range(k)]))
    return let(tokens, lambda t: F.when(F.size(t) >= k, at(t)))


def fingerprint(weights: Column) -> Column:
    """SimHash of a set of (hash, weight): the bits that more than half of the roots of the weights have set. Whole
    numbers, so that the order of the set doesn't matter."""
    zero = F.lit(0).cast("long")

    def code(held: Column, half: Column) -> Column:
        ones = lambda b: F.aggregate(held, zero, lambda n, s: n + F.getbit(s["hash"], b).cast("long") * s["root"])
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(BITS - 1)), zero, lambda x, b: x.bitwiseOR(F.when(ones(b) * 2 > half, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(zero))
        )

    roots = F.transform(weights, lambda s: F.struct(s["hash"].alias("hash"), F.round(F.sqrt(s["weight"]) * MICRO).cast("long").alias("root")))
    return let(roots, lambda held: let(F.aggregate(held, zero, lambda n, s: n + s["root"]), lambda half: code(held, half)))


def layout(radius: int = RADIUS, n: int = BLOCKS) -> list[tuple[int, int, int]]:
    """(first bit, width, limit) of each block; limits, one more each, add to the radius and one."""
    n = min(n, radius + 1)
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a, (radius + 1) // n - 1 + (i < (radius + 1) % n)) for i, (a, b) in enumerate(itertools.pairwise(edges))]


def blocks(code: Column, radius: int = RADIUS, n: int = BLOCKS) -> Column:
    """The blocks of a fingerprint as (number, value)."""
    part = lambda c, a, w: F.shiftrightunsigned(c, a).bitwiseAND(F.lit((1 << w) - 1).cast("long"))
    return let(code, lambda c: F.array(*[F.struct(F.lit(i).alias("block"), part(c, a, w).alias("value")) for i, (a, w, _) in enumerate(layout(radius, n))]))


def near_blocks(code: Column, radius: int = RADIUS, n: int = BLOCKS) -> Column:
    """The same with every value within the block's limit."""
    masks = [sorted(sum(1 << b for b in bits) for k in range(limit + 1) for bits in itertools.combinations(range(w), k)) for _, w, limit in layout(radius, n)]
    every = lambda s, own: F.transform(F.lit(own).cast("array<bigint>"), lambda m: F.struct(s["block"].alias("block"), s["value"].bitwiseXOR(m).alias("value")))
    return let(blocks(code, radius, n), lambda held: F.concat(*[every(F.get(held, i), own) for i, own in enumerate(masks)]))


def _total(weights: Column, zero: Column | None = None, of=lambda s: s["weight"]) -> Column:
    return F.aggregate(weights, F.lit(0.0) if zero is None else zero, lambda x, s: x + of(s))


def _distinct(part: Column) -> Column:
    """(hash, ...) structs without later ones of the same hash."""
    keys = F.transform(part, lambda s: s["hash"])
    first = lambda held: F.filter(part, lambda s, i: F.array_position(held, s["hash"]) == i + 1)
    return let(keys, lambda held: F.when(F.size(F.array_distinct(held)) == F.size(held), part).otherwise(first(held)))


def leaking_texts(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame | None:
    """One row per text of docs (by text_hash) and item it leaks: text_hash, item_id, start, n_words, hamming, similarity."""
    items = benchmark.select("item_id", words("text").alias("tokens")).filter(F.size("tokens") > 0)
    size = F.size("tokens")
    sets = F.coalesce(shingles(F.col("tokens"), SHINGLE), *[shingles(F.col("tokens"), k) for k in range(SHINGLE - 1, 0, -1)])
    items = items.select("item_id", size.alias("n_words"), F.least(size, F.lit(SHINGLE)).alias("k"), F.array_distinct(sets).alias("hashes"))
    items = cut(items.withColumn("item", F.xxhash64("item_id", "hashes", "n_words")).dropDuplicates(["item"]))
    n_items, rows = items.agg(F.count("*"), F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()
    if not n_items:
        return None

    # Weights; each item's shingles with theirs; the least weight of an item of a size; the sizes that hold a shingle.
    each = items.select("item", "item_id", "k", "n_words", F.explode("hashes").alias("hash"))
    weight = F.log1p(F.lit(float(n_items)) / F.col("count"))
    rare = cut(each.groupBy("k", "hash").count().select("k", "hash", weight.alias("weight"), F.ceil(weight * MICRO).alias("mass")))
    weighed = each.join(maybe_broadcast(rare, rows), ["k", "hash"]).groupBy("item", "item_id", "k", "n_words")
    coded = cut(weighed.agg(F.collect_list(F.struct("hash", "weight")).alias("weights")).withColumn("code", fingerprint(F.col("weights"))))
    lightest = F.min(_total(F.col("weights"))).alias("lightest")
    floors = cut(coded.groupBy("k", "n_words").agg(lightest).withColumn("floor", F.floor(F.col("lightest") * (similarity * MICRO)) - 1))
    sizes = cut(each.select("k", "hash", "n_words").distinct().join(floors.drop("lightest"), ["k", "n_words"]))
    least = {r.k: r.floor for r in floors.groupBy("k").agg(F.min("floor").alias("floor")).collect()}

    # The shingles that texts share with items, for texts that share enough with any.
    found = None
    for k in least:
        mine = docs.select(F.xxhash64("text").alias("text_hash"), F.posexplode(shingles(words("text"), k)).alias("at", "hash"))
        some = mine.join(maybe_broadcast(rare.filter(F.col("k") == k), rows), "hash").select("text_hash", "k", "at", "hash", "mass")
        some = some.groupBy("text_hash", "k").agg(F.collect_set(F.struct("at", "hash", "mass")).alias("hits"))
        some = some.filter(_total(F.col("hits"), F.lit(0).cast("long"), lambda s: s["mass"]) >= least[k])
        found = some if found is None else found.unionByName(some)
    found = cut(found)

    # Stretches of starts at which a window of a size holds enough of the weight that items of the size hold.
    events = found.select("text_hash", "k", F.explode("hits").alias("hit")).select("text_hash", "k", "hit.*").join(maybe_broadcast(sizes, rows), ["k", "hash"])
    enters = F.struct(F.greatest(F.col("at") - (F.col("n_words") - F.col("k")), F.lit(0)).alias("lo"), F.col("mass").alias("step"))
    events = events.withColumn("event", F.explode(F.array(enters, F.struct((F.col("at") + 1).alias("lo"), (-F.col("mass")).alias("step")))))
    steps = events.groupBy("text_hash", "k", "n_words", "floor", "event.lo").agg(F.sum("event.step").alias("step"))
    along = Window.partitionBy("text_hash", "k", "n_words", "floor").orderBy("lo")
    steps = steps.withColumn("held", F.sum("step").over(along)).withColumn("hi", F.lead("lo").over(along) - 1)
    spots = cut(steps.filter("held >= floor AND hi IS NOT NULL").select("text_hash", "k", "n_words", "lo", "hi"))

    # Their texts, once each, as shingles with weights by position.
    names = cut(spots.select("text_hash", "k").distinct())
    n_names = names.count()
    texts = docs.select("text", F.xxhash64("text").alias("hash")).join(maybe_broadcast(names.select("text_hash").distinct(), n_names), F.expr("hash = text_hash"), "left_semi")
    texts = texts.groupBy(F.col("hash").alias("text_hash")).agg(F.first("text").alias("text")).select("text_hash", words("text").alias("tokens"))
    texts = texts.join(maybe_broadcast(names, n_names), "text_hash")
    kinds = F.coalesce(*[F.when(F.col("k") == k, shingles(F.col("tokens"), k)) for k in least])
    placed = texts.select("text_hash", "k", F.posexplode(kinds).alias("at", "hash")).join(maybe_broadcast(rare.select("k", "hash", "weight"), rows), ["k", "hash"], "left")
    entry = F.struct("at", "hash", F.coalesce("weight", F.log1p(F.lit(float(n_items)))).alias("weight"), F.col("weight").isNotNull().alias("known"))
    placed = placed.groupBy("text_hash", "k").agg(F.sort_array(F.collect_list(entry)).alias("row"))

    # The windows that the second bound leaves: what no item holds counts against them.
    n_spots = spots.count()
    window = placed.join(maybe_broadcast(spots, n_spots), ["text_hash", "k"])
    window = window.withColumn("hi", F.least(F.col("hi"), F.greatest(F.size("row") + F.col("k") - 1 - F.col("n_words"), F.lit(0)))).filter("lo <= hi")
    span = F.col("n_words") - F.col("k") + 1
    window = window.select("text_hash", "k", "n_words", "lo", F.slice("row", F.col("lo") + 1, F.col("hi") - F.col("lo") + span).alias("part"), F.explode(F.sequence("lo", "hi")).alias("start"))
    window = window.withColumn("held", _distinct(F.slice("part", F.col("start") - F.col("lo") + 1, span))).join(F.broadcast(floors.drop("floor")) if n_items <= 100_000 else floors.drop("floor"), ["k", "n_words"])
    window = window.withColumn("mass", _total(F.col("held"))).withColumn("known", _total(F.filter("held", lambda s: s["known"])))
    window = window.filter(F.col("known") + 1e-9 >= similarity * F.greatest(F.col("mass"), F.col("mass") + F.col("lightest") - F.col("known")))
    own = ["text_hash", "k", "n_words", "start"]
    window = cut(window.select(*own, "mass", F.transform("held", lambda s: s["hash"]).alias("hashes"), fingerprint(F.col("held")).alias("code")))

    # Candidates by blocks, then the exact measure.
    parts = coded.select("item", "k", "n_words", F.col("code").alias("item_code"), F.explode(near_blocks(F.col("code"), radius)).alias("part")).select("item", "k", "n_words", "item_code", "part.*")
    stored = n_items * sum(sum(1 for k in range(limit + 1) for _ in itertools.combinations(range(w), k)) for _, w, limit in layout(radius))
    probes = window.select(*own, "code", F.explode(blocks(F.col("code"), radius)).alias("part")).select(*own, "code", "part.*")
    pairs = probes.join(maybe_broadcast(parts, stored), ["k", "n_words", "block", "value"])
    pairs = pairs.withColumn("hamming", F.bit_count(F.col("code").bitwiseXOR(F.col("item_code"))).cast("int")).filter(F.col("hamming") <= radius)
    near = window.join(pairs.select(*own, "item", "hamming").distinct(), own)
    near = near.join(maybe_broadcast(coded.select("item", "item_id", "weights"), rows), "item")
    near = near.withColumn("both", _total(F.filter("weights", lambda s: F.array_contains("hashes", s["hash"]))))
    near = near.withColumn("similarity", F.round(F.col("both") / (_total(F.col("weights")) + F.col("mass") - F.col("both")), 6)).filter(F.col("similarity") >= similarity)
    return near.groupBy("text_hash", "item_id").agg(_best().alias("best")).select("text_hash", "item_id", "best.*")


def _best() -> Column:
    return F.max_by(F.struct("start", "n_words", "hamming", "similarity"), F.struct("similarity", -F.col("start")))


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """One row per document and item it leaks: doc_id, item_id, start (word), n_words, hamming, similarity."""
    found = leaking_texts(docs, benchmark, similarity, radius)
    if found is None:
        kind = lambda df, c: df.schema[c].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"doc_id {kind(docs, 'doc_id')}, item_id {kind(benchmark, 'item_id')}, start int, n_words int, hamming int, similarity double")
    found = cut(found)
    named = docs.select("doc_id", F.xxhash64("text").alias("text_hash")).join(maybe_broadcast(found, found.count()), "text_hash")
    return named.groupBy("doc_id", "item_id").agg(_best().alias("best")).select("doc_id", "item_id", "best.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that leak an item. The text decides, so that a leak takes no other text with its id."""
    found = leaking_texts(docs.select("text"), benchmark)
    if found is None:
        return docs
    bad = cut(found.select("text_hash").distinct())
    held = docs.withColumn("__own_text_hash", F.xxhash64("text"))
    return held.join(maybe_broadcast(bad, bad.count()), F.expr("__own_text_hash = text_hash"), "left_anti").drop("__own_text_hash")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
