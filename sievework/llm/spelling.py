"""Spelling variants by search schemes over FM-indexes of the vocabulary.

Words of a text are its maximal runs of Latin letters. Two words are near if one inserted, deleted or replaced code
point turns one into the other; the form of a word is its near word of largest count, if that count is ``ratio`` times
its own, and the root is what following forms ends at.

One edit leaves the first half of a word or its second half as it is. The scheme is searched twice: match the second
half exactly, then extend to the left across the first half with one error; and the mirror image, on reversed words,
which is the same code. An index holds the delimited vocabulary of a shard as a multi-string Burrows-Wheeler transform:
every suffix of every word has a rank, a pattern is an interval of ranks, and one step to the left maps the interval by
counting the symbol before both ends. All patterns of a shard go through a step together, as arrays; a final step over
the delimiter turns an interval of ranks into words.

A word meets only words that share the exact half, so Spark shards by that half (hashed): a word is a query under its
own half, and is held by the indexes of the halves of queries one shorter, as long and one longer. A half that holds
more than ``SHARD`` code points of words is split into a grid of cells, a piece of its words against a block of its
queries, so a cell stays bounded however many words share a half and every pair still meets in exactly one cell.
Pairs never leave a cell: it returns the number of near words and the best of them for each query, and as the second
search leaves out what the first one finds (the exact halves tell), sums over cells are exact.

A null or empty text has no words; a null id is the empty text in the hash; very long texts and words are taken whole;
repeated rows count as often as they are there; ties of the largest count go to the smallest word in code-point order;
an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import LOWER, UPPER, doc_key, maybe_broadcast, table, written

#: A run of Latin letters; words have at least MIN_LENGTH code points and MIN_COUNT occurrences.
LETTERS = r"A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: One instance of a run in DROP loses a code point.
DROP = 31
#: Code points of words, about, in an index.
SHARD = 400_000


class Index:
    """Suffix ranks of delimited words. The words must be sorted and distinct; code 0 is the delimiter."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        n = len(codes) + len(sizes)
        ends = np.cumsum(sizes + 1) - 1  # places of the delimiters
        text = np.zeros(n, np.int64)
        inner = np.ones(n, bool)
        inner[ends] = False
        text[inner] = codes
        left = np.repeat(ends, sizes + 1) - np.arange(n)  # code points to the delimiter
        rank, reach = text, 1
        while reach <= left.max(initial=0):
            # Ranks by twice as many code points; behind a delimiter there is nothing.
            behind = np.zeros(n, np.int64)
            there = np.flatnonzero(left >= reach)
            behind[there] = rank[there + reach] + 1
            rank = np.unique(rank * (n + 2) + behind, return_inverse=True)[1].astype(np.int64)
            reach *= 2
        order = np.argsort(rank, kind="stable")  # equal suffixes in the order of their words
        before = np.where(order > 0, text[order - 1], 0)  # in front of a word stands a delimiter
        self.n, self.words, self.before, self.most = n, len(sizes), before, int(text.max(initial=0))
        self.keys = np.sort(before * n + np.arange(n))

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a border between ranks lies once the symbol is put in front."""
        return np.searchsorted(self.keys, symbol * self.n + at)

    def symbols(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct symbols in front of each interval: (which interval, symbol). Equal intervals are looked at once, and
        of one with more ranks than there are symbols, each symbol is counted instead of each rank."""
        both, where = np.unique(lo * (self.n + 1) + hi, return_inverse=True)
        lo, hi = both // (self.n + 1), both % (self.n + 1)
        size = hi - lo
        wide, narrow = np.flatnonzero(size > self.most), np.flatnonzero(size <= self.most)
        which = np.repeat(narrow, size[narrow])
        at = np.arange(len(which)) - np.repeat(np.cumsum(size[narrow]) - size[narrow], size[narrow]) + np.repeat(lo[narrow], size[narrow])
        seen = np.unique(which * (self.most + 1) + self.before[at])
        each, symbol = np.repeat(wide, self.most + 1), np.tile(np.arange(self.most + 1), len(wide))
        there = self.step(symbol, hi[each]) > self.step(symbol, lo[each])
        seen = np.sort(np.concatenate((seen, (each * (self.most + 1) + symbol)[there])))
        of, symbol = seen // (self.most + 1), seen % (self.most + 1)
        # Back to the intervals as given.
        first, end = np.searchsorted(of, where), np.searchsorted(of, where, "right")
        count = end - first
        take = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        return np.repeat(np.arange(len(where)), count), symbol[take]


def search(index: Index, codes: np.ndarray, sizes: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, word) that differ by one edit outside the last ``exact`` code points of the query, each once.

    Among equal neighbours, the edit is the leftmost, so no pair comes twice."""
    starts = np.cumsum(sizes) - sizes
    query = np.arange(len(sizes))
    lo, hi = np.zeros(len(sizes), np.int64), np.full(len(sizes), index.words, np.int64)
    for t in range(int(exact.max(initial=0))):
        on = np.flatnonzero((exact[query] > t) & (hi > lo))
        c = codes[starts[query[on]] + sizes[query[on]] - 1 - t]
        lo[on], hi[on] = index.step(c, lo[on]), index.step(c, hi[on])
    live = hi > lo
    query, lo, hi = query[live], lo[live], hi[live]
    rest = (sizes - exact)[query]  # code points of the query still to be read
    none = np.zeros(0, np.int64)
    wrong = (none, none, none, none)  # states with their error behind them
    found_q, found_w = [], []
    while len(query) or len(wrong[0]):
        q, a, b, r = wrong
        done = r == 0
        if done.any():
            x, y = index.step(np.zeros(done.sum(), np.int64), a[done]), index.step(np.zeros(done.sum(), np.int64), b[done])
            found_q.append(np.repeat(q[done], y - x))
            found_w.append(np.repeat(x, y - x) + np.arange((y - x).sum()) - np.repeat(np.cumsum(y - x) - (y - x), y - x))
        q, a, b, r = (v[~done] for v in (q, a, b, r))
        c = codes[starts[q] + r - 1]
        a, b = index.step(c, a), index.step(c, b)
        wrong = [(q, a, b, r - 1)]
        if len(query):
            which, symbol = index.symbols(lo, hi)
            which, symbol = which[symbol > 0], symbol[symbol > 0]
            x, y = index.step(symbol, lo[which]), index.step(symbol, hi[which])
            more = rest[which] > 0
            own = np.where(more, codes[starts[query[which]] + np.maximum(rest[which], 1) - 1], -1)
            other = symbol != own
            wrong.append((query[which[other]], x[other], y[other], rest[which[other]]))  # one more in the word
            swap = other & more
            wrong.append((query[which[swap]], x[swap], y[swap], rest[which[swap]] - 1))  # another one in the word
            c = codes[starts[query] + np.maximum(rest, 1) - 1]
            ahead = np.where(rest > 1, codes[starts[query] + np.maximum(rest, 2) - 2], -1)
            gone = (rest > 0) & (c != ahead)
            wrong.append((query[gone], lo[gone], hi[gone], rest[gone] - 1))  # one less in the word
            same = ~other
            query, lo, hi, rest = query[which[same]], x[same], y[same], rest[which[same]] - 1
        wrong = tuple(np.concatenate(v) for v in zip(*wrong, strict=True))
        live = wrong[2] > wrong[1]
        wrong = tuple(v[live] for v in wrong)
    return (np.concatenate(found_q), np.concatenate(found_w)) if found_q else (none, none)


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64), np.fromiter(map(len, words), np.int64, len(words))


def best_near(held: list[tuple[str, int]], asked: list[tuple[str, int]], mirrored: bool) -> list[tuple[str, int, int, str, int]]:
    """(word, n, near words, best of them, its n) for each asked word with any, over the held words.

    The edit lies in the second half where mirrored, else in the first half; of the latter, words that share the first
    half are left to the former."""
    turn = (lambda w: w[::-1]) if mirrored else (lambda w: w)
    held = sorted((turn(w), n) for w, n in dict(held).items())
    asked = [(turn(w), n) for w, n in asked]
    codes, sizes = _points([w for w, _ in held])
    alphabet = np.unique(codes)
    q_codes, q_sizes = _points([w for w, _ in asked])
    at = np.searchsorted(alphabet, q_codes)
    known = at < len(alphabet)
    known[known] = alphabet[at[known]] == q_codes[known]
    index = Index(np.searchsorted(alphabet, codes) + 1, sizes)
    exact = q_sizes // 2 if mirrored else q_sizes - q_sizes // 2
    found = {}
    for q, w in zip(*map(np.ndarray.tolist, search(index, np.where(known, at + 1, len(alphabet) + 1), q_sizes, exact)), strict=True):
        word, (near, n) = asked[q][0], held[w]
        if not mirrored and near[: len(word) // 2] == word[: len(word) // 2]:
            continue
        near = turn(near)
        count, least = found.get(q, (0, (1, "")))
        found[q] = (count + 1, min(least, (-n, near)))
    return [(turn(asked[q][0]), asked[q][1], count, near, -n) for q, (count, (n, near)) in found.items()]


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop: int | None = DROP) -> DataFrame:
    """(word, n): the words of all texts. With drop, runs whose hash with the id is divisible by it lose a code point."""
    run = F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0)))
    runs = docs.select(doc_key().alias("id"), run.alias("run")).withColumn("run", F.translate("run", UPPER, LOWER))
    if drop:
        h = F.crc32(F.concat("id", F.lit(":"), "run"))
        at = (h % F.length("run")).cast("int")
        less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        runs = runs.withColumn("run", F.when(h % drop == 0, less).otherwise(F.col("run"))).filter(F.length("run") >= min_length)
    return runs.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """(word, n, n_near, best, best_n) of distinct words (word, n) of at least two code points; best is null where no word is near."""
    size = F.length("word")

    def half(m: Column, mirrored: bool) -> Column:
        return F.floor(m / 2).cast("int") if mirrored else (m - F.floor(m / 2)).cast("int")

    def side(mirrored: bool) -> DataFrame:
        turned = F.reverse("word") if mirrored else F.col("word")
        halves = F.array_distinct(F.array(*[F.greatest(half(size + d, mirrored), F.lit(1)) for d in (-1, 0, 1)]))
        cut = words.select("word", "n", F.explode(halves).alias("exact"), turned.alias("turned"))
        return cut.select("word", "n", F.lit(mirrored).alias("mirrored"), F.expr("right(turned, exact)").alias("half"), (F.col("exact") == half(size, mirrored)).alias("asks"))

    rows = side(True).unionByName(side(False)).withColumn("half", F.xxhash64("mirrored", "half"))
    per = rows.groupBy("half").agg(F.sum(size + 1).alias("points"))
    large = per.filter(F.col("points") > shard).select("half", F.ceil(F.col("points") / shard).cast("int").alias("pieces"))
    large = written(large, "large-halves")
    total = rows.agg(F.coalesce(F.sum(size + 1), F.lit(0))).first()[0]
    shards = max(1, math.ceil(total / shard))
    rows = rows.join(maybe_broadcast(large, large.count()), "half", "left")
    # A large half is a grid: a row is held in the cells of its own piece and asks in those of its own block.
    parts = F.coalesce("pieces", F.lit(1))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("word"), parts).cast("int")).withColumn("span", F.sequence(F.lit(0), parts - 1))
    holds = F.transform("span", lambda j: F.struct(F.col("own").alias("i"), j.alias("j")))
    asks = F.transform(F.when(F.col("asks"), F.col("span")).otherwise(F.array().cast("array<int>")), lambda i: F.struct(i.alias("i"), F.col("own").alias("j")))
    shard_of = F.when(F.col("pieces").isNull(), F.pmod("half", F.lit(shards))).otherwise(F.col("half"))
    cells = rows.select("word", "n", "mirrored", "asks", "own", shard_of.alias("shard"), F.col("pieces").isNotNull().alias("large"), F.explode(F.array_distinct(F.concat(holds, asks))).alias("cell"))
    cells = cells.select("word", "n", "mirrored", "shard", "large", "cell.i", "cell.j", (F.col("own") == F.col("cell.i")).alias("held"), (F.col("asks") & (F.col("own") == F.col("cell.j"))).alias("asks"))

    def run(cell: pa.Table) -> pa.Table:
        words, n, mirrored = cell["word"].to_pylist(), cell["n"].to_pylist(), cell["mirrored"][0].as_py()
        held = [(w, k) for w, k, h in zip(words, n, cell["held"].to_pylist(), strict=True) if h]
        asked = [(w, k) for w, k, h in zip(words, n, cell["asks"].to_pylist(), strict=True) if h]
        found = best_near(held, asked, mirrored) if held and asked else []
        types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        columns = zip(*found, strict=True) if found else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["word", "n", "n_near", "best", "best_n"])

    # Cells are sized in code points, so they aren't to be put together by bytes.
    own_cell = ("mirrored", "shard", "large", "i", "j")
    found = cells.repartition(min(2 * shards, 20_000), *own_cell).groupBy(*own_cell).applyInArrow(run, "word string, n long, n_near long, best string, best_n long")
    # A word without near words comes from the vocabulary itself.
    every = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("best"), F.lit(None).cast("long").alias("best_n"))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("k"), F.col("best").alias("w"))))
    merged = found.unionByName(every).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    return merged.select("word", "n", "n_near", F.col("b.w").alias("best"), (-F.col("b.k")).alias("best_n"))


def group_variants(words: DataFrame, ratio: int = RATIO, shard: int = SHARD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n)."""
    words = written(words, "vocabulary")
    takes = F.col("best_n") >= ratio * F.col("n")
    found = near_words(words, shard).select("word", "n", "n_near", F.when(takes, F.col("best")).alias("form"), F.when(takes, F.col("best_n")).alias("form_n"))
    found = written(found, "forms")
    # Counts grow by the ratio along forms, so a chain has at most log(largest count) links; each round doubles what is followed.
    links = found.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = found.agg(F.max("n")).first()[0] or 1
    depth = math.ceil(math.log(max(most, 2)) / math.log(max(ratio, 2)))
    for _ in range(depth.bit_length() if ratio > 1 else 0):
        rows = links.count()
        step = maybe_broadcast(links.select(F.col("word").alias("at"), F.col("root").alias("next")), rows)
        links = written(links.join(step, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    end = maybe_broadcast(links.withColumnRenamed("word", "of"), links.count())
    held = found.join(end, F.col("word") == F.col("of"), "left")
    return held.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(vocabulary(table(spark, sf_dir, "documents").select("doc_id", "text")))


#: The hash is worked bit by bit; words that differ by one deletion share a shortened form, replaced code points leave the same one at one place.
ORACLE = rf"""
WITH RECURSIVE runs AS (
  SELECT id, run, count(*) AS k FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[{LETTERS}]+')), '{UPPER}', '{LOWER}') AS run FROM documents
  ) WHERE length(run) >= {MIN_LENGTH} GROUP BY ALL
), bits AS (
  SELECT *, flatten(list_transform(flatten(list_transform(string_split(id || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)),
    lambda b: [b & 1, (b >> 1) & 1, (b >> 2) & 1, (b >> 3) & 1, (b >> 4) & 1, (b >> 5) & 1, (b >> 6) & 1, (b >> 7) & 1])) AS bits FROM runs
), hashed AS (
  SELECT run, k, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(bits, lambda b: b::BIGINT)),
    lambda c, b: xor(c >> 1, 3988292384::BIGINT * (xor(c, b) & 1))), 4294967295::BIGINT) AS h FROM bits
), counted AS (
  SELECT CASE WHEN h % {DROP} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, sum(k)::BIGINT AS n
  FROM hashed GROUP BY ALL
), words AS MATERIALIZED (SELECT word, n FROM counted WHERE length(word) >= {MIN_LENGTH} AND n >= {MIN_COUNT}
), less AS MATERIALIZED (
  SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS short FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.p = b.p AND a.short = b.short AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.short = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.short = b.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= {RATIO} * w.n THEN other END AS form, CASE WHEN other_n >= {RATIO} * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), roots AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL SELECT r.word, f.word, f.form FROM roots r JOIN formed f ON r.next = f.word
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, root FROM roots WHERE next IS NULL) USING (word)
"""
