"""Toxicity scores from a counterfactually regularised classifier.

A text is the set of its words (runs of letters, lower case) and of their prefixes of five bytes, hashed. Logistic
regression over the features that tell the labels apart best is fitted with a second penalty: identity terms in
labelled sentences are swapped for others of their group and the squared change of the sentence's score is added
to the loss. So a group's name cannot carry weight that other groups' names don't, and neutral mentions stay low.

Fitting uses at most ``PER_LABEL`` rows of each label, those with the smallest hash of the id; classes are weighed
back to their shares in all training labels. Spark counts the features of these rows, picks the ``FEATURES`` that tell
most, and sums the products of what goes and comes in the swaps of all their sentences: only features of terms can, so
the sums are a table whose size the list of terms fixes, and no swap is left out. The driver sees chosen features and
that table only, whatever the length of a text. Scoring reads every text whole, in slices of bounded memory.

Null and empty texts score the intercept. Null labels are not learned; if one label is missing, the score is the
share of the other. Different labels for one id all count, equal ones once; a row without an id is scored and never learned. Very long
texts are sets of at most 2**18 features; a text without sentence ends is one sentence. Rows with equal texts get
equal scores; an empty table gives no rows; columns of the input named as the added ones are replaced.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.arrow_text import _BYTE, mix64, text_bytes
from sievework.llm.common import cut, extended, lowest, table, without
from sievework.llm.langid import held_out

#: Bounds of the fit and its strengths.
PER_LABEL, FEATURES, MIN_DF, RIDGE, SWAP, STEPS = 4000, 1024, 4, 2e-4, 0.05, 800
BITS, PREFIX = 18, 5
SLICE = 1 << 20

# Groups of identity terms that can stand for each other.
IDENTITY = [
    "women men", "woman man", "girls boys", "girl boy", "muslims christians jews hindus buddhists atheists",
    "muslim christian jewish hindu buddhist atheist", "black white asian latino indigenous", "gay lesbian bisexual straight transgender",
    "immigrants refugees citizens natives", "immigrant refugee citizen native", "disabled abled", "elderly young",
    "frauen männer", "frau mann", "muslime christen juden", "schwarze weiße", "homosexuelle heterosexuelle", "ausländer inländer",
    "femmes hommes", "femme homme", "musulmans chrétiens juifs", "noirs blancs", "immigrés citoyens",
    "mujeres hombres", "mujer hombre", "musulmanes cristianos judíos", "negros blancos", "inmigrantes ciudadanos",
]
SWAPS = {w: g[(i + 1) % len(g)] for g in map(str.split, IDENTITY) for i, w in enumerate(g)}

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the words of several texts, and the text of each: a word's own and, if longer, its prefix's."""
    inside = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    starts = np.flatnonzero(inside & (~np.concatenate(([False], inside[:-1])) | edge[:-1]))
    ends = np.flatnonzero(inside & (~np.concatenate((inside[1:], [False])) | edge[1:])) + 1 if len(data) else starts
    size = ends - starts
    owner = np.searchsorted(off, starts, "right") - 1
    found, owners = [], []
    for longest, tag in ((None, 1), (PREFIX, 2)):
        own = slice(None) if longest is None else size > longest
        s, o = starts[own], owner[own]
        n = size[own] if longest is None else np.full(len(s), longest)
        for a in range(0, len(s), SLICE >> 3):
            b = min(a + (SLICE >> 3), len(s))
            at = np.concatenate(([0], np.cumsum(n[a:b])[:-1]))
            inner = np.arange(int(n[a:b].sum())) - np.repeat(at, n[a:b])
            value = mix64(_BYTE[data[inner + np.repeat(s[a:b], n[a:b])]] + inner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            found.append((mix64(np.add.reduceat(value, at) + np.uint64(tag)) >> np.uint64(64 - BITS)).astype(np.int64))
            owners.append(o[a:b])
    return (np.concatenate(found), np.concatenate(owners)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def one(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return np.unique(features(data, np.array([0, len(data)]))[0])


def swapped(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each sentence with identity terms: its features that go and that come when all terms are swapped."""
    for sentence in re.split(r"[.!?\n]+", text.lower()):
        terms = [w for w in re.findall(r"[^\W\d_]+", sentence) if w in SWAPS]
        if terms:
            other = re.sub(r"[^\W\d_]+", lambda m: SWAPS.get(m[0], m[0]), sentence)
            a, b = one(sentence), one(other)
            yield np.setdiff1d(a, b), np.setdiff1d(b, a)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (toxic, text) with their distinct features."""
    for b in batches:
        for text, y in zip(b.column("text"), b.column("toxic"), strict=True):
            data, off = text_bytes(pa.array([text.as_py()], pa.string()))
            have = np.unique(features(data, off)[0]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([y.as_py()], pa.int32()), pa.array([have], pa.list_(pa.int32()))], names=["toxic", "have"])


def term_features() -> np.ndarray:
    """The features of all identity terms: no others can go or come in a swap."""
    return np.unique(np.concatenate([one(w) for w in SWAPS]))


def products(swaps: list[tuple[np.ndarray, np.ndarray]], terms: np.ndarray) -> np.ndarray:
    """The sum of d d' over swaps, where d is 1 at what goes and -1 at what comes (terms x terms)."""
    d = np.zeros((len(swaps), len(terms)), np.int64)
    for row, (gone, come) in zip(d, swaps, strict=True):
        row[np.searchsorted(terms, gone)], row[np.searchsorted(terms, come)] = 1, -1
    return d.T @ d


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, total) of a task's texts: the places of products() that aren't 0, and at -1 the number of swaps."""
    terms = term_features()
    total, n = np.zeros((len(terms), len(terms)), np.int64), 0
    for b in batches:
        for text in b.column("text"):
            data, off = text_bytes(pa.array([text.as_py()], pa.string()))
            if np.isin(features(data, off)[0], terms).any():
                found = swapped(text.as_py() or "")
                while part := list(itertools.islice(found, 1024)):
                    total += products(part, terms)
                    n += len(part)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total.ravel()[at], n))], names=["at", "total"])


def pick(df: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The features that tell most, from their counts (2 x features) in rows of label 0 and 1."""
    share = (df + 0.5) / (n[:, None] + 1)
    tells = np.abs(share[1] - share[0]) / np.sqrt(share.mean(0) * (1 - share.mean(0)) + 1e-9)
    tells[df.sum(0) < MIN_DF] = 0
    chosen = np.argsort(-tells, kind="stable")[:FEATURES]
    return chosen[tells[chosen] > 0]


def solve(
    have: list[np.ndarray], labels: np.ndarray, swaps: np.ndarray | None, shares: tuple[float, float], swap: float = SWAP, df: np.ndarray | None = None
) -> tuple[np.ndarray, float]:
    """Weights over all hashed features, and the intercept. swaps: the mean of products() over all swaps, null if there
    are none; shares: of labels 0 and 1 in all training rows; df: counts of the features by label, where have holds only some."""
    weights = np.zeros(1 << BITS, np.float32)
    n = np.array([(labels == 0).sum(), (labels == 1).sum()])
    if n.min() == 0:
        return weights, 40.0 if n[1] else -40.0 if n[0] else 0.0
    if df is None:
        df = np.stack([np.bincount(np.concatenate([h for h, y in zip(have, labels, strict=True) if y == c]), minlength=1 << BITS) for c in (0, 1)])
    chosen = pick(df, n)
    terms = term_features()
    mean = np.zeros((len(terms), len(terms))) if swaps is None else swaps
    used = np.flatnonzero((np.diag(mean) > 0) & (df.sum(0)[terms] > 0))
    chosen = np.union1d(chosen, terms[used])
    column = np.full(1 << BITS, -1)
    column[chosen] = np.arange(len(chosen))
    def dense(sets: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(sets), len(chosen)), np.float32)
        for i, h in enumerate(sets):
            k = column[h]
            x[i, k[k >= 0]] = 1
        return x

    x, at_terms, mean = dense(have), column[terms[used]], mean[np.ix_(used, used)].astype(np.float32)
    v = (np.array(shares) / n)[labels].astype(np.float32)
    v /= v.sum()
    w, b = np.zeros(len(chosen), np.float32), float(np.log(max(shares[1], 1e-6) / max(shares[0], 1e-6)))
    # Accelerated gradient steps; the bound of the curvature is found by power steps.
    z = np.ones(len(chosen), np.float32)
    for _ in range(20):
        pull = swap * (mean @ z[at_terms])
        z = x.T @ (v * (x @ z)) / 4
        z[at_terms] += pull
        norm = float(np.linalg.norm(z)) or 1.0
        z /= norm
    step = 1 / (1.2 * norm + RIDGE + 0.25)
    last, at = (w, b), (w, b)
    goal, step = labels.astype(np.float32), np.float32(step)
    for k in range(STEPS):
        w, b = at
        e = v * (1 / (1 + np.exp(-np.clip(x @ w + np.float32(b), -40, 40))) - goal)
        slope = e @ x + np.float32(RIDGE) * w
        slope[at_terms] += np.float32(swap) * (mean @ w[at_terms])
        new = (w - step * slope, b - float(step * e.sum()))
        push = np.float32(k / (k + 3))
        at = (new[0] + push * (new[0] - last[0]), float(new[1] + push * (new[1] - last[1])))
        last = new
    weights[chosen] = last[0]
    return weights, float(last[1])


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> tuple[np.ndarray, float]:
    """A model from docs (doc_id, text) and labels (doc_id, toxic)."""
    labels = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    chosen = lowest(labels, "toxic", "doc_id", per_label).drop("at")
    total = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}
    rows = cut(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic").repartition(16))
    held = cut(rows.mapInArrow(_features, "toxic int, have array<int>"))
    df = np.zeros((2, 1 << BITS), np.int64)
    counts = held.select("toxic", F.explode("have").alias("feature")).groupBy("feature").agg(*[F.count_if(F.col("toxic") == y).alias(f"n{y}") for y in (0, 1)])
    for f, *n in counts.collect():
        df[:, f] = n
    summed = {r.at: r.total for r in rows.select("text").mapInArrow(_products, "at long, total long").groupBy("at").agg(F.sum("total").alias("total")).collect()}
    seen, terms = summed.pop(-1, 0), term_features()
    swaps = np.zeros(len(terms) ** 2)
    swaps[list(summed)] = list(summed.values())
    swaps = swaps.reshape(len(terms), -1) / seen if seen else None
    learned = {r.toxic: r["count"] for r in held.groupBy("toxic").count().collect()}
    chosen = np.unique(np.concatenate([pick(df, np.array([learned.get(0, 0), learned.get(1, 0)])), terms if swaps is None else terms[np.diag(swaps) > 0]])).astype(int)
    few = held.select("toxic", F.array_sort(F.array_intersect("have", F.lit(chosen.tolist()).cast("array<int>"))).alias("have"))
    found = sorted((r.toxic, r.have) for r in few.collect())
    n = sum(total.values()) or 1
    return solve([np.array(h, np.int64) for _, h in found], np.array([y for y, _ in found], np.int64), swaps, (total.get(0, 0) / n, total.get(1, 0) / n), df=df)


def predict(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """docs (text and others) with score and predicted."""
    docs = without(docs, "score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f.name for f in docs.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                f, owner = features(*text_bytes(b.column("text")))
                tells = weights[f] != 0
                pair = np.unique(owner[tells] << BITS | f[tells])
                raw = bias + np.bincount(pair >> BITS, weights[pair & ((1 << BITS) - 1)].astype(np.float64), b.num_rows)
                score = np.round(1 / (1 + np.exp(-np.clip(raw, -40, 40))), 9)
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    return docs.mapInArrow(run, extended(docs, score="double", predicted="integer"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = ~held_out(parts=5, rest=0)
    model = fit(docs.select("doc_id", "text").filter(learn), labels.filter(learn))
    return predict(docs.select("doc_id", held_out(parts=5, rest=0).alias("held_out"), "text"), model).drop("text")
