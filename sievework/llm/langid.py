"""Language identification with string kernels.

A text is the set of its byte n-grams (lengths 1 to 3, ASCII letters lowered, digits and signs dropped, white
space runs as one blank). The kernel of two texts is the number of n-grams that both hold (blended spectrum,
presence), divided by the root of the product of their set sizes. Nystroem: m landmark texts give features
K(x, L) K(L, L)^-1/2; on them one ridge regression per language (one against the rest) is solved in closed form.
A batch is scored by matrix products: presence over the landmarks' n-grams times landmark presence times coefficients.

Fitting uses at most ``per_language`` labelled rows of each language, those with the smallest hash of the id, and fewer
of each where ``ROWS`` in all would not do; no language is left out. So it is bounded and repeatable; what leaves the
executors is the n-gram sets of the landmarks and sums of products of features (landmarks x landmarks), made in bins of
rows on executors and added in order, so that reruns agree. Scoring reads every text whole, in slices of bounded memory.
As scores are linear in the kernel, landmarks times coefficients are multiplied once: what is broadcast for scoring has
n-grams x languages cells.

A text that is null or has no letter is ``und`` with score 0. Null labels are never learned. Without any usable
label every text is ``und``. Ties go to the language first by code point. Repeated rows get equal values; of rows with
one id and label, the text that is first in order is learned. Columns of the input named as the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.llm.arrow_text import text_bytes
from sievework.llm.common import cut, doc_key, extended, lowest, set_aside, table, without

#: Bounds of the fit: labelled rows and landmarks of each language, and of all; ridge.
PER_LANGUAGE, LANDMARKS, ROWS, MARKS, RIDGE = 300, 24, 60_000, 4_800, 1e-3
#: Rows whose products one task sums, and rows of the sums that travel together.
BIN_ROWS, BLOCK = 1_000, 256
#: Bytes of text in one slice.
SLICE = 1 << 20
UNDETERMINED = "und"

# Bytes as symbols: 0 is white space, 1 a sign or digit (both break words), letters and UTF-8 bytes stand for themselves.
_SYMBOL = np.arange(256, dtype=np.uint8)
_SYMBOL[[*range(0, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0
_SYMBOL[0x41:0x5B] = np.arange(0x61, 0x7B)


def symbols(data: np.ndarray) -> np.ndarray:
    """The bytes of a text as symbols, runs of breaks as one."""
    s = _SYMBOL[data]
    return s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))] if len(s) else s


def grams(data: np.ndarray) -> np.ndarray:
    """The distinct n-grams of one text as numbers: the n bytes, under a byte that holds n."""
    s, out = symbols(data), []
    for a in range(0, max(len(s), 1), SLICE):
        x = s[a : a + SLICE + 2].astype(np.uint32)
        for n, g in enumerate((x, x[:-1] << 8 | x[1:], x[:-2] << 16 | x[1:-1] << 8 | x[2:]), 1):
            out.append(np.unique(g) | np.uint32(n << 24))
    return np.concatenate(out) if len(out) == 3 else np.unique(np.concatenate(out))


@dataclass
class Model:
    """What an executor needs to score."""

    languages: list[str]
    vocabulary: np.ndarray  # sorted distinct n-grams of the landmarks
    weights: np.ndarray  # n-grams x languages: landmark presence over root sizes, times coefficients
    bias: np.ndarray  # of each language

    def tables(self) -> list[np.ndarray]:
        """For n = 1, 2, 3: n-gram -> its row of weights + 1, or 0."""
        out = []
        for n in (1, 2, 3):
            t = np.zeros(1 << (8 * n), np.uint16 if len(self.vocabulary) < 1 << 16 else np.uint32)
            own = self.vocabulary[self.vocabulary >> 24 == n]
            t[own & 0xFFFFFF] = np.searchsorted(self.vocabulary, own) + 1
            out.append(t)
        return out

    def scores(self, texts: list[np.ndarray], tables: list[np.ndarray]) -> np.ndarray:
        """One row per text (its bytes), one column per language."""
        x = np.zeros((len(texts), len(self.vocabulary) + 1), np.float32)
        root = np.ones(len(texts), np.float32)
        for i, data in enumerate(texts):
            g = grams(data)
            root[i] = max(len(g), 1) ** -0.5
            for n, t in enumerate(tables, 1):
                x[i, t[g[g >> 24 == n] & 0xFFFFFF]] = 1
        return (x[:, 1:] @ self.weights) * root[:, None] + self.bias


class Landmarks:
    """The landmark sets by n-gram, and the kernels of other sets with them."""

    def __init__(self, marks: list[np.ndarray]):
        every, owner = np.concatenate(marks), np.repeat(np.arange(len(marks)), [len(g) for g in marks])
        order = np.argsort(every, kind="stable")
        self.vocabulary, first = np.unique(every[order], return_index=True)
        self.owner, self.first = owner[order], np.append(first, len(every))
        self.root, self.marks = np.array([len(g) for g in marks]) ** 0.5, marks

    def kernel(self, g: np.ndarray) -> np.ndarray:
        """The kernel of a set and each landmark: common n-grams are counted along the lists of landmarks."""
        at = np.searchsorted(self.vocabulary, g)
        at = at[(at < len(self.vocabulary)) & (self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == g)]
        a, n = self.first[at], self.first[at + 1] - self.first[at]
        held = self.owner[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())]
        return np.bincount(held, minlength=len(self.root)) / (self.root * max(len(g), 1) ** 0.5)

    def rows(self, sets: list[np.ndarray]) -> np.ndarray:
        """The kernels of sets, and a one."""
        return np.hstack([np.stack([self.kernel(g) for g in sets]), np.ones((len(sets), 1))])

    def whitening(self) -> np.ndarray:
        """What turns a row of kernels and a one into Nystroem features and a one."""
        values, vectors = np.linalg.eigh(np.stack([self.kernel(g) for g in self.marks]))
        keep = values > 1e-6 * values.max()
        out = np.zeros((len(values) + 1, keep.sum() + 1))
        out[:-1, :-1], out[-1, -1] = vectors[:, keep] / np.sqrt(values[keep]), 1
        return out

    def weights(self, coefficients: np.ndarray) -> np.ndarray:
        """n-grams x languages: the coefficients of the landmarks that hold an n-gram, summed."""
        own = coefficients / self.root[:, None]
        return np.stack([np.add.reduceat(c[self.owner], self.first[:-1]) for c in own.T], 1).astype(np.float32)


def products(marks: Landmarks, sets: list[np.ndarray], labels: list[str], languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The weighted sum of products of kernel rows, and that of rows by label; a slice of rows at a time."""
    at, m = np.searchsorted(languages, labels), len(marks.root) + 1
    square, total = np.zeros((m, m)), np.zeros((len(languages), m))
    weight = (1 / np.bincount(at, minlength=len(languages)).clip(1))[at]
    for a in range(0, len(sets), 256):
        held = marks.rows(sets[a : a + 256])
        square += held.T @ (weight[a : a + 256, None] * held)
        np.add.at(total, at[a : a + 256], weight[a : a + 256, None] * held)
    return square, total


def _solved(marks: Landmarks, languages: list[str], square: np.ndarray, total: np.ndarray, ridge: float) -> Model:
    """One ridge regression per language, on Nystroem features; square and total as products gives them."""
    turn = marks.whitening()
    square, total = turn.T @ square @ turn, total @ turn
    goal = (2 * total - total.sum(0)).T  # +1 for the language's own rows, -1 for the others
    penalty = ridge * np.trace(square) / len(square) * np.eye(len(square))
    penalty[-1, -1] = 1e-9
    beta = turn @ np.linalg.solve(square + penalty, goal)
    return Model(languages, marks.vocabulary, marks.weights(beta[:-1]), beta[-1].astype(np.float32))


def solve(sets: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Nystroem features of n-gram sets and one ridge regression per language, of sets in memory."""
    used = [(g, y) for g, y in zip(sets, labels, strict=True) if len(g)]
    if not used:
        return None
    languages = sorted({y for _, y in used})
    marks = Landmarks([g for y in languages for g in [g for g, z in used if z == y][: _marks_of(languages, landmarks)]])
    return _solved(marks, languages, *products(marks, [g for g, _ in used], [y for _, y in used], languages), ridge)


def _marks_of(languages: list[str], landmarks: int = LANDMARKS) -> int:
    return max(1, min(landmarks, MARKS // len(languages)))


def _gram_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = text_bytes(b.column("text"))
        sets = [grams(data[x:y]).tobytes() for x, y in zip(off[:-1], off[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(sets, pa.binary())], names=["lang", "grams"])


def _bin_products(shared, counts: dict[str, int]):
    """The sums of a bin's rows: the square in blocks of rows, and those of the languages."""

    def run(group: pa.Table) -> pa.Table:
        marks, languages = shared.value, list(counts)
        rows = sorted(zip(group.column("lang").to_pylist(), group.column("grams").to_pylist(), strict=True))
        square = total = 0.0
        for y in sorted({y for y, _ in rows}):  # a label at a time, as rows weigh one over their label's count
            own = [np.frombuffer(g, np.uint32) for z, g in rows if z == y]
            s, t = products(marks, own, [y] * len(own), languages)
            square, total = square + s * (len(own) / counts[y]), total + t * (len(own) / counts[y])
        parts = [*(square[a : a + BLOCK] for a in range(0, len(square), BLOCK)), total]
        bin_no = group.column("bin")[0].as_py()
        return pa.table({"bin": pa.array([bin_no] * len(parts), pa.int32()), "part": pa.array(range(len(parts)), pa.int32()), "sums": pa.array([p.tobytes() for p in parts], pa.binary())})

    return run


def _added(group: pa.Table) -> pa.Table:
    group = group.sort_by("bin")
    sums = [np.frombuffer(x.as_py(), np.float64) for x in group.column("sums")]
    return pa.table({"part": pa.array([group.column("part")[0].as_py()], pa.int32()), "sums": pa.array([np.sum(sums, axis=0).tobytes()], pa.binary())})


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from rows (doc_id, text, lang)."""
    named = labelled.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    total = named.agg(F.count_distinct("lang")).first()[0]
    chosen = lowest(named.select("doc_id", "lang").distinct(), "lang", "doc_id", max(1, min(per_language, ROWS // max(total, 1)))).drop("at")
    rows = named.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    sets = cut(rows.select("lang", "text").mapInArrow(_gram_sets, "lang string, grams binary").filter(F.length("grams") > 0))
    counts = {r.lang: r["count"] for r in sorted(sets.groupBy("lang").count().collect(), key=lambda r: r.lang)}
    if not counts:
        return None
    languages = list(counts)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("grams"))
    first = sets.withColumn("at", place).filter(F.col("at") <= _marks_of(languages)).orderBy("lang", "at").collect()
    marks = Landmarks([np.frombuffer(bytes(r.grams), np.uint32) for r in first])
    shared = labelled.sparkSession.sparkContext.broadcast(marks)
    dealt = sets.withColumn("bin", F.pmod(F.xxhash64("lang", "grams"), F.lit(-(-sum(counts.values()) // BIN_ROWS))).cast("int"))
    made = dealt.groupBy("bin").applyInArrow(_bin_products(shared, counts), "bin int, part int, sums binary")
    got = {r.part: np.frombuffer(bytes(r.sums), np.float64) for r in made.groupBy("part").applyInArrow(_added, "part int, sums binary").collect()}
    m, last = len(marks.root) + 1, max(got)
    square = np.concatenate([got[k] for k in range(last)]).reshape(m, m)
    return _solved(marks, languages, square, got[last].reshape(len(languages), m), RIDGE)


def held_out(key: Column | str = "doc_id", parts: int = 4, rest: int = 2) -> Column:
    return F.crc32(doc_key(key) if isinstance(key, str) else key) % parts == rest


def predict(docs: DataFrame, model: Model | None, cells: int = 1 << 24) -> DataFrame:
    """docs (text and others) with lang_pred and score."""
    docs = without(docs, "lang_pred", "score", "has_letter")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f.name for f in docs.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, tables = shared.value, shared.value.tables()
        rows = max(1, min(512, cells // (len(model.vocabulary) + 1)))  # so that the presence matrix stays small
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                data, off = text_bytes(b.column("text"))
                raw = model.scores([data[x:y] for x, y in zip(off[:-1], off[1:], strict=True)], tables)
                best, known = raw.argmax(1), np.asarray(b.column("has_letter"))
                score = np.where(known, np.clip((raw.max(1).astype(np.float64) + 1) / 2, 0, 1), 0.0)
                lang = [model.languages[k] if ok else UNDETERMINED for k, ok in zip(best, known, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(lang), pa.array(score)], names=[*names, "lang_pred", "score"])

    ready = docs.withColumn("has_letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return ready.mapInArrow(run, extended(docs, lang_pred="string", score="double"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang").filter(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


def keep_known(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs whose language can be told; without a model, those with a letter."""
    if model is None:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    held, back = set_aside(docs, "lang_pred", "score", "has_letter")
    return predict(held, model).filter(F.col("lang_pred") != UNDETERMINED).select(*back)
