"""SentencePiece encoding and decoding by a table of distinct chunks.

Where no piece of the model goes on over a white-space marker (a marker behind any other character), what stands
between markers is segmented on its own: a text is cut before each run of markers, and each distinct marked word needs
to be segmented once only. If no piece holds a line break either, texts are cut around line breaks too. Both conditions,
and that the model's normaliser leaves texts as they are, are looked up in the model; where they fail, a text is one
chunk and the same code segments it whole.

Chunks are found and told apart as arrays over the bytes of a batch: a chunk's key is two 64-bit hashes of its bytes, so
that the distinct ones of a batch are known without an object per word. Spark counts the chunks of all texts, each task
handing on its own distinct ones. Those that occur twice or more are segmented once, as a table in the shared folder. Its
most frequent levels that fit into ``TABLE_BYTES`` are broadcast (the size is known from the table before); the distinct
chunks of a batch look up their row, and ids come back by position with one gather. Chunks outside the broadcast are
segmented where they occur, each distinct one of a task once as long as its memory of ``REMEMBER`` characters lasts, so
no chunk is left out at any size.

Decoding is the library's decode of each list of ids.

A null or empty text has no ids, and no ids (or null) decode to the empty text. Very long texts and runs without blanks
are segmented whole. Repeated rows give repeated rows, an empty table none. Columns of the input stay, but for those
named as the added ones, whatever their case.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from sievework.llm.arrow_text import mix64, sliced, text_bytes
from sievework.llm.common import table, without, written

#: Path of the model; a parameter of all operators here.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Bytes of chunks and ids that are broadcast; characters of chunks that a task remembers besides.
TABLE_BYTES, REMEMBER = 16 << 20, 1 << 22
#: Bytes of texts that are worked at once (one text at least), and rows of distinct chunks that a task gathers.
AT_ONCE, GATHER = 2 << 20, 400_000
#: Chunks of more bytes are not told apart by hashes: each is looked up by its text.
LONG = 256
U64 = np.uint64


def by_bytes(batches: Iterator[pa.RecordBatch], most: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many bytes of text."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows or not b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))) if b.num_rows else 1
            yield b.slice(at, to - at)
            at = to


class Segmenter:
    """Cuts texts into chunks that are segmented apart, and segments chunks."""

    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        probe = " a  b\tﬁÅ é　  \n"
        plain = self.model.normalize(probe) == MARK + probe.replace(" ", MARK)
        self.apart = plain and MARK in pieces and not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self.mark = self.model.piece_to_id(MARK)
        self.lines = self.apart and not any("\n" in p for p in pieces)

    def spread(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts, markers as blanks and with the one that the library puts in front, and their offsets."""
        texts = pc.fill_null(texts, "")
        if self.apart:
            texts = pc.replace_substring(texts, MARK, " ")
            texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise("", texts, " "))
        return text_bytes(texts)

    def bounds(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where chunks start: at texts, and where they can be cut at runs of blanks and of line breaks."""
        starts = np.zeros(len(data) + 1, bool)
        starts[off] = True
        if self.apart and len(data):
            for c in (0x20, 0x0A) if self.lines else (0x20,):
                here = data == c
                starts[1:-1] |= here[1:] & ~here[:-1]
        return np.flatnonzero(starts[:-1])

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """The ids of each chunk. The library puts a marker in front: it stands for a chunk's first one, or goes again."""
        if not self.apart:
            return self.model.encode(chunks, num_threads=1)
        marked = [c[0] != "\n" for c in chunks]
        found = self.model.encode([c[1:] if m else c for c, m in zip(chunks, marked, strict=True)], num_threads=1)
        return [([self.mark] if len(c) == 1 else x) if m else x[1:] for c, m, x in zip(chunks, marked, found, strict=True)]


@functools.lru_cache(2)
def segmenter(model: bytes) -> Segmenter:
    return Segmenter(model)


def keys(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each span of bytes, eight bytes at a time."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) + 1, U64, padded, strides=(1,))
    one = mix64(sizes.astype(U64) + U64(0x9E3779B97F4A7C15))
    two = mix64(one ^ U64(0xC2B2AE3D27D4EB4F))
    on, at = np.arange(len(starts)), 0
    while len(on):
        left = np.minimum(sizes[on] - at, 8).astype(U64)
        part = eight[starts[on] + at] & (U64(0xFFFFFFFFFFFFFFFF) >> ((U64(8) - left) * U64(8)))
        one[on] = mix64(one[on] ^ part)
        two[on] = mix64(two[on] + part * U64(0x165667B19E3779F9))
        at += 8
        on = on[sizes[on] > at]
    return one, two


class Chunks:
    """The chunks of some texts and which of them are equal."""

    def __init__(self, by: Segmenter, texts: pa.Array):
        self.data, off = by.spread(texts)
        self.starts = by.bounds(self.data, off)
        self.sizes = np.diff(np.append(self.starts, len(self.data)))
        self.of_text = np.searchsorted(self.starts, off)  # the first chunk of each text, and the end
        short = np.flatnonzero(self.sizes <= LONG)
        one, two = keys(self.data, self.starts[short], self.sizes[short])
        held = pa.array(one).dictionary_encode()
        row = held.indices.to_numpy()
        first = np.zeros(len(held.dictionary), np.int64)
        first[row[::-1]] = np.arange(len(row))[::-1]
        # What the second hash tells apart, and long chunks, are distinct ones of their own.
        odd = np.flatnonzero(two != two[first[row]])
        away = np.concatenate((short[odd], np.flatnonzero(self.sizes > LONG)))
        self.row = np.empty(len(self.starts), np.int64)
        self.row[short] = row
        self.row[away] = len(first) + np.arange(len(away))
        self.first = np.concatenate((short[first], away))  # a chunk of each distinct one
        self.keyed, self.one, self.two = len(first), one[first], two[first]

    def texts(self, distinct: np.ndarray) -> pa.Array:
        """The text of distinct chunks, by their number."""
        at, size = self.starts[self.first[distinct]], self.sizes[self.first[distinct]]
        ends = np.cumsum(size)
        data = self.data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - (ends - size), size)]
        return pa.StringArray.from_buffers(len(size), pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(data))


class Known:
    """Ids of chunks by their keys, and of the chunks that a task adds while its memory lasts."""

    def __init__(self, by: Segmenter, chunks: pa.Array, ids: pa.ListArray):
        data, off = text_bytes(chunks)
        one, two = keys(data, off[:-1], np.diff(off))
        order = np.argsort(one)
        self.by, self.one, self.two = by, one[order], two[order]
        starts = np.asarray(ids.offsets).astype(np.int64)
        self.sizes, self.starts, self.ids = np.diff(starts)[order], starts[:-1][order] - starts[0], np.asarray(ids.flatten(), np.int32)
        self.own: dict[str, list[int]] = {}
        self.held = 0

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's begin."""
        found = Chunks(self.by, texts)
        at = np.minimum(np.searchsorted(self.one, found.one), max(len(self.one) - 1, 0))
        hit = (self.one[at] == found.one) & (self.two[at] == found.two) if len(self.one) else np.zeros(found.keyed, bool)
        n = len(found.first)
        sizes, starts = np.zeros(n, np.int64), np.zeros(n, np.int64)
        hits = np.flatnonzero(hit)
        sizes[hits], starts[hits] = self.sizes[at[hits]], self.starts[at[hits]]
        away = np.concatenate((np.flatnonzero(~hit), np.arange(found.keyed, n)))
        others = found.texts(away).to_pylist()
        if self.held > REMEMBER:
            self.own, self.held = {}, 0
        new = [c for c in dict.fromkeys(others) if c not in self.own]
        self.own.update(zip(new, self.by.segment(new), strict=True))
        self.held += sum(map(len, new))
        put = [self.own[c] for c in others]
        sizes[away] = np.fromiter(map(len, put), np.int64, len(put))
        starts[away] = len(self.ids) + np.cumsum(sizes[away]) - sizes[away]
        pool = np.concatenate((self.ids, np.fromiter(itertools.chain.from_iterable(put), np.int32))) if put else self.ids
        size = sizes[found.row]
        ends = np.cumsum(size)
        ids = pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[found.row] - (ends - size), size)]
        return ids, np.concatenate(([0], ends))[found.of_text]


@functools.lru_cache(1)
def _known(model: bytes, rows: bytes) -> Known:
    held = pa.ipc.open_stream(rows).read_all().combine_chunks()
    none = pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))
    return Known(segmenter(model), *(held[c].chunk(0) if held.num_rows else x for c, x in zip(("chunk", "chunk_ids"), none, strict=True)))


def chunk_table(docs: DataFrame, model: bytes) -> DataFrame:
    """(chunk, n, chunk_ids) of all chunks that occur at least twice in the texts of docs, in the shared folder."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, parts, rows = segmenter(given.value), [], 0

        def told() -> list[pa.RecordBatch]:
            return pa.concat_tables(parts).group_by("chunk").aggregate([("n", "sum")]).rename_columns(["chunk", "n"]).to_batches(20_000) if parts else []

        for b in by_bytes(batches):
            found = Chunks(by, b.column("text"))
            parts.append(pa.table({"chunk": found.texts(np.arange(len(found.first))), "n": np.bincount(found.row, minlength=len(found.first)).astype(np.int64)}))
            rows += len(found.first)
            if rows > GATHER:
                yield from told()
                parts, rows = [], 0
        yield from told()

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = segmenter(given.value)
        for b in batches:
            found = by.segment(b.column("chunk").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("chunk"), b.column("n"), pa.array(found, pa.list_(pa.int32()))], names=["chunk", "n", "chunk_ids"])

    counted = docs.select("text").mapInArrow(count, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n")).filter("n > 1")
    return written(counted.mapInArrow(segment, "chunk string, n long, chunk_ids array<int>"), "chunks")


def frequent(chunks: DataFrame, most: int = TABLE_BYTES) -> bytes:
    """The levels of frequency (by powers of two, from the top) that fit into so many bytes, as an Arrow stream."""
    size = F.octet_length("chunk") + 4 * F.size("chunk_ids") + 8
    levels = chunks.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.sum(size).alias("bytes")).orderBy(F.desc("level")).collect()
    fit = [x.level for x, total in zip(levels, itertools.accumulate(x.bytes for x in levels), strict=True) if total <= most]
    held = chunks.filter(F.col("n") >= 2 ** min(fit, default=62)).select("chunk", "chunk_ids").toArrow()
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, held.schema) as to:
        to.write_table(held)
    return out.getvalue().to_pybytes()


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: str = MODEL, most: int = TABLE_BYTES, decoded: bool = False) -> DataFrame:
    """docs (text and others) with piece_ids: what the library gives for the text, without begin and end ids; and, if
    asked for, with the text that these ids decode to. The model is read by the driver and broadcast (half a megabyte)."""
    docs = without(docs, "piece_ids", *["decoded"] * decoded)
    sc, data = docs.sparkSession.sparkContext, _read(model)
    given, rows = sc.broadcast(data), sc.broadcast(frequent(chunk_table(docs, data), most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(given.value, rows.value)
        for b in by_bytes(batches):
            ids, ends = known.encode(b.column("text"))
            made = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))]
            if decoded:
                made.append(_decoded(known.by, made[0]))
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, "piece_ids", *["decoded"] * decoded])

    added = StructType().add("piece_ids", ArrayType(IntegerType())).add("decoded", StringType())
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added.fields[: 1 + decoded]]))


def _decoded(by: Segmenter, ids: pa.Array) -> pa.Array:
    flat, sizes = ids.flatten().to_numpy().tolist(), pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes).tolist()
    return pa.array(by.model.decode([flat[a:b] for a, b in zip([0, *ends], ends, strict=False)], num_threads=1) if ends else [], pa.string())


def decode(held: DataFrame, model: str = MODEL) -> DataFrame:
    """held (piece_ids and others) with decoded: the library's text of the ids."""
    held = without(held, "decoded")
    given = held.sparkSession.sparkContext.broadcast(_read(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 256):
            yield pa.RecordBatch.from_arrays([*b.columns, _decoded(segmenter(given.value), b.column("piece_ids"))], names=[*b.schema.names, "decoded"])

    return held.mapInArrow(run, StructType([*held.schema.fields, *StructType().add("decoded", StringType()).fields]))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded=True)
    ids = F.array_join(F.transform("piece_ids", lambda i: i.cast("string")), ",")
    return read.select("doc_id", F.size("piece_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
