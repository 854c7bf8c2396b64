"""Pieces, spelling variants and hard negatives: against the library, brute force and SQL; nulls, ties, long texts, empty tables."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import string
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from conftest import SF
from oracle import compare

from sievework.llm import line_dedup, negatives, pieces, queries, spelling, toxicity

CLASH = "doc_id long, text string, PIECE_IDS int, decoded string, word int"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def odd_texts():
    rng = random.Random(7)
    long = " ".join(rng.choice(["Straße", "naïve", "日本語", "x" * 30, "a\n\nb", "12345", "  ", "▁"]) for _ in range(30_000))
    return [
        None, "", " ", "   ", "a", " a", "a  b ", "▁", "▁▁a▁", "\n", "\n\n a\nb \n", "tab\tand nbsp　wide", "nul\x00byte", "hello<s> <0x41> </s> <unk>", "ﬁ Å é́ ẞ", "\U0001f600\U0001f468‍\U0001f469",
        "x" * 20_000, long, "a  b ", "line one\nline two\r\nline three", " sep ", " \n \n ",
    ]


@pytest.mark.parametrize("most", [pieces.TABLE_BYTES, 200, 0])
def test_pieces_against_the_library(spark, library, most):
    rows = [(i, t, 1, "clash", 2) for i, t in enumerate(odd_texts())] + [(None, "a  b ", 1, "clash", 2)] * 2
    docs = spark.createDataFrame(rows, CLASH).repartition(3)
    held = pieces.decode(pieces.encode(docs, most=most)) if most else pieces.encode(docs, most=most, decoded=True)
    assert held.columns == ["doc_id", "text", "word", "piece_ids", "decoded"]
    got = held.collect()
    assert len(got) == len(rows)
    for r in got:
        want = library.encode(r.text or "")
        assert r.piece_ids == want and r.decoded == library.decode(want), (r.doc_id, r.text)


def test_pieces_of_an_empty_table_and_no_ids(spark):
    empty = spark.createDataFrame([], CLASH)
    assert pieces.decode(pieces.encode(empty)).count() == 0
    got = pieces.decode(spark.createDataFrame([(1, None), (2, [])], "id long, piece_ids array<int>")).collect()
    assert [r.decoded for r in got] == ["", ""]


def test_a_model_whose_pieces_cross_markers_is_not_cut(library):
    texts = pa.array(["a b\nc", None, "x" * 300 + " a b"])
    by = pieces.Segmenter(library.serialized_model_proto())
    cut = pieces.Chunks(by, texts)
    assert by.apart and cut.texts(cut.row).to_pylist() == [" a", " b", "\nc", " " + "x" * 300, " a", " b"] and cut.of_text.tolist() == [0, 3, 3, 6]
    by.apart = by.lines = False
    cut = pieces.Chunks(by, texts)
    assert cut.texts(cut.row).to_pylist() == ["a b\nc", "x" * 300 + " a b"] and by.segment(["a b\nc"]) == [library.encode("a b\nc")]


def test_keys_tell_bytes_apart():
    rng = random.Random(2)
    spans = list({bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 40))) for _ in range(3000)})
    ends = np.cumsum([len(x) for x in spans])
    sizes = np.array([len(x) for x in spans])
    data = np.frombuffer(b"".join(spans), np.uint8)
    for h in pieces.keys(data, ends - sizes, sizes):
        assert len(set(h.tolist())) == len(spans)


def test_op11_whole_table(spark, library):
    got = {r.doc_id: r for r in queries.QUERIES["op11_sentencepiece"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in docs:
        ids = library.encode(r.text or "")
        assert tuple(got[r.doc_id]) == (r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


def brute_variants(words: dict[str, int], ratio: int = spelling.RATIO):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= ratio * n:
            form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return out


def brute_words(docs, drop=spelling.DROP):
    low, counts = str.maketrans(string.ascii_uppercase, string.ascii_lowercase), collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if drop and h % drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= spelling.MIN_LENGTH:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= spelling.MIN_COUNT}


NAMES = ("word", "form", "root", "n", "n_near", "form_n")


@pytest.mark.parametrize("alphabet", ["ab", "abcé", "a"])
def test_searches_find_each_pair_once(alphabet):
    rng = random.Random(alphabet)
    for _ in range(60):
        words = {"".join(rng.choice(alphabet) for _ in range(rng.randint(2, 10))): rng.randint(2, 3000) for _ in range(rng.randint(1, 60))}
        got = collections.Counter()
        for mirrored in (False, True):
            for w, _, k, best, n in spelling.best_near(list(words.items()), list(words.items()), mirrored):
                got[w] += k
                assert one_edit(w, best) and words[best] == n
        assert {w: got[w] for w in words} == {w: sum(one_edit(w, v) for v in words) for w in words}


def test_search_steps_are_counts_of_suffixes():
    """Intervals against a sorted list of suffixes."""
    words = sorted({"banana", "bandana", "ananas", "nab"})
    codes = np.array([ord(c) for w in words for c in w])
    index = spelling.Index(codes, np.array([len(w) for w in words]))
    suffixes = sorted((w[i:], k) for k, w in enumerate(words) for i in range(len(w) + 1))
    for pattern in ["a", "na", "ana", "ban", "s", "x"]:
        # The words that end so: patterns are read from the delimiter to the left.
        lo, hi = np.array([0]), np.array([len(words)])
        for c in reversed(pattern):
            lo, hi = index.step(np.array([ord(c)]), lo), index.step(np.array([ord(c)]), hi)
        assert hi[0] - lo[0] == sum(w.endswith(pattern) for w in words)
        assert [s for s, _ in suffixes[lo[0] : hi[0]]] == [pattern] * (hi[0] - lo[0])


@pytest.mark.parametrize("shard", [spelling.SHARD, 40])
def test_variants_against_brute_force(spark, shard):
    """Chains of forms, ties, one half that nearly all words share, long words, repeated rows, nulls."""
    rng = random.Random(11)
    stem = "verbind"
    texts = [(1, " ".join(["connection"] * 1200)), (2, " ".join(["conection"] * 90 + ["conectio"] * 8)), (None, "conectoo conectoo"), (3, None), (4, ""), (5, " 12 ,, "), (6, "Connection CONNECTION Àbcdefgh àbcdefgh"), (6, "Connection CONNECTION Àbcdefgh àbcdefgh")]
    texts += [(10 + i, " ".join(stem + "".join(rng.choice("xyz") for _ in range(rng.randint(1, 7))) for _ in range(60))) for i in range(12)]
    texts += [(40, " ".join(["q" * 3000, "q" * 3001] * 3)), (41, "wordone wordtwo wordone wordtwo wordtwx wordtwx wordonx wordonx")]
    docs = spark.createDataFrame([(i, t, 5) for i, t in texts], "doc_id long, text string, WORD int").repartition(4)
    want = brute_variants(brute_words(texts))
    got = spelling.group_variants(spelling.vocabulary(docs), shard=shard).select(*NAMES).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert spelling.group_variants(spelling.vocabulary(docs.filter("false")), shard=shard).count() == 0


def test_roots_follow_chains(spark):
    words = {"abcdefg": 5, "abcdefgh": 60, "abcdefghi": 700, "abcdefghij": 8000, "abcdefghijk": 90_000, "abcdefghijkl": 1_000_000}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {tuple(r) for r in spelling.group_variants(frame).select(*NAMES).collect()}
    assert got == brute_variants(words) and {r[2] for r in got} == {"abcdefghijkl"}


@pytest.mark.parametrize("name", ["op12_spelling", "op13_hard_negatives"])
def test_sql_of_the_new_queries(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), queries.ORACLES[name], SF) == ""


def brute_negatives(rows, is_anchor):
    out = collections.Counter()
    usable = [(i, lab, [int(np.floor(256 * x)) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for a, lab, q in {(i, lab, tuple(q)) for i, lab, q in usable if is_anchor(i)}:
        scored = sorted((-sum(x * y for x, y in zip(q, r, strict=True)), i, other) for i, other, r in usable if len(r) == len(q) and i != a)
        for s, p, _ in [x for x in scored if x[2] == lab][:5]:
            fit = [(i, -t) for t, i, other in scored if other != lab and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out.update((a, p, k + 1, i, -s, t) for k, (i, t) in enumerate(fit))
    return out


@pytest.mark.parametrize("few", [True, False])
def test_negatives_against_brute_force(spark, monkeypatch, few):
    if few:
        monkeypatch.setattr(negatives, "GROUP", 60)
        monkeypatch.setattr(negatives, "BLOCK", 30)
        monkeypatch.setattr(negatives, "AT_ONCE", 200)
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 2), [rng.choice([-0.5, 0.0, 0.25, 0.3, 0.9]) for _ in range(3)]) for i in range(160)]
    rows += [(i, 1, [0.25, 0.3, 0.9]) for i in range(160, 200)]  # equal vectors: ties by id
    rows += [(200, None, [0.1, 0.2, 0.3]), (201, 1, None), (202, 1, [0.1, None, 0.3]), (203, 1, [float("nan"), 0.1, 0.2]), (204, 1, [float("inf"), 0.1, 0.2]), (None, 1, [0.9, 0.9, 0.9])]
    rows += [(205, 1, [0.5, 0.5]), (210, 1, [0.5, 0.4]), (206, 2, [0.5, 0.3]), (207, 2, []), (220, 2, []), (5, rows[5][1], rows[5][2]), (100, rows[100][1], rows[100][2])]
    rows += [(208, 1, [1e13, 1.0, 0.0]), (230, 1, [1e13, 0.0, 1.0]), (209, 2, [5e12, 3.0, 0.0])]  # beyond what doubles hold
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, label int, embedding array<double>, SCORE int").repartition(3)
    held = negatives.quantised(frame)
    got = negatives.mine(held, held.filter("vec_id % 10 = 0")).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    limit = (1 << 63) - 1
    want = collections.Counter()
    for r, n in brute_negatives(rows, lambda i: i % 10 == 0).items():
        if abs(r[4]) <= limit and abs(r[5]) <= limit:
            want[r] += n
    assert collections.Counter(map(tuple, got)) == want
    assert negatives.mine(held.filter("false"), held.filter("false")).count() == 0


def test_negatives_with_one_label_or_only_anchors(spark):
    frame = spark.createDataFrame([(i, 1, [float(i), 1.0]) for i in range(30)], "vec_id long, label int, embedding array<float>")
    held = negatives.quantised(frame)
    assert negatives.mine(held, held.filter("vec_id = 10")).count() == 0
    assert negatives.positives(held, held.filter("vec_id = 10").withColumn("anchor", held.vec_id)).count() == 5


def test_lines_of_very_long_pages(spark):
    """40,000 lines a page, half of them on all pages of the host; the work grows with the lines, not with their square."""
    def took(n: int) -> float:
        rows = [(k, "http://h.example/x", "<p>".join(f"shared {i}" if i % 2 else f"own {k} {i}" for i in range(n))) for k in range(4)]
        frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
        began = time.time()
        got = line_dedup.drop_boilerplate(frame, keep=["page_id"]).collect()
        assert all(r.n_lines == n and r.n_dropped == n // 2 and r.kept_text.count("\n") == n // 2 - 1 and "shared" not in r.kept_text for r in got)
        return time.time() - began

    took(1000)
    assert took(40_000) < 4 * took(10_000) + 4


def test_swaps_are_summed_whole(spark):
    """The sums that Spark makes over tasks against those of all sentences, with more kinds of swaps than any bound."""
    rng = random.Random(6)
    words = sorted(toxicity.SWAPS)
    texts = [". ".join(" ".join(rng.sample(words, rng.randint(1, 5))) for _ in range(6)) for _ in range(200)]
    terms = toxicity.term_features()
    swaps = [s for t in texts for s in toxicity.swapped(t)]
    assert len({(g.tobytes(), c.tobytes()) for g, c in swaps}) > 800
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    got = {r.at: r["sum(total)"] for r in frame.mapInArrow(toxicity._products, "at long, total long").groupBy("at").sum("total").collect()}
    want = toxicity.products(swaps, terms)
    assert got.pop(-1) == len(swaps) and got == {i: int(v) for i, v in enumerate(want.ravel()) if v or i in got}


def test_repeated_labels_count_once(spark):
    docs = spark.createDataFrame([(i, f"you scum {i}" if i % 2 else f"nice day {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    once, often = toxicity.fit(docs, labels), toxicity.fit(docs, labels.union(labels.filter("doc_id = 1")).union(labels.filter("doc_id = 1")))
    assert once[1] == often[1] and (once[0] == often[0]).all()
