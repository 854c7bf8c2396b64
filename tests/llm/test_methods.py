"""The operators against brute force, exact round trips, held-out accuracy and their SQL."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import struct
import time
import zlib

import numpy as np
import pyarrow.fs
import pytest
import zstandard
from conftest import SF
from oracle import compare
from pyspark.sql import functions as F

import corpus_pipeline
from sievework.llm import decontam, jaccard_join, langid, line_dedup, mixing, queries, sharding, tokens, toxicity, warc, webp
from sievework.llm.common import lowest, new_folder, table

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def low_words(text):
    return SPLIT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text):
    w = low_words(text)
    return frozenset(tuple(w[p : p + 5]) for p in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(texts: dict):
    sets = {d: shingle_set(t) for d, t in texts.items()}
    holders = collections.defaultdict(list)
    for d, s in sets.items():
        for k in s:
            holders[k].append(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for d, s in sets.items():
        for e, o in collections.Counter(e for k in s for e in holders[k] if e < d).items():
            if 100 * o >= 80 * (len(s) + len(sets[e]) - o):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), queries.ORACLES[name], SF) == ""


def near_copy_table():
    """Random texts, edits of them at all distances, chains, a group of many edits of one text, common passages."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(60)]
    out = {}
    for base in range(25):
        text = [word() for _ in range(rng.choice([3, 8, 30, 120]))] + (passage if base % 4 == 0 else [])
        for _ in range(rng.choice([1, 2, 6])):
            out[len(out)] = " ".join(text)
            text = list(text)
            for _ in range(rng.choice([0, 1, 2])):
                text[rng.randrange(len(text))] = word()
    hub = [word() for _ in range(150)]
    for _ in range(80):
        text = list(hub)
        for _ in range(rng.choice([1, 2, 3])):
            text[rng.randrange(len(text))] = word()
        out[len(out)] = " ".join(text)
    return out


@pytest.mark.parametrize("how", [{}, {"unit_tokens": 400}, {"hot": 3}, {"hot": 3, "unit_tokens": 400, "fragment_tokens": 500}])
def test_jaccard_join(spark, how):
    texts = near_copy_table()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs, **how).collect()}
    assert got == components(texts)


def test_jaccard_join_ties_few_variants_of_a_hot_text(spark):
    """Copies make a text hot, and its few variants lie in different salts: links across salts must hold."""
    rng, texts = random.Random(8), {}
    for g in range(60):
        own = [f"h{g}w{k}" for k in range(9)]
        for text in [own] * 20 + [[*own, f"h{g}more"], [*own[:-1], f"h{g}end"], [f"h{g}first", *own[1:]]]:
            texts[len(texts)] = " ".join(text)
    ids = list(texts)
    rng.shuffle(ids)
    texts = {i: texts[k] for k, i in enumerate(ids)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs, hot=3).collect()}
    assert got == components(texts)


@pytest.mark.parametrize("how", [{}, {"unit_tokens": 50}, {"hot": 3, "unit_tokens": 50}])
def test_jaccard_join_of_templates_that_do_not_link(spark, how):
    """Texts that share two thirds of their shingles with all others: candidates by a common phrase, no links; among
    them a few that do link, and chains of texts of growing length."""
    rng, texts = random.Random(11), {}
    for _ in range(400):
        texts[len(texts)] = " ".join([f"u{rng.randrange(10**6)}", *(f"t{k}" for k in range(12)), f"u{rng.randrange(10**6)}"])
    for n in range(14, 60):
        texts[len(texts)] = " ".join(f"t{k}" for k in range(n))
    for k in range(6):
        texts[len(texts)] = " ".join([*texts[k].split(), "more"])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs, **how).collect()}
    assert got == components(texts)


@pytest.mark.parametrize("count", [13, 1500])
def test_large_units_finish_in_few_rounds(spark, count):
    """One unit whose sets share most shingles but do not link, a group that does, and a chain of links."""
    rng = np.random.default_rng(4)
    core = rng.integers(0, 1 << 62, 40)
    sets = [np.concatenate([core[:32], rng.integers(0, 1 << 62, 8)]) for _ in range(count)]
    sets += [np.concatenate([core[:39], rng.integers(0, 1 << 62, 1)]) for _ in range(20)]
    chain = rng.integers(0, 1 << 62, 200)
    sets += [chain[k : k + 40] for k in range(0, 120, 3)]
    rows = [(7, k, 1000 + k, np.sort(s.astype(np.uint64)).tobytes()) for k, s in enumerate(sets)]
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    made = jaccard_join._large_units(spark.createDataFrame(rows, "root long, class long, doc_id long, tokens binary"))
    got = {r["class"]: r.component_id for r in made.collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup()) - len(before)
    label = jaccard_join._unit_links([np.frombuffer(r[3], np.uint64) for r in rows])
    assert got == {k: 1000 + int(label[k]) for k in got} and len(got) == len(rows)
    assert len(set(got.values())) == count + 2 and jobs < 250


def test_unit_links_leave_out_sets_that_cannot_link():
    """16,000 sets with a common core that do not link: the work is in proportion to them, not to their pairs."""
    rng = np.random.default_rng(5)
    core = rng.integers(0, 1 << 62, 8).astype(np.uint64)
    sets = [np.sort(np.concatenate([core, rng.integers(0, 1 << 62, 2).astype(np.uint64)])) for _ in range(16_000)]
    begin = time.monotonic()
    assert (jaccard_join._unit_links(sets) == np.arange(len(sets))).all()
    assert time.monotonic() - begin < 10


def test_unit_links_of_texts_made_of_two_blocks():
    """Each shares a block with many others and links with none: all candidates of a hub are counted in one step."""
    rng = np.random.default_rng(3)
    blocks = [rng.integers(0, 2**63, 50, dtype=np.uint64) for _ in range(60)]
    sets = [np.unique(np.concatenate([blocks[i], blocks[j]])) for i in range(60) for j in range(i)]
    began = time.monotonic()
    assert (jaccard_join._unit_links(sets) == np.arange(len(sets))).all()
    assert time.monotonic() - began < 5


def test_near_copies_with_ids_of_text(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [("b", " ".join(base)), ("a", " ".join(base[:-1])), ("c", "other words that stand for themselves here"), (None, None), ("d", " ".join(base)), ("", "one two")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a": (55, "a"), "b": (56, "a"), "d": (56, "a"), "c": (3, "c"), None: (0, None), "": (1, "")}
    kept = [r.doc_id for r in jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id string, text string")).collect()]
    assert sorted(map(str, kept)) == ["", "None", "a", "c"]


def test_unit_links_of_a_large_group(spark):
    """A group of near copies of one text and two that stay apart: reached sets cost nothing more."""
    rng = np.random.default_rng(6)
    core = rng.integers(0, 1 << 62, 100).astype(np.uint64)
    sets = [np.sort(np.concatenate([core[:96], rng.integers(0, 1 << 62, 4).astype(np.uint64)])) for _ in range(8000)]
    sets += [np.sort(np.concatenate([core[:84], rng.integers(0, 1 << 62, 16).astype(np.uint64)])) for _ in range(2)]
    begin = time.monotonic()
    label = jaccard_join._unit_links(sets)
    assert (label[:8000] == 0).all() and list(label[8000:]) == [8000, 8001]
    assert time.monotonic() - begin < 15


def test_jaccard_query(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op5_ngram_jaccard"](spark, SF).collect()}
    assert got == components(docs)


def brute_leaks(docs: dict, items: dict):
    sets = {i: shingle_set(t) for i, t in items.items()}
    df = collections.Counter(s for x in sets.values() for s in x)
    weight = lambda s: math.log1p(len(items) / df[s]) if s in df else math.log1p(len(items))
    out = set()
    for d, t in docs.items():
        w = low_words(t)
        for i, s in sets.items():
            n = len(low_words(items[i]))
            for at in range(max(1, len(w) - n + 1)):
                win = shingle_set(" ".join(w[at : at + n]))
                if win & s and sum(map(weight, win & s)) / sum(map(weight, win | s)) >= 0.8:
                    out.add((d, i))
    return out


def test_decontamination(spark):
    rng = random.Random(2)
    word = lambda: f"v{rng.randrange(5000)}"
    items = {i: " ".join(word() for _ in range(rng.choice([14, 30, 58]))) for i in range(12)}
    items[20] = "tiny item words"
    docs = {}
    for d in range(40):
        text = [word() for _ in range(rng.choice([5, 80]))]
        if d % 2:
            leak = items[rng.choice(list(items))].split()
            if d % 5 == 0:
                leak[rng.randrange(len(leak))] = word()
            if d % 7 == 0:
                leak.insert(len(leak) - 2, word())
            at = rng.randrange(len(text))
            text[at:at] = [x.upper() for x in leak]
        docs[d] = " ".join(text)
    make = lambda rows, n: spark.createDataFrame(list(rows.items()), f"{n} long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(make(docs, "doc_id"), make(items, "item_id")).collect()}
    assert got == brute_leaks(docs, items)


def test_decontamination_of_templated_items(spark):
    """Items under one of two templates, leaked under the other: the templates weigh little on both sides."""
    make = lambda name, n: [f"{name}{k}" for k in range(n)]
    own = {i: make(f"i{i}w", 104) for i in range(100)}
    items = {i: " ".join([*make("even" if i % 2 == 0 else "odd", 38), *own[i]]) for i in own}
    docs = {d: " ".join(["before", *make("odd" if d % 2 == 0 else "even", 38), *own[d], "after"]) for d in range(25)}
    docs[50] = " ".join([*make("odd", 38), *make("x", 104)])
    want = {(d, d) for d in range(25)}
    assert brute_leaks({d: docs[d] for d in (0, 1, 50)}, items) == {(0, 0), (1, 1)}
    got = decontam.leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_decontamination_of_repeated_and_unnamed_items(spark):
    texts = [" ".join(f"{c}{k}" for k in range(20)) for c in "abc"]
    items = spark.createDataFrame([(1, texts[0]), (1, texts[0]), (1, texts[1]), (None, texts[2])], "item_id long, text string")
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(7, f"{texts[0]} {texts[1]}"), (8, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.similarity) for r in decontam.leaks(docs, items).collect())
    assert got == [(0, 1, 1.0), (1, 1, 1.0), (2, None, 1.0), (7, 1, 1.0)]


def test_decontamination_query(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    items = {r.item_id: r.text for r in table(spark, SF, "benchmark").collect()}
    keys = {s for t in items.values() for s in shingle_set(t)}
    held = {d: t for d, t in docs.items() if shingle_set(t) & keys}
    assert {(r.doc_id, r.item_id) for r in queries.QUERIES["op1_decontamination"](spark, SF).collect()} == brute_leaks(held, items)


def test_blocks_find_all_within_the_radius(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), rng.randrange(decontam.RADIUS + 1)):
            b ^= 1 << k
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(rows, "a long, b long").select(decontam.blocks(F.col("a")).alias("a"), decontam.near_blocks(F.col("b")).alias("b"))
    assert df.filter(F.size(F.array_intersect("a", "b")) > 0).count() == len(rows)
    assert sum(limit + 1 for _, _, limit in decontam.layout()) == decontam.RADIUS + 1
    assert sum(w for _, w, _ in decontam.layout()) == decontam.BITS


def test_blocks_leave_out_unrelated_fingerprints(spark):
    rng = random.Random(10)
    rows = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(400)]
    df = spark.createDataFrame(rows, "a long, b long").select(decontam.blocks(F.col("a")).alias("a"), decontam.near_blocks(F.col("b")).alias("b"))
    assert df.filter(F.size(F.array_intersect("a", "b")) > 0).count() < 0.55 * len(rows)


def test_decontamination_finds_words_inserted_anywhere(spark):
    """Two words put in, taken out or changed at every place of an item, also under phrases that all items share."""
    make = lambda name, n: [f"{name}{k}" for k in range(n)]
    items = {i: [*make("open", 8), *make(f"i{i}w", 43), *make("close", 7)] for i in range(10)}
    docs = {}
    for place in range(0, 59, 2):
        i, n = items[place % 10], len(docs)
        docs[n] = [*make(f"d{n}x", 30), *i[:place], "new", "words", *i[place:], *make(f"d{n}y", 30)]
        docs[n + 1] = [*make(f"d{n}x", 30), *i[:place], *i[place + 2 :], *make(f"d{n}y", 30)]
        docs[n + 2] = [*i[:place], "changed", *i[place + 1 :]]
    docs[1000] = [*items[0], *items[0][5:]]
    docs[1001] = ["same"] * 300
    text = lambda rows: {k: " ".join(v) for k, v in rows.items()}
    docs, items = text(docs), text(items) | {90: "same " * 40}
    want = brute_leaks(docs, items)
    assert len({d for d, _ in want}) > 60
    make = lambda rows, n: spark.createDataFrame(list(rows.items()), f"{n} long, text string")
    got = decontam.leaks(make(docs, "doc_id"), make(items, "item_id")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want


def test_lookup_is_even_and_stable():
    many = sharding.lookup(32, 4099)
    counts = collections.Counter(many)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 32
    fewer = sharding.lookup(31, 4099)
    assert sum(a != b for a, b in zip(many, fewer, strict=True) if a != 31) < 0.15 * 4099


def test_mix_reruns_agree_and_positions_invert_demand(spark):
    docs = table(spark, SF, "documents")
    a = {r.doc_id: (r.taken, r.position) for r in mixing.assign(docs, per_range=7).collect()}
    b = {r.doc_id: (r.taken, r.position) for r in mixing.assign(docs.repartition(5), per_range=50).collect()}
    assert a == b
    for x, y in mixing.SCHEDULES:
        for share in (0.1, 0.5, 0.9):
            t = spark.range(1).select(mixing.position(F.lit(share), F.lit(x), F.lit(y))).first()[0]
            assert abs(x * t + (y - x) * t * t / 2 - share) < 1e-5


def test_mix_repeats_pass_after_pass_along_the_demand(spark):
    rows = [(k, " ".join(["w"] * (3 + k % 5)), "abc"[k % 3]) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    order = [r.doc_id for r in mixing.mix(docs, per_range=40).filter("source = 'a'").collect()]
    assert len(order) == 400 and len(set(order[:200])) == 200 and order[:200] == order[200:]
    held = mixing.copies(docs, per_range=40).select("source", "mix_at", "mix_words", "target", "source_size").collect()
    over = {r.source: r.target / r.source_size for r in held}
    assert over["a"] == 2 and 1.2 < over["b"] < 1.9 and over["c"] < 1
    for s, (x, y) in zip("abc", mixing.SCHEDULES, strict=True):
        own = [r for r in held if r.source == s]
        for t in (0.25, 0.5, 0.75, 1.0):
            want = own[0].target * (x * t + (y - x) * t * t / 2)
            assert abs(sum(r.mix_words for r in own if r.mix_at <= t) - want) <= 8


def test_mix_spreads_texts_without_an_id(spark):
    """Texts without an id, or all under one, lie in many ranges."""
    rows = [(None if k % 2 else 5, f"word {k} of many", "a") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed = mixing._placed(docs, 50).withColumn("range", F.substring("mix_hash", 1, 1))
    assert placed.select("range").distinct().count() == 16
    assert abs(placed.agg(F.sum("taken")).first()[0] - 12_000) <= 1 and placed.filter("taken > 2 * size").isEmpty()


def test_hidden_elements_end_at_their_own_tag(spark):
    pages = [
        "<p>a</p><script>if (x) '</style>' more</script><p>b</p>",
        "<p>a</p><style>p { } <script> </style><p>b</p>",
        "<p>a</p><script>never closed <p>b</p>",
        "<p>a</p><!-- <p>b</p>",
        "<p>a " + "<" * 200_000,
        "<script " * 50_000 + "<p>a",
    ]
    df = spark.createDataFrame(list(enumerate(pages)), "k long, html string")
    begin = time.monotonic()
    got = [r.lines for r in df.select("k", line_dedup.page_lines(F.col("html")).alias("lines")).orderBy("k").collect()]
    assert got[:4] == [["a", "b"], ["a", "b"], ["a"], ["a"]] and got[5][-1] == "a"
    assert time.monotonic() - begin < 20


def test_mix_query_splits_what_it_does_not_take(spark):
    placed = queries.QUERIES["op4_mixing"](spark, SF)
    held = [r for r in placed.withColumn("part", F.spark_partition_id()).collect() if r.position is None]
    assert [r.doc_id for r in held] == sorted(r.doc_id for r in held)
    plan = placed._jdf.queryExecution().toString()
    assert "position" in plan and "doc_id" in plan.split("RepartitionByExpression", 1)[1].splitlines()[0]


def test_language_held_out(spark):
    got = queries.QUERIES["op3_language_id"](spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)


def test_kernel_ridge_is_exact_on_its_landmarks():
    texts = [b"the cat and the dog", b"der hund und die katze", b"the house of the lord", b"das haus und der herr"]
    sets = [langid.grams(np.frombuffer(t, np.uint8)) for t in texts]
    model = langid.solve(sets, ["en", "de", "en", "de"], ridge=1e-9)
    raw = model.scores([np.frombuffer(t, np.uint8) for t in texts], model.tables())
    assert [model.languages[k] for k in raw.argmax(1)] == ["en", "de", "en", "de"] and np.abs(raw.max(1) - 1).max() < 1e-2
    k = lambda a, b: len(np.intersect1d(a, b)) / math.sqrt(len(a) * len(b))
    marks = langid.Landmarks(sets)
    assert all(abs(v - k(a, b)) < 1e-12 for a in [*sets, np.array([5], np.uint32)] for v, b in zip(marks.kernel(a), sets, strict=True))


def brute_kernel(texts, labels, landmarks):
    """The classifier in plain Python: gram sets of characters' bytes, kernels one by one, normal equations."""

    def grams(text):
        data = bytes((c + 32 if 65 <= c <= 90 else c) if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 0 for c in text.encode())
        while b"\0\0" in data:
            data = data.replace(b"\0\0", b"\0")
        return {data[i : i + n] for n in (1, 2, 3) for i in range(len(data) - n + 1)}

    sets = [grams(t) for t in texts]
    names = sorted(set(labels))
    marks = [s for y in names for s in [s for s, z in zip(sets, labels, strict=True) if z == y][:landmarks]]
    k = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    within = np.array([[k(a, b) for b in marks] for a in marks])
    value, vector = np.linalg.eigh(within)
    keep = value > 1e-6 * value.max()
    whiten = vector[:, keep] / np.sqrt(value[keep])
    phi = np.array([[k(a, b) for b in marks] for a in sets]) @ whiten
    phi = np.hstack([phi, np.ones((len(phi), 1))])
    weight = np.diag([1 / labels.count(y) for y in labels])
    penalty = langid.RIDGE * np.trace(phi.T @ weight @ phi) / phi.shape[1] * np.eye(phi.shape[1])
    penalty[-1, -1] = 1e-9
    goal = np.array([[1.0 if y == z else -1.0 for z in names] for y in labels])
    beta = np.linalg.solve(phi.T @ weight @ phi + penalty, phi.T @ weight @ goal)

    def score(text):
        own = grams(text)
        f = np.array([k(own, b) for b in marks]) @ whiten if own else np.zeros(keep.sum())
        return names, np.append(f, 1.0) @ beta

    return score


def test_language_query_is_brute_force(spark):
    """op3 on a small table: every row's language and score as kernels computed one by one give them."""
    rng = random.Random(12)
    own = {"aa": "kilo meta sun", "bb": "rau fel oin", "cc": "bar tuk ygg", None: "kilo fel ygg"}
    rows = []
    for d in range(160):
        lang = rng.choice(list(own))
        rows.append((d, " ".join(rng.choice(own[lang].split()) + rng.choice("abc") for _ in range(rng.randrange(1, 30))), lang))
    rows += [(200, None, "aa"), (201, "123 --", "bb"), (202, "", None), (203, "KILOA kiloa " * 3, "aa"), (204, "kiloa kiloa " * 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    folder = new_folder(spark, "small")
    docs.write.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op3_language_id"](spark, folder).collect()}
    crc = lambda d: zlib.crc32(str(d).encode())
    assert all(got[d].held_out == (crc(d) % 4 == 2) for d, _, _ in rows)
    learned = [(t, y) for d, t, y in rows if crc(d) % 4 != 2 and t is not None and t != "" and y is not None]
    # The fit's order: language, then the bytes of the set.
    sets = lambda t: langid.grams(np.frombuffer(t.encode(), np.uint8)).tobytes()
    learned.sort(key=lambda r: (r[1], sets(r[0])))
    score = brute_kernel([t for t, _ in learned], [y for _, y in learned], langid.LANDMARKS)
    for d, t, _ in rows:
        if t is None or not any(c.isalpha() for c in t):
            assert (got[d].lang_pred, got[d].score) == ("und", 0.0)
            continue
        names, raw = score(t)
        assert abs(got[d].score - min(max((raw.max() + 1) / 2, 0), 1)) < 2e-3
        assert got[d].lang_pred == names[int(raw.argmax())] or sorted(raw)[-1] - sorted(raw)[-2] < 5e-3
    assert (got[203].lang_pred, got[203].score) == (got[204].lang_pred, got[204].score)


def test_language_fit_leaves_no_language_out(spark):
    rows = [(k, f"l{k % 400:03d}".translate(str.maketrans("0123456789", "abcdefghij")) * 3, f"x{k % 400}") for k in range(1200)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 400 and model.weights.shape == (len(model.vocabulary), 400)


def test_language_fit_on_executors_is_that_in_memory(spark, monkeypatch):
    """Sums over bins, and blocks of them, give the model that one solve over all sets gives; also after a new deal of rows."""
    monkeypatch.setattr(langid, "BIN_ROWS", 7)
    monkeypatch.setattr(langid, "BLOCK", 10)
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang")
    found = langid.fit(docs)
    rows = langid.lowest(docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang").distinct(), "lang", "doc_id", langid.PER_LANGUAGE).join(docs, ["doc_id", "lang"]).collect()
    sets = sorted((r.lang, langid.grams(np.frombuffer(r.text.encode(), np.uint8)).tobytes()) for r in rows)
    want = langid.solve([np.frombuffer(g, np.uint32) for _, g in sets], [y for y, _ in sets])
    assert found.languages == want.languages and (found.vocabulary == want.vocabulary).all()
    assert np.abs(found.weights - want.weights).max() < 1e-4 * np.abs(want.weights).max() and np.abs(found.bias - want.bias).max() < 1e-4
    again = langid.fit(docs.repartition(5))
    assert (again.weights == found.weights).all() and (again.bias == found.bias).all()


def test_lowest_is_bounded_and_repeatable(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 50 == 0, "b").otherwise("a").alias("y"))
    got = collections.Counter(r.y for r in lowest(df, "y", "id", 300).collect())
    assert got == {"a": 300, "b": 300}
    same = {r.id for r in lowest(df.repartition(7), "y", "id", 300).collect()}
    assert same == {r.id for r in lowest(df, "y", "id", 300).collect()}


def test_toxicity_query_is_brute_force(spark):
    """op9 on a small table: every row's score from plain dicts of features and a plain gradient descent."""
    rng = random.Random(13)
    rows, labels = [], []
    for d in range(240):
        toxic = rng.random() < 0.4
        said = [rng.choice(["river", "stone", "garden", "women", "men", "muslims", "jews"]) for _ in range(8)] + (["awful", "stupid"] if toxic else ["gentle"])
        rng.shuffle(said)
        rows.append((d, " ".join(said) + "."))
        labels.append((d, int(toxic)))
    rows += [(500, None), (501, ""), (502, "stupid " * 20000), (503, "Stupid " * 20000)]
    folder = new_folder(spark, "small")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op9_toxicity"](spark, folder).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for d, r in got.items())
    assert got[500].score == got[501].score and got[502].score == got[503].score >= 0.5

    def feats(text):
        w = re.findall(r"[^\W\d_]+", (text or "").lower())
        return {("w", x) for x in w} | {("p", x[:5]) for x in w if len(x) > 5}

    y = dict(labels)
    learn = [(feats(t), y[d], t) for d, t in rows if d in y and zlib.crc32(str(d).encode()) % 5]
    df = collections.Counter(f for x, _, _ in learn for f in x)
    names = sorted(f for f, n in df.items() if n >= toxicity.MIN_DF)
    x = np.array([[f in s for f in names] for s, _, _ in learn], float)
    goal = np.array([c for _, c, _ in learn], float)
    change = []
    for _, _, t in learn:
        if any(w in toxicity.SWAPS for w in t[:-1].split()):
            a, b = feats(t), feats(" ".join(toxicity.SWAPS.get(w, w) for w in t[:-1].split()))
            change.append([(f in a) - float(f in b) for f in names])
    change, w, b = np.array(change), np.zeros(len(names)), 0.0
    for _ in range(6000):
        e = (1 / (1 + np.exp(-(x @ w + b))) - goal) / len(goal)
        w -= 0.5 * (x.T @ e + toxicity.RIDGE * w + toxicity.SWAP * change.T @ (change @ w) / len(change))
        b -= 0.5 * e.sum()
    for d, t in rows[:240]:
        want = 1 / (1 + math.exp(-(b + sum(w[names.index(f)] for f in feats(t) if f in names))))
        assert abs(want - got[d].score) < 0.1, (d, want, got[d].score)


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = queries.QUERIES["op9_toxicity"](spark, d).join(table(spark, d, "labels"), "doc_id").filter("held_out").collect()
    toxic = [r for r in got if r.toxic == 1]
    assert sum(r.predicted for r in got if r.toxic == 0) <= 0.01 * len(got) and sum(r.predicted for r in toxic) >= 0.8 * len(toxic)


def test_swaps_even_out_identity_terms():
    rng = random.Random(4)
    fill = lambda: " ".join(rng.choice(["we", "saw", "many", "people", "there", "today"]) for _ in range(8))
    toxic = [f"{fill()} muslims are scum {fill()}." for _ in range(60)] + [f"{fill()} scum {fill()}." for _ in range(20)]
    clean = [f"{fill()} christians {fill()}." for _ in range(60)] + [fill() for _ in range(60)]
    texts, y = toxic + clean, np.array([1] * 80 + [0] * 120)
    have, swaps = [toxicity.one(t) for t in texts], [s for t in texts for s in toxicity.swapped(t)]
    assert len(swaps) == 120

    def score(model, text):
        w, b = model
        return 1 / (1 + math.exp(-(b + float(w[toxicity.one(text)].sum()))))

    mean = toxicity.products(swaps, toxicity.term_features()) / len(swaps)
    plain, fair = toxicity.solve(have, y, None, (0.6, 0.4)), toxicity.solve(have, y, mean, (0.6, 0.4), swap=5.0)
    odds = lambda p: math.log(p / (1 - p))
    gap = lambda m: odds(score(m, "many muslims live there")) - odds(score(m, "many christians live there"))
    assert gap(plain) > 0.5 and abs(gap(fair)) < 0.2 * gap(plain)
    assert score(fair, "they are scum there") > 0.5 > score(fair, "many muslims live there")


def test_token_edits_equal_recounts():
    rng, count = random.Random(1), tokens.counter()
    parts = ["  ", "a", "b'll", "\n\n", " ", "1", "é", "!?", "\t", "word", "'s", "9 9", "　", "\U0001f600"]
    text = lambda n: "".join(rng.choice(parts) for _ in range(n))
    encoded = reencoded = 0
    for _ in range(500):
        own = text(rng.choice([0, 1, 3, 10, 60, 400]))
        tree = tokens.build(own, count)
        for _ in range(rng.choice([1, 4])):
            at, remove, put = rng.randint(0, len(own) + 2), rng.choice([0, 1, 2, 50]), text(rng.choice([0, 1, 2, 40]))
            a = min(at, len(own))
            own = own[:a] + put + own[min(a + remove, len(own)) :]
            tree, n = tokens.edit(tree, at, remove, put, count)
            whole = tokens.build(own, count)
            reencoded, encoded = reencoded + n, encoded + whole.pretokens
            assert (tree.text, tree.tokens, sum(tree.lengths, [])) == (own, whole.tokens, sum(whole.lengths, []))
    assert reencoded < encoded / 2


def test_many_edits_of_one_text_cost_their_regions():
    """Ten thousand edits, some of which grow or empty leaves, over a text of 200,000 words."""
    rng, count = random.Random(3), tokens.counter()
    own = [f"w{k % 977} " for k in range(200_000)]
    tree, begin = tokens.build("".join(own), count), time.monotonic()
    for k in range(10_000):
        at = rng.randrange(tree.sums[1][0])
        tree, _ = tokens.edit(tree, at, rng.choice([0, 3, 3, 40, 900 if k % 50 == 0 else 1]), rng.choice(["", "x", " new words", "a b c d " * 9]), count)
    assert time.monotonic() - begin < 20
    whole = tokens.build(tree.text, count)
    assert (whole.tokens, whole.pretokens) == (tree.tokens, tree.pretokens)


def test_redactions_are_those_of_the_pattern():
    rng = random.Random(6)
    parts = ["a", "b.c", "@", ".", "co", "123", "456789", " ", "-", "x@y.org", "%", "é", "@@", "1234567"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        own = text
        for at, n, put in tokens.redactions(text):
            own = own[:at] + put + own[at + n :]
        assert own == re.sub(tokens.REDACT, "[redacted]", text), text


def test_runs_without_blanks_are_counted_whole(spark):
    long = "QmFzZTY0" * (1 << 17)
    begin = time.monotonic()
    assert tokens.redactions(long) == [] and len(tokens.redactions(long + "@x.org")) == 1
    assert time.monotonic() - begin < 5
    df = spark.createDataFrame([(1, long, "a"), (2, "a b", "b"), (2, "a b", "b")], "doc_id long, Text string, edits string").withColumnRenamed("Text", "text")
    got = sorted((r.doc_id, r.n_tokens, r.edits) for r in tokens.count_edited(df, tokens.redactions).collect())
    assert got[1:] == [(2, 2, "b")] * 2 and got[0][1] > len(long) / 16
    assert time.monotonic() - begin < 60


def test_token_query(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.VOCABULARY, "rb"))}
    whole = tiktoken.Encoding("test", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    for r in queries.QUERIES["op10_token_counts"](spark, SF).collect():
        assert r.n_tokens == len(whole.encode_ordinary(text[r.doc_id]))
        assert r.n_tokens_edited == len(whole.encode_ordinary(re.sub(tokens.REDACT, "[redacted]", text[r.doc_id]))), text[r.doc_id]


def test_bundles_are_plain_zstandard(spark):
    folder = new_folder(spark, "warc")
    pages = table(spark, SF, "pages")
    warc.write_archive(pages, folder)
    fs, root = warc.store(folder)
    html = {r.page_id: r.html for r in pages.collect()}
    seen = 0
    for info in fs.get_file_info(pyarrow.fs.FileSelector(root)):
        if info.path.endswith(".zst"):
            with fs.open_input_file(info.path) as f:
                frames = warc.seek_table(f)
                f.seek(0)
                data = f.read()
            plain = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(data)
            assert sum(p for _, _, p in frames) == len(plain)
            at = 0
            while at < len(plain):
                head, block, at = warc.parse(plain, at)
                assert block == warc.HTTP_HEAD + html[int(head["WARC-Record-ID"][10:-1])].encode()
                seen += 1
    assert seen == len(html)
    head, block = warc.fetch(spark, folder, 3)[0]
    assert block.endswith(html[3].encode())


def test_media_query(spark):
    import hashlib
    import zlib

    text = {r.doc_id: (r.text or "").encode() for r in table(spark, SF, "documents").collect()}
    for r in queries.QUERIES["op8_media"](spark, SF).collect():
        p = text[r.doc_id]
        p += b"\xff" * ((-len(p)) % 576 or (0 if p else 576))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        stored = webp.store_payload(text[r.doc_id])
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


# A small writer that uses every part of the format; what it wrote, decode must give back.


class Full(webp.Writer):
    def code(self, lengths):
        """A normal prefix code whose lengths are all 0, 5, 6, 8 or 9, written plainly."""
        used = sorted({n for n in lengths})
        own = {n: 2 if len(used) > 2 else 1 for n in used}
        if len(used) == 3:
            own[used[0]] = 1
        self.put(0, 1)
        self.put(19 - 4, 4)
        for k in webp.LENGTH_ORDER:
            self.put(own.get(k, 0), 3)
        self.put(0, 1)
        codes = canonical([own.get(k, 0) for k in range(19)]) if len(used) > 1 else [(0, 0)] * 19
        for n in lengths:
            self.put(*codes[n])

    def image(self, px, w, main, cache_bits=0, copies=True, meta=0):
        """px: ARGB numbers. Green: 256 literals of nine bits, 32 other symbols of six; distances: 32 of five."""
        self.put(int(bool(cache_bits)), 1)
        if cache_bits:
            self.put(cache_bits, 4)
        if main:
            self.put(int(meta > 0), 1)
            if meta:
                h = len(px) // w
                across, down = (w + (1 << meta) - 1) >> meta, (h + (1 << meta) - 1) >> meta
                self.put(meta - 2, 3)
                self.image([(i % 2) << 8 for i in range(across * down)], across, False)
        green = [9] * 256 + [6] * 24 + ([6] * 8 + [0] * ((1 << cache_bits) - 8) if cache_bits else [])
        if not cache_bits:
            green = [9] * 256 + [6] * 8 + [5] * 12 + [0] * 4
        groups = 2 if meta else 1
        for _ in range(groups):
            for lengths in (green, [8] * 256, [8] * 256, [8] * 256, [5] * 32 + [0] * 8):
                self.code(lengths)
        g, flat, dist = canonical(green), canonical([8] * 256), canonical([5] * 32 + [0] * 8)
        cache, at, used = [0] * (1 << cache_bits), 0, collections.Counter()
        while at < len(px):
            p, n = px[at], 0
            if copies and at and px[at] == px[at - 1]:
                while at + n < len(px) and px[at + n] == px[at - 1] and n < 1000:
                    n += 1
            k = (webp.CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
            if n >= 3:
                used["copy"] += 1
                s, extra, bits = prefix(n)
                if g[256 + s][1] == 0:
                    n, (s, extra, bits) = 3, prefix(3)
                self.put(*g[256 + s])
                self.put(extra, bits)
                s, extra, bits = prefix(2)  # the pixel to the left
                self.put(*dist[s])
                self.put(extra, bits)
            elif cache_bits and k < 8 and cache[k] == p:
                used["cache"] += 1
                n = 1
                self.put(*g[280 + k])
            else:
                n = 1
                self.put(*g[p >> 8 & 255])
                for part in (p >> 16 & 255, p & 255, p >> 24):
                    self.put(*flat[part])
            for q in px[at : at + n]:
                if cache_bits:
                    cache[(webp.CACHE_FACTOR * q & 0xFFFFFFFF) >> (32 - cache_bits)] = q
            at += n
        return used

    def file(self):
        data = b"\x2f" + self.value.to_bytes((self.size + 7) // 8, "little")
        return b"RIFF" + struct.pack("<I", 12 + len(data) + len(data) % 2) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def canonical(lengths):
    out, code, last = [(0, 0)] * len(lengths), 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        out[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
        code, last = code + 1, n
    return out


def prefix(value):
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    bits = v.bit_length() - 2
    return 2 * (bits + 1) + (v >> bits & 1), v & ((1 << bits) - 1), bits


def begin(w, h):
    out = Full()
    out.put(w - 1, 14)
    out.put(h - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    return out


def picture(w, h, seed, colours=None):
    rng = np.random.default_rng(seed)
    px = rng.integers(0, 256, (h, w, 4), dtype=np.uint8)
    if colours:
        px = rng.integers(0, 256, (colours, 4), dtype=np.uint8)[np.minimum(rng.integers(0, colours * 2, (h, w)), colours - 1)]
    return px


def argb(px):
    r, g, b, a = px.reshape(-1, 4).T.astype(np.int64)
    return (a << 24 | r << 16 | g << 8 | b).tolist()


@pytest.mark.parametrize("cache_bits,meta", [(0, 0), (4, 0), (6, 2), (0, 3)])
def test_webp_copies_cache_and_meta_codes(cache_bits, meta):
    px = picture(19, 13, 1, colours=5)
    out = begin(19, 13)
    out.put(0, 1)
    used = out.image(argb(px), 19, True, cache_bits, True, meta)
    assert used["copy"] and (cache_bits != 4 or used["cache"])
    assert (webp.decode(out.file()) == px).all()


def test_webp_palette():
    for colours in (2, 4, 11, 40):
        px = picture(21, 9, colours, colours)
        every, index = np.unique(px.reshape(-1, 4), axis=0, return_inverse=True)
        n, bits = len(every), 3 if len(every) <= 2 else 2 if len(every) <= 4 else 1 if len(every) <= 16 else 0
        table_ = np.array(argb(every))
        steps = [int(table_[0])] + [sum(((int(a) >> s & 255) - (int(b) >> s & 255) & 255) << s for s in (0, 8, 16, 24)) for a, b in zip(table_[1:], table_[:-1], strict=True)]
        out = begin(21, 9)
        out.put(1, 1)
        out.put(webp.PALETTE, 2)
        out.put(n - 1, 8)
        out.image(steps, n, False)
        out.put(0, 1)
        per, wide = 1 << bits, 8 >> bits
        rows = index.reshape(9, 21)
        rows = np.pad(rows, ((0, 0), (0, -21 % per))).reshape(9, -1, per)
        packed = (rows << (np.arange(per) * wide)).sum(-1)
        out.image([0xFF000000 | int(v) << 8 for v in packed.reshape(-1)], packed.shape[1], True)
        assert (webp.decode(out.file()) == px).all()


def test_webp_predictor_cross_colour_and_green():
    w, h, size = 22, 17, 2
    px = picture(w, h, 7)
    flat = np.array(px.reshape(-1, 4)[:, [3, 0, 1, 2]], np.int64)
    across, down = (w + 3) >> size, (h + 3) >> size
    modes = [i % 14 for i in range(across * down)]
    rest = flat.copy()
    for y in range(h):
        for x in range(w):
            rest[y * w + x] = (flat[y * w + x] - webp.predicted(flat, x, y, w, modes[(y >> size) * across + (x >> size)])) & 255
    rng = np.random.default_rng(3)
    factors = rng.integers(0, 256, (across * down, 3))
    for i in range(w * h):
        r2b, g2b, g2r = factors[(i // w >> size) * across + (i % w >> size)]
        one = lambda f, c: int(webp.colour_shift(np.array([f]), np.array([c]))[0])
        _, r, g, b = rest[i]
        rest[i, 3] = (b - one(g2b, g) - one(r2b, r)) & 255
        rest[i, 1] = (r - one(g2r, g)) & 255
    rest[:, 1], rest[:, 3] = (rest[:, 1] - rest[:, 2]) & 255, (rest[:, 3] - rest[:, 2]) & 255
    out = begin(w, h)
    for kind in (webp.PREDICTOR, webp.CROSS_COLOUR):
        out.put(1, 1)
        out.put(kind, 2)
        out.put(size - 2, 3)
        out.image([m << 8 for m in modes] if kind == webp.PREDICTOR else [int(a) << 16 | int(b) << 8 | int(c) for a, b, c in factors], across, False)
    out.put(1, 1)
    out.put(webp.SUBTRACT_GREEN, 2)
    out.put(0, 1)
    out.image([int(a) << 24 | int(r) << 16 | int(g) << 8 | int(b) for a, r, g, b in rest], w, True)
    assert (webp.decode(out.file()) == px).all()


@pytest.mark.parametrize("kind", ["text", "noise", "smooth", "green", "few", "runs", "one", "long"])
def test_webp_encodes_by_every_means(kind):
    """Each kind of image comes back, and is written by the means that suit it."""
    rng = np.random.default_rng(3)
    h, w = 40, 144
    if kind == "text":
        px = np.frombuffer(("the quick brown fox jumps over the lazy dog. and so on, " * 900).encode()[: h * w * 4], np.uint8).reshape(h, w, 4)
    elif kind == "noise":
        px = rng.integers(0, 256, (h, w, 4)).astype(np.uint8)
    elif kind == "smooth":
        px = (np.cumsum(rng.integers(0, 3, (h, w, 4)), 1) & 255).astype(np.uint8)
    elif kind == "green":
        px = (rng.integers(0, 256, (h, w, 1)) + rng.integers(0, 3, (h, w, 4)) & 255).astype(np.uint8)
    elif kind == "few":
        px = rng.integers(0, 256, (9, 4)).astype(np.uint8)[rng.integers(0, 9, (h, w))]
    elif kind == "runs":
        px = np.repeat(rng.integers(0, 256, (60, 4)).astype(np.uint8), rng.integers(1, 400, 60), 0)[: 20 * w]
        px = np.concatenate([px, np.zeros((20 * w - len(px), 4), np.uint8)]).reshape(20, w, 4)
    elif kind == "one":
        px = np.full((1, w, 4), 255, np.uint8)
    else:
        px = np.concatenate([rng.integers(97, 123, (300, w, 4)), np.full((300, w, 4), 7)]).astype(np.uint8)
    data = webp.encode(px)
    assert (webp.decode(data) == px).all()
    plain = px.size
    assert len(data) < {"text": 0.7, "noise": 1.05, "smooth": 0.35, "green": 0.75, "few": 0.2, "runs": 0.2, "one": 0.2, "long": 0.4}[kind] * plain
    for cut in (30, len(data) // 2):
        with pytest.raises(ValueError):
            webp.decode(data[:cut])


def test_webp_predicts_as_the_format_says():
    """Residuals of both modes against the format's rule pixel by pixel; the fast inverse against them."""
    rng = np.random.default_rng(8)
    px = rng.integers(0, 256, (5, 7, 4)).astype(np.int64)
    for mode in (1, 2):
        want = np.empty_like(px)
        for y in range(5):
            for x in range(7):
                if x == 0 and y == 0:
                    before = np.array([255, 0, 0, 0])
                elif y == 0 or (mode == 1 and x > 0):
                    before = px[y, x - 1]
                else:
                    before = px[y - 1, x]
                want[y, x] = (px[y, x] - before) & 255
        assert (webp.residuals(px, mode) == want).all()
        assert (webp._undo_predictor(want.reshape(-1, 4).copy(), 7, 5, np.array([mode]), 9) == px.reshape(-1, 4)).all()


def test_media_of_equal_texts_and_long_runs(spark):
    rows = [(1, "same text " * 50), (2, "same text " * 50), (3, "x" * 1_000_000), (4, None), (5, ""), (None, "é" * 700), (6, "a"), (6, "a")]
    got = webp.read_media(webp.store_media(spark.createDataFrame(rows, "doc_id long, text string"), new_folder(spark, "media"))).collect()
    assert len(got) == len(rows)
    for r in got:
        text = {d: t for d, t in rows}[r.doc_id] or ""
        raw = text.encode()
        raw += b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]))
    by = {r.doc_id: r for r in got}
    assert by[1].media_sha256 == by[2].media_sha256 and by[1].feature == by[2].feature and by[4].media_sha256 == by[5].media_sha256


def test_near_distances():
    assert webp.NEAR[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)] and webp.NEAR[-3:] == [(-7, 7), (8, 6), (8, 7)] and len(webp.NEAR) == 120


def test_pipeline(spark):
    docs = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    items = {r.item_id: r.text for r in table(spark, SF, "benchmark").collect()}
    known = {d for d, r in docs.items() if any(c.isalpha() for c in r.text or "")}
    single = {d for d, (_, c) in components({d: docs[d].text for d in known}).items() if c == d}
    keys = {s for t in items.values() for s in shingle_set(t)}
    clean = single - {d for d, _ in brute_leaks({d: docs[d].text for d in single if shingle_set(docs[d].text) & keys}, items)}
    got = collections.Counter(r.doc_id for r in corpus_pipeline.run(spark, SF).collect())
    want = {r.doc_id: r.copies for r in mixing.assign(table(spark, SF, "documents").filter(F.col("doc_id").isin(*clean))).collect()}
    assert dict(got) == {d: n for d, n in want.items() if n}
    owner = sharding.lookup()
    for r in corpus_pipeline.run(spark, SF).select("doc_id", "slot", "shard").distinct().collect():
        assert owner[r.slot] == r.shard
