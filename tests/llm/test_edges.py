"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sievework.llm import decontam, jaccard_join, langid, line_dedup, mixing, sharding, tokens, toxicity, warc, webp
from sievework.llm.common import new_folder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred int, slot string, SHARD int, size string, taken string, position string, predicted string, host int, n_tokens string"


def docs(spark, empty=False):
    rng = random.Random(3)
    words = [f"wort{i}" for i in range(400)]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    texts = [
        (1, "The quick brown fox jumps over the lazy dog again and again", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, " \t\n ", "de", "b"), (5, "12 34 !!", "de", "b"),
        (6, long, "de", "b"), (7, "The quick brown fox jumps over the lazy dog again and again", "en", None), (7, "The quick brown fox jumps over the lazy dog again and again", "en", None),
        (None, "ein Satz mit ein paar Worten darin und noch mehr", "de", "c"), (None, None, None, None), (8, "x", "en", "c"), (9, "Ünïcode wörds — \U0001f600 and tabs\tand\x0bmore", "en", "c"),
    ]
    rows = [] if empty else [(i, t, l, s, len(t or ""), "clash", 1, "clash", 2, "clash", "clash", "clash", "clash", 3, "clash") for i, t, l, s in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("empty", [False, True])
def test_sharding(spark, empty):
    d = docs(spark, empty)
    got = sharding.shard(d).collect()
    assert len(got) == d.count() and all(0 <= r.shard < sharding.SHARDS for r in got)
    by = {}
    for r in got:
        assert by.setdefault(r.doc_id, r.shard) == r.shard


@pytest.mark.parametrize("empty", [False, True])
def test_mixing(spark, empty):
    d = docs(spark, empty)
    got = mixing.assign(d, per_range=2).collect()
    assert len(got) == d.count()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and (r.position is None) == (r.taken == 0) and r.copies in (0, 1, 2)
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
    assert mixing.mix(d).columns == [c for c in d.columns]
    assert mixing.mix(d).count() == sum(r.copies for r in got)


@pytest.mark.parametrize("empty", [False, True])
def test_language(spark, empty):
    d = docs(spark, empty)
    model = langid.fit(d.select("doc_id", "text", "lang"))
    got = langid.predict(d, model).collect()
    assert len(got) == d.count() and (model is None) == empty
    for r in got:
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    kept = langid.keep_known(d, model)
    assert kept.columns == d.columns and kept.count() == sum(r.lang_pred != "und" for r in got)
    assert langid.predict(d, None).filter("lang_pred <> 'und'").count() == 0


@pytest.mark.parametrize("empty", [False, True])
def test_jaccard(spark, empty):
    d = docs(spark, empty)
    got = jaccard_join.join(d)
    rows = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id is None, r.component_id or 0) for r in got.collect())
    assert len(rows) == d.count()
    if not empty:
        by = {i: (n, c) for _, i, n, _, c in rows}
        assert by[1] == (8, 1) and by[7] == (8, 1) and by[2] == (0, 2) and by[4] == (0, 4) and by[8] == (1, 8) and by[5] == (1, 5)
        kept = sorted(r.doc_id for r in jaccard_join.keep_one(d).collect() if r.doc_id)
        assert kept == [1, 2, 3, 4, 5, 6, 8, 9]


@pytest.mark.parametrize("empty", [False, True])
def test_decontamination(spark, empty):
    d = docs(spark, empty)
    bench = spark.createDataFrame([(1, "THE quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (4, "x"), (5, "nothing here at all matches this")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(d, bench).collect()}
    assert got == (set() if empty else {(1, 1), (7, 1), (8, 4)})
    assert decontam.leaks(d, bench.filter("false")).count() == 0
    left = decontam.drop_leaks(d, bench)
    assert left.columns == d.columns and left.count() == (0 if empty else 8)


def test_filters_take_no_other_text_of_an_id(spark):
    leak, clean, other = "one two three four five six seven", "red orange yellow green blue indigo violet", "some other words that nobody else here has"
    d = spark.createDataFrame([(None, leak), (None, clean), (3, leak), (3, clean), (4, other), (None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    key = lambda rows: sorted(((r.doc_id, r.text) for r in rows), key=str)
    assert key(decontam.drop_leaks(d, bench).collect()) == sorted([(None, clean), (3, clean), (4, other), (None, None)], key=str)
    d = spark.createDataFrame([(1, leak), (2, leak), (2, clean), (None, leak), (None, other)], "doc_id long, text string")
    assert key(jaccard_join.keep_one(d).collect()) == sorted([(1, leak), (2, clean), (None, other)], key=str)


@pytest.mark.parametrize("empty", [False, True])
def test_toxicity(spark, empty):
    d = docs(spark, empty)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 10)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(d, labels if not empty else labels.filter("false"))
    got = toxicity.predict(d, model).collect()
    assert len(got) == d.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.predict(d, toxicity.fit(d, labels.filter("toxic = 0"))).filter("predicted = 1").count() == 0


@pytest.mark.parametrize("empty", [False, True])
def test_tokens(spark, empty):
    d = docs(spark, empty)
    got = tokens.count_edited(d, tokens.redactions).collect()
    count = tokens.counter()
    assert sorted(r.n_tokens for r in got) == sorted(tokens.build(r.text, count).tokens for r in d.collect())


@pytest.mark.parametrize("empty", [False, True])
def test_media(spark, empty):
    d = docs(spark, empty)
    got = webp.read_media(webp.store_media(d, new_folder(spark, "media"))).collect()
    assert len(got) == d.count()
    for r in got:
        assert r.payload_bytes % 576 == 0 and r.payload_bytes >= max(576, r.n_bytes) and r.payload_bytes < r.n_bytes + 577


@pytest.mark.parametrize("empty", [False, True])
def test_warc(spark, empty):
    big = "<p>" + "same page " * 20 + "</p>"
    rows = [] if empty else [(1, "http://a.org/x y", big, 1), (2, None, big, 1), (2, None, big, 1), (3, "u\r\nv", None, 1), (4, "", "", 1), (None, "http://b.org", big, 1), (5, "http://ü.org", "kurz ü", 1), (6, "s", "kurz ü", 1)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string, payload int").repartition(2)
    folder = new_folder(spark, "warc")
    warc.write_archive(p, folder)
    got = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archive(spark, folder).collect()), key=str)
    n = len(big)
    assert got == ([] if empty else sorted([(0, n, "revisit", 1), (1, n, "response", None), (2, n, "revisit", 1), (2, n, "revisit", 1), (3, 0, "response", None), (4, 0, "response", None), (5, 7, "response", None), (6, 7, "response", None)], key=str))
    if not empty:
        head, block = warc.fetch(spark, folder, 5)[0]
        assert head["WARC-Type"] == "response" and block.endswith("kurz ü".encode())


@pytest.mark.parametrize("empty", [False, True])
def test_line_dedup(spark, empty):
    page = lambda i, h: (i, f"https://{h}/p{i}", f"<ul><li>Home</li></ul><p>own {i}</p><script>x</script>", 1)
    rows = [] if empty else [*(page(i, "a.org") for i in range(5)), page(9, "b.org"), (10, None, None, 1), (11, "nohost", "", 1), page(0, "a.org")]
    p = spark.createDataFrame(rows, "page_id long, url string, html string, HOST int")
    got = {(r.page_id, r.host, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.drop_boilerplate(p).collect()}
    assert got == (set() if empty else {*((i, "a.org", 2, 1, f"own {i}") for i in range(5)), (9, "b.org", 2, 0, "Home\nown 9"), (10, "", 0, 0, ""), (11, "", 0, 0, "")})
