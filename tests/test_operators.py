"""Operators on small cases: golden values, brute force, streams against their batch twins, round trips."""

from __future__ import annotations

import datetime
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import evaluate as E
from sievework.operators import extract as X
from sievework.operators.fuzzy import best_fuzzy_match
from sievework.operators.lookups import tiered_lookup
from sievework.sources import tables
from sievework.streaming import requests as R


def one(spark, column, **values):
    return spark.range(1).select(column(*[F.lit(v) for v in values.values()])).first()[0]


def test_text_functions(spark):
    lit = lambda f, *a: spark.range(1).select(f(*[F.lit(x) for x in a])).first()[0]
    assert lit(T.norm_space, "  a  b\n") == "a b" and lit(T.norm_or_blank, " NaN ") == "" and lit(T.norm_space, None) == ""
    assert lit(T.name_key, "Arts &amp; Crafts (New)") == "arts and crafts new"
    assert lit(T.url_key, "HTTPS://A.org/x//#y") == "https://a.org/x/"
    assert lit(T.program_tokens, "Nursing (RN) – nursing aide") == ["aide", "nursing"]
    assert lit(T.to_number, "5d") is None and lit(T.to_number, " 7.50 ") == 7.5 and lit(T.clamp_mark, "120") == 100.0
    assert lit(T.to_ymd, "2024-02-03T10:00") == "2024-02-03" and lit(T.to_ymd, "2/3/2024") == "2024-02-03" and lit(T.to_ymd, "soon") == ""
    assert lit(T.count_strict, "Twelve") is None and lit(T.count_strict, "ten") == 10 and lit(T.count_any, "12 units") == 12
    assert lit(T.root_domain, "a.b.example.org") == "example.org" and lit(T.is_same_site, "a.org", "www.a.org")
    assert lit(T.resolve_url, "http://a.org/x/y?z", "../w") == "http://a.org/x/../w" and lit(T.resolve_url, "http://a.org", "//b.org/c") == "http://b.org/c"
    assert lit(T.should_skip_url, "x.PDF") and not lit(T.should_skip_url, "http://a.org/x")
    assert lit(lambda c: T.requirement_mode("english", c, F.lit("")), "ELA 30-1") == "course" and lit(lambda c: T.requirement_mode("math", c, F.lit("")), "Accuplacer") == "placement_assessment"


def test_normalisers_are_idempotent(spark):
    df = spark.createDataFrame([(x,) for x in ("  A  b ", "x&y", "", None, "null", "é – (z)", "http://A.org/#q")], "c string")
    for f in (T.norm_space, T.norm_or_blank, T.name_key, T.url_key, T.course_key, T.clean_competitive):
        assert df.filter(f(f("c")) != f("c")).count() == 0


@pytest.mark.parametrize(
    "text,value",
    [("Average of five courses", 5), ("based on 4 subjects", 4), ("an average of 15 then based on 6 courses", 6), ("average", None)],
)
def test_average_count(spark, text, value):
    got = one(spark, X.average_count, t=text)
    assert (got and got["value"]) == value


def test_courses(spark):
    t = "Physics 30 or chemistry 30, with ELA 30-1 or 30-2 (65% in ELA 30-1)"
    assert one(spark, lambda c: X.courses(c, X.SCIENCE), t=t) == ["Physics 30", "Chemistry 30"]
    assert one(spark, lambda c: X.with_shorthand(c, X.courses(c, X.ENGLISH), "English"), t=t) == ["English 30-1", "English 30-2"]
    assert one(spark, lambda c: X.course_minimum(c, X.ENGLISH), t=t) == 65


def test_fields_resolve_as_the_fold_does(spark):
    rng = random.Random(8)
    names = ["none", "low", "medium", "high"]
    rows = [(p, "f", i, "x" * rng.randint(1, 4) + str(i), rng.choice(names), "r", "u") for p in range(40) for i in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, "program_id long, field string, seq int, value string, confidence string, rule_id string, source_url string").repartition(5)
    final, kept = {}, set()
    for p, _, i, v, c, _, _ in rows:
        mine = (names.index(c), len(v))
        if p not in final or mine >= final[p][0]:
            final[p] = (mine, v)
            kept.add((p, i))
    assert {r.program_id: r.value for r in X.resolve_fields(df).collect()} == {p: v for p, (_, v) in final.items()}
    assert {(r.program_id, r.seq) for r in X.accepted_evidence(df).collect()} == kept


def best_subset(items, need, caps, count, groups):
    def search(rules):
        for n in range(need, 0, -1):
            best = None
            for chosen in itertools.combinations(items, n):
                for way in itertools.product(*[g for g, _ in chosen]):
                    if rules and any(way.count(g) > c for g, c in caps.items()):
                        continue
                    if rules and count and sum(g in groups for g in way) < count:
                        continue
                    best = max(best or 0, sum(m for _, m in chosen)) if best is not None else sum(m for _, m in chosen)
            if best is not None:
                return n, best
        return None

    return search(True) or search(False) or (0, 0)


def test_electives_against_all_subsets(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for case in range(60):
        items = [(rng.choice([["A"], ["B"], ["C"], ["D"], ["B", "C"]]), float(rng.randint(40, 99))) for _ in range(rng.randint(1, 6))]
        need, caps = rng.randint(1, 4), {g: rng.randint(0, 2) for g in "ABCD" if rng.random() < 0.4}
        count, groups = (rng.randint(1, 3), rng.sample("ABCD", 2)) if rng.random() < 0.5 else (None, None)
        want[case] = best_subset(items, need, caps, count, groups)
        rows += [(case, f"c{i}", g, m, need, [caps.get(x) for x in "ABCD"], [(count, groups)] if count else None, 0.0) for i, (g, m) in enumerate(items)]
    df = spark.createDataFrame(rows, "id int, course_key string, groups array<string>, mark double, need int, caps array<int>, sets array<struct<n:int,groups:array<string>>>, least double")
    assert {r.id: (r.n_chosen, r.total) for r in E.select_electives(df, ["id"]).collect()} == want


def test_evaluation(spark):
    columns = "row_id long, english_req string, english_requirement_mode string, english_min string, math_req string, math_requirement_mode string, math_min string, science_req string"
    programs = spark.createDataFrame([
        (1, "30-1", "", "60", "", "", "", ""), (2, "30-2", "", "", "Math 30-1 and Math 31", "", "", ""), (3, "", "", "", "", "", "", "Two of Biology 30, Chemistry 30, Physics 30"),
        (4, "Placement test", "", "", "", "", "", ""), (5, "", "", "", "", "", "", ""), (6, "20-2", "", "", "", "", "", "Science 30 or Physics 30"),
    ], columns)
    marks = [(1, "ELA 30-1", 55.0), (1, "English Language Arts 30-1", 61.0), (1, "Bio 30", 70.0), (1, "PHYSICS 30", 50.0), (2, "English 30-2", 80.0), (2, "math 30-1", 70.0), (2, "Mathematics 31", 65.0)]
    marks = spark.createDataFrame([(i, s, c, m) for i, (s, c, m) in enumerate(marks)], "seq long, student_id long, course string, mark double")
    got = E.evaluate(programs, E.course_marks(marks)).join(E.program_classes(programs), "class_id")
    status = {(r.student_id, r.row_id): r.status for r in got.collect()}
    likely, no, unknown = "likely eligible", "ineligible", "uncheckable"
    assert [status[1, i] for i in range(1, 7)] == [likely, no, likely, unknown, unknown, likely]
    assert [status[2, i] for i in range(1, 7)] == [no, likely, no, unknown, unknown, no]


def test_fuzzy_policies(spark):
    mk = lambda rows: spark.createDataFrame(rows, "id long, block string, tokens array<string>, name string, url string")
    left = mk([(1, "x", ["a", "b", "c"], "", ""), (2, "y", ["a", "b"], "", ""), (3, "x", ["q"], "", ""), (4, "x", [], "", "")])
    right = mk([(10, "x", ["a", "b", "c"], "n", "u"), (11, "x", ["a", "b", "c", "d"], "n", "v"), (12, "y", ["a", "b"], "m", "w"), (13, "y", ["a", "b"], "k", "w")])
    got = lambda p, gap: {r.left_id: (r.right_id, r.status) for r in best_fuzzy_match(left, right, 0.6, gap, p).collect()}
    assert got("gap", 0.1) == {1: (10, "matched"), 2: (None, "ambiguous"), 3: (None, "none"), 4: (None, "none")}
    assert got("gap", 0.3)[1] == (None, "ambiguous") and got("distinct_name", 0.3)[1] == (10, "matched")
    assert got("distinct_url", 0.1)[2][1] == "matched"


def test_tiers(spark):
    left = spark.createDataFrame([(1, "a", "p"), (2, "b", "q"), (3, "", "z")], "id long, k1 string, k2 string")
    right = spark.createDataFrame([(7, "a", "p"), (8, "a", "x"), (9, "b", "q")], "rid long, k1 string, k2 string")
    tiers = [("first", F.col("k1"), F.col("k1")), ("second", F.col("k2"), F.col("k2"))]
    got = {r.left_id: (r.right_id, r.tier, r.status) for r in tiered_lookup(left, right, tiers, "id", "rid").collect()}
    assert got == {1: (None, "first", "ambiguous"), 2: (9, "first", "matched"), 3: (None, None, "missing")}
    assert {r.left_id: r.right_id for r in tiered_lookup(left, right, tiers, "id", "rid", True).collect()} == {1: 7, 2: 9, 3: None}


def requests(spark, rows=400):
    rng = random.Random(6)
    at, out = {}, []
    for i in range(rows):
        who = rng.randint(1, 4)
        at[who] = at.get(who, 0) + rng.choice([500, 1500, 2000, 2500, 9000, 70_000])
        out.append((who, i, datetime.datetime(2024, 1, 1) + datetime.timedelta(milliseconds=at[who]), "p"))
    return out, spark.createDataFrame(out, "identity long, seq long, ts timestamp, payload string")


def test_throttle_batch_and_stream(spark, tmp_path):
    rows, df = requests(spark)
    want, state = {}, {}
    for who, seq, ts, _ in rows:
        ms = int(ts.timestamp() * 1000)
        last, begin, n = state.get(who, (None, None, 0))
        if last is not None and ms - last < 2000:
            want[seq] = "too_soon"
            continue
        if begin is None or ms - begin >= 60_000:
            begin, n = ms, 0
        want[seq] = "too_many" if n + 1 > 5 else "passed"
        state[who] = (ms, begin, n + 1)
    assert {r.seq: r.verdict for r in R.throttle_batch(df, most=5).collect()} == want
    df.filter("seq < 150").coalesce(1).write.parquet(str(tmp_path / "in/a"))
    df.filter("seq >= 150").coalesce(1).write.parquet(str(tmp_path / "in/b"))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = R.throttle_stream(stream, most=5).writeStream.format("memory").queryName("verdicts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.seq: r.verdict for r in spark.sql("SELECT * FROM verdicts").collect()} == want


def test_cache_hits(spark):
    rows = [(1, 0, 0), (1, 1, 100), (1, 2, 180), (1, 3, 181), (1, 4, 300), (2, 5, 10), (1, 6, 900)]
    df = spark.createDataFrame([(w, s, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=t), "p") for w, s, t in rows], "identity long, seq long, ts timestamp, payload string")
    assert {r.seq: r.hit for r in R.cache_hits(df).collect()} == {0: False, 1: True, 2: True, 3: False, 4: True, 5: False, 6: False}


def test_long_runs_of_one_identity(spark):
    """200,000 requests without a silence, of one identity: more than a fold over one array can take."""
    ms = F.col("id") * 1000
    df = spark.range(200_000).select(F.lit(1).cast("long").alias("identity"), F.col("id").alias("seq"), F.timestamp_millis(ms).alias("ts"), F.lit("p").alias("payload"))
    got = R.throttle_batch(df, min_gap=0, window=60_000, most=50)
    assert {r["verdict"]: r["count"] for r in got.groupBy("verdict").count().collect()} == {"passed": 166_670, "too_many": 33_330}
    assert R.cache_hits(df, ttl=9_000).filter("NOT hit").agg(F.count("*"), F.max(F.col("seq") % 10)).first()[:] == (20_000, 0)
    at_ttl = spark.createDataFrame([(None, 0, None), (None, 1, 5), (None, 2, 14), (None, 3, 15)], "identity long, seq long, s long")
    at_ttl = at_ttl.select("identity", "seq", F.timestamp_seconds("s").alias("ts"), F.lit(None).cast("string").alias("payload"))
    assert {r.seq: r.hit for r in R.cache_hits(at_ttl, ttl=9_000).collect()} == {0: False, 1: False, 2: True, 3: False}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿Program,URL,Notes\n Art ,http://a.org,nan\n,http://b.org,x\n", encoding="utf-8")
    df = tables.read_table(spark, str(tmp_path / "t.csv"), {"name": ("program_name", "Program"), "url": ("url",), "notes": ("notes",)}, ("name",))
    assert [tuple(r) for r in df.collect()] == [("Art", "http://a.org", ""), ("", "http://b.org", "x")]
    with pytest.raises(ValueError):
        tables.read_table(spark, str(tmp_path / "t.csv"), {"cost": ("price",)}, ("cost",))
    tables.write_table(df, str(tmp_path / "out"), ["url", "name"])
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["url", "name"]
    (tmp_path / "rules.json").write_text(json.dumps({"blocked": [" A ", "b"]}))
    assert tables.read_rules(spark, str(tmp_path / "rules.json"), ("blocked", "other")) == {"blocked": ("a", "b"), "other": ()}
    for p, n in (("p1", "01"), ("p1", "02"), ("p2", "01")):
        (tmp_path / "docs" / p).mkdir(parents=True, exist_ok=True)
        (tmp_path / "docs" / p / f"{n}.txt").write_text(f"URL: http://{p}.org/{n}\nbody {n}\nmore")
    got = sorted((r.program_id, r.doc_seq, r.url, r.text) for r in tables.read_documents(spark, str(tmp_path / "docs")).collect())
    assert got[1] == ("p1", 1, "http://p1.org/02", "body 02\nmore") and len(got) == 3
    (tmp_path / "m.json").write_text('{"student_id": 1, "courses": {"Math 31": 80, "Art 30": 70.5}}\n')
    assert sorted(tuple(r) for r in tables.read_marks(spark, str(tmp_path / "m.json")).collect()) == [(1, "Art 30", 70.5), (1, "Math 31", 80.0)]


def test_publish(spark, tmp_path):
    folder = str(tmp_path / "pub")
    df = spark.range(10).withColumn("x", F.lit("v"))
    assert tables.latest_version(spark, folder) is None
    assert tables.publish_snapshot(df, folder, ["id"]) == 1 and tables.publish_snapshot(df.filter("id < 5"), folder, ["id", "x"]) == 2
    assert tables.read_latest(spark, folder).count() == 5
    with pytest.raises(ValueError):
        tables.publish_snapshot(df.filter("false"), folder, ["id"])
    with pytest.raises(ValueError):
        tables.publish_snapshot(df, folder, ["missing"])
    assert tables.read_latest(spark, folder).count() == 5
    assert tables.content_stamp(df.repartition(7)).first() == tables.content_stamp(df.orderBy(F.desc("id"))).first()


def test_link_ranking(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", '<a href="/tuition">Fees</a><a href="admission-requirements"><b>Admission</b> requirements</a><a href="mailto:x@y">m</a><a href="http://b.org/admissions">Other</a><a href="/apply">Apply</a>')], "page_id long, url string, html string")
    assert [r.url for r in X.top_links(X.html_links(pages)).orderBy("place").collect()] == ["http://a.org/admission-requirements", "http://a.org/apply"]
    assert spark.range(1).select(X.html_text(F.lit("<p>a&amp;b<script>x</script></p>\n<i>c</i>"))).first()[0] == "a&b c"


def test_refresh_and_live_evaluation(spark, tmp_path):
    from sievework.streaming import refresh

    spark.range(5).withColumn("x", F.lit("v")).coalesce(1).write.parquet(str(tmp_path / "full"))
    stream = spark.readStream.schema("id long, x string").parquet(str(tmp_path / "full"))
    refresh.incremental_refresh(stream, str(tmp_path / "pub"), str(tmp_path / "c1"), ["id"]).awaitTermination(120)
    assert tables.read_latest(spark, str(tmp_path / "pub")).count() == 5
    columns = "row_id long, english_req string, english_requirement_mode string, english_min string, math_req string, math_requirement_mode string, math_min string, science_req string"
    programs = spark.createDataFrame([(1, "30-1", "", "60", "", "", "", "")], columns)
    marks = spark.createDataFrame([(0, 1, "English 30-1", 70.0), (1, 2, "English 30-1", 50.0)], "seq long, student_id long, course string, mark double")
    marks.coalesce(1).write.parquet(str(tmp_path / "marks"))
    live = spark.readStream.schema(marks.schema).parquet(str(tmp_path / "marks"))
    refresh.live_evaluation(live, programs, str(tmp_path / "live"), str(tmp_path / "c2")).awaitTermination(120)
    assert {r.student_id: r.status for r in spark.read.parquet(str(tmp_path / "live")).collect()} == {1: "likely eligible", 2: "ineligible"}
    q = R.audit_stream(audit_source(spark, tmp_path), str(tmp_path / "audit"), str(tmp_path / "c3"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 3


def audit_source(spark, tmp_path):
    df = spark.createDataFrame([(1, i, datetime.datetime(2024, 1, 1), "e") for i in range(3)], "identity long, seq long, ts timestamp, event_type string")
    df.coalesce(1).write.parquet(str(tmp_path / "events"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "events"))
