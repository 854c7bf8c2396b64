"""Rule texts, rule tables in the evaluation, electives under several sets, summaries without products, live evaluation."""

from __future__ import annotations

import itertools
import random

import pytest
from conftest import SF
from test_admission import programs_of

from sievework.operators import admission as A
from sievework.operators import evaluate as E
from sievework.operators import rules as R
from sievework.plans.views import view
from sievework.streaming import refresh

GOLDEN = [
    ("at most 2 Group B", {"B": 2}, [], None),
    ("up to one admission subject from group D", {"D": 1}, [], None),
    ("Group B maximum of two subjects", {"B": 2}, [], None),
    ("max 2 courses from option C", {"C": 2}, [], None),
    ("Each subject must be >= 60", {}, [], 60.0),
    ("Two admission subjects must be from Groups A/B", {}, [(2, ["A", "B"])], None),
    ("Maximum of two Group B subjects; at most 1 option C", {"B": 2, "C": 1}, [], None),
    ("Maximum two from Group B electives; Options C: max 1 course; up to 1 from Group D's courses", {"B": 2, "C": 1, "D": 1}, [], None),
    ("max 3 Group A; MAX 2 GROUP A", {"A": 2}, [], None),
    ("1 admission subject must be from group C or A, D; one more from groups B; 1 more from Group B", {}, [(1, ["C", "A", "D"]), (1, ["B"])], None),
    ("two additional admission subject from groups B or B", {}, [(2, ["B"])], None),
    ("minimum mark of 60% in each", {}, [], None),
    ("no more than 3 Group A", {}, [], None),
    ("0 admission subjects must be from group A", {}, [], None),
    ("", {}, [], None),
    (None, {}, [], None),
]


def test_rule_texts(spark):
    frame = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(GOLDEN)], "id int, t string")
    for r in frame.select("id", R.elective_rules(frame.t).alias("r"), R.holds(R.elective_rules(frame.t)).alias("any"), R.summary(R.elective_rules(frame.t)).alias("said")).collect():
        text, caps, sets, least = GOLDEN[r.id]
        assert {g: n for g, n in zip("ABCD", r.r.caps, strict=True) if n is not None} == caps, text
        assert [(s.n, s.groups) for s in r.r.sets or []] == sets and r.r.least == least, text
        assert r.any == bool(caps or sets or least)
    said = frame.select(R.summary(R.elective_rules(frame.t)).alias("said")).collect()
    assert said[7].said == "max 2 from Group B; max 1 from Group C; max 1 from Group D" and said[9].said == "need 1 from Groups C/A/D; need 1 from Groups B" and said[4].said == "subject marks >= 60"
    pages = frame.select(R.suggestion(frame.t).alias("s")).collect()
    assert pages[12].s == "Maximum of 3 Group A subjects" and pages[5].s == "2 admission subject(s) from Groups A/B" and pages[11].s is None


def test_electives_under_two_sets_and_a_minimum_mark(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for case in range(60):
        items = [(rng.choice([["A"], ["B"], ["C"], ["D"], ["B", "C"]]), float(rng.randint(40, 99))) for _ in range(rng.randint(1, 6))]
        need, caps = rng.randint(1, 4), {g: rng.randint(0, 2) for g in "ABCD" if rng.random() < 0.3}
        sets, least = [(rng.randint(1, 2), rng.sample("ABCD", 2)) for _ in range(rng.randint(0, 2))], rng.choice([None, 60.0])
        usable = [i for i in items if least is None or i[1] >= least]

        def best(ruled, usable=usable, need=need, caps=caps, sets=sets):
            found = (0, 0.0)
            for n in range(1, need + 1):
                for chosen in itertools.combinations(usable, n):
                    for way in itertools.product(*[g for g, _ in chosen]):
                        if not ruled or all(way.count(g) <= c for g, c in caps.items()) and all(sum(g in gs for g in way) >= k for k, gs in sets):
                            found = max(found, (n, sum(m for _, m in chosen)))
            return found

        want[case] = best(True) if best(True)[0] else best(False)
        rows += [(case, f"c{i}", g, m, need, [caps.get(x) for x in "ABCD"], sets, least) for i, (g, m) in enumerate(items)]
    df = spark.createDataFrame(rows, "id int, course_key string, groups array<string>, mark double, need int, caps array<int>, sets array<struct<n:int,groups:array<string>>>, least double")
    assert {r.id: (r.n_chosen, r.total) for r in E.select_electives(df, ["id"]).collect()} == want


def people(spark, *marks):
    return E.course_marks(spark.createDataFrame([(i, *m) for i, m in enumerate(marks)], "seq long, student_id long, course string, mark double"))


def test_rules_reach_the_results(spark):
    """A row for each level of a rule: data, electives, program, institution, institutions of five, the default."""
    asks = {"english_req": "30-1", "english_min": "60", "min_avg_final": "65"}
    programs = programs_of(
        spark, asks | {"avg_total": "2"}, asks | {"elective_qty": "Two"}, asks, asks, asks | {"institution": "NAIT"}, asks | {"institution": "East"}, asks | {"avg_total": "3", "requirement_type": "at most 1 Group B"},
        asks | {"avg_total": "3", "display_for_high_school": "no"}, asks | {"avg_total": "3", "status": ""}, asks | {"avg_total": "3", "institution": "South"},
    )
    averages = spark.createDataFrame([("North", "*", "4", 1), ("North", " P3 ", "6", 2), ("North", "P3", "2.6", 3), ("North", "P3", "none", 4), ("North", "P4", "0", 5), ("North", None, "-1", 6), ("", "P1", "9", 7)], "institution string, program string, avg_total string, seq int")
    electives = spark.createDataFrame([("South", "*", "max 1 Group B", 1), ("South", "P10", "1 admission subject must be from groups C/D", 2), ("South", "", "max 1 Group B", 3), ("North", "P9", " ", 4)], "institution string, program string, rule_text string, seq int")
    marks = people(spark, (1, "English Language Arts 30-1", 70.0), (1, "Art 30", 90.0), (1, "Drama 30", 88.0), (1, "Physics 30", 60.0), (1, "Math 30-1", 62.0))
    got = {r.row_id: r for r in A.evaluate_people(programs, marks, avg_rules=averages, elective_rules=electives).collect()}
    assert {k: r.avg_courses for k, r in got.items()} == {1: 2, 2: 3, 3: 3, 4: 4, 5: 5, 6: 5, 7: 3, 9: 3, 10: 3}
    assert [k for k, r in got.items() if "defaulted to 5; set AvgRules" in r.notes] == [6]
    assert got[7].avg_used == "English 30-1=70, B (ART 30)=90, C (MATH 30-1)=62" and got[9].avg_used.endswith("B (ART 30)=90, B (DRAMA 30)=88")
    assert got[10].avg_used == "English 30-1=70, B (ART 30)=90, C (MATH 30-1)=62"
    plain = {r.row_id: r for r in A.evaluate_people(programs, marks).collect()}
    assert plain[3].avg_courses == 5 and plain[10].avg_used.endswith("B (DRAMA 30)=88")
    twice = R.with_rules(programs, averages, electives)
    assert twice.count() == programs.count() and twice.columns == [*programs.columns, "rule_total", "rule_text"]
    assert twice.filter("row_id = 10").first().rule_text == "max 1 Group B; 1 admission subject must be from groups C/D"


def test_sums_equal_rows_and_make_no_product(spark):
    programs, marks = view(spark, SF, "v_canonical"), E.course_marks(view(spark, SF, "v_marks"))
    pairs = E.evaluate(programs, marks).groupBy("student_id", "status").count().collect()
    held = E.evaluate_summary(programs, marks, "classes")
    assert {tuple(r) for r in held.collect()} == {tuple(r) for r in pairs}
    students = marks.groupBy("student_id").agg({"mark": "avg"}).toDF("student_id", "average")
    quick = A.quick_summary(students, programs, marks)
    rows = A.quick_check(students, programs, marks).collect()
    sums: dict = {}
    for r in rows:
        a, b = sums.get(r.student_id, (0, 0))
        sums[r.student_id] = (a + r.eligible, b + r.n_reasons)
    assert {r.student_id: (r.eligible, r.reasons) for r in quick.collect()} == sums
    for df in (held, quick):
        assert not any(x in df._jdf.queryExecution().toString() for x in ("NestedLoop", "Cartesian"))
    nobody = E.evaluate_summary(programs, marks.filter("false"))
    nothing = E.evaluate_summary(programs.filter("false"), marks)
    assert nobody.count() == 0 and nothing.count() == 0
    assert A.quick_summary(students, programs.filter("false"), marks).agg({"eligible": "sum"}).first()[0] == 0


@pytest.mark.parametrize("restart", [False, True])
def test_live_evaluation_keeps_marks(spark, tmp_path, restart):
    """Marks of a student over three batches, one corrected: what holds equals the evaluation of all marks at once."""
    asks = {"english_req": "30-1", "english_min": "60", "math_req": "30-1", "math_min": "60"}
    programs = programs_of(spark, asks, {"english_req": "30-2"}, {"science_req": "Two of Biology 30, Chemistry 30"})
    batches = [
        [(1, 7, "English Language Arts 30-1", 80.0), (2, 8, "Math 30-1", 50.0), (3, 9, "Bio 30", 70.0), (4, None, "Math 31", 1.0), (5, 9, "Chem 30", None)],
        [(6, 7, "Mathematics 30-1", 75.0), (7, 8, "Math 30-1", 90.0), (8, 8, "", 9.0)],
        [(9, 9, "Chemistry 30", 66.0), (10, 8, "English 30-1", 61.0), (2, 7, "Math 30-1", 10.0)],
    ]
    schema = "seq long, student_id long, course string, mark double"
    source = str(tmp_path / "marks")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        if restart or k == 2:
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
            query = refresh.live_evaluation(stream, programs, str(tmp_path / "out"), str(tmp_path / "check"))
            assert query.awaitTermination(120) and query.exception() is None
    got = refresh.live_results(spark.read.parquet(str(tmp_path / "out")))
    every = spark.createDataFrame([r for b in batches for r in b], schema)
    want = E.evaluate(programs, E.course_marks(every.filter("student_id IS NOT NULL")))
    key = ("student_id", "class_id", "n_parts", "met", "status")
    assert {tuple(r) for r in got.select(*key).collect()} == {tuple(r) for r in want.select(*key).collect()}
    assert got.filter("student_id = 7 AND status = 'likely eligible'").count() >= 1
