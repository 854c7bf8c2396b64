"""People against whole programs: golden rows of the 18-column result, exact electives, outputs of a run."""

from __future__ import annotations

import itertools
import random

from sievework.operators import admission as A
from sievework.operators import details as D
from sievework.operators import evaluate as E
from sievework.operators import mapping as M
from sievework.operators.electives import best_subset

COLUMNS = (
    "institution", "program", "credential_type", "status", "program_url", "min_avg_final", "competitive_final", "avg_total", "english_req", "english_requirement_mode", "english_min", "math_req", "math_requirement_mode", "math_min",
    "social_req", "science_req", "elective_qty", "elective_pool", "requirement_type", "hs_diploma_req", "math_assessment_flag", "display_for_high_school",
)
BASE = {"institution": "North", "credential_type": "Diploma", "status": "Active", "program_url": "https://school.example.org/p", "display_for_high_school": "Yes"}


def programs_of(spark, *rows: dict):
    held = [(k, *[({"program": f"P{k}"} | BASE | row).get(c, "") for c in COLUMNS]) for k, row in enumerate(rows, 1)]
    return spark.createDataFrame(held, "row_id long, " + ", ".join(f"{c} string" for c in COLUMNS))


def test_results_of_two_people(spark):
    asks = {"english_req": "30-1", "english_min": "60", "min_avg_final": "65", "avg_total": "3", "elective_pool": "B"}
    programs = programs_of(
        spark, asks, asks | {"requirement_type": "alberta_high_school_courses; notes: max 1 Group B"}, {"english_req": "Placement test", "program_url": ""}, {"science_req": "Two of Biology 30, Chemistry 30", "requirement_type": "notes: portfolio"},
        asks | {"status": "closed"}, asks | {"display_for_high_school": "No"}, {},
    )
    marks = [(1, "ELA 30-1", 70.0), (1, "Art 30", 80.0), (1, "Physical Education 30", 60.0), (1, "Bio 30", 95.0), (2, "Math 31", 50.0)]
    marks = [(m[0], "English Language Arts 30-1" if m[1] == "ELA 30-1" else m[1], m[2]) for m in marks]
    marks = spark.createDataFrame([(i, *m) for i, m in enumerate(marks)], "seq long, student_id long, course string, mark double")
    got = {(r.student_id, r.row_id): r for r in A.evaluate_people(programs, E.course_marks(marks)).collect()}
    assert sorted(got) == [(s, r) for s in (1, 2) for r in (1, 2, 3, 4, 7)]
    one = got[1, 1]
    assert (one.missing, one.student_avg, one.avg_courses, one.snapshot_result, one.confidence) == ("", 70.0, 3, "Likely eligible", "High")
    assert one.avg_used == "English 30-1=70, B (ART 30)=80, B (PHYSICAL EDUCATION 30)=60"
    two = got[1, 2]
    assert two.missing == (
        "Average incomplete (need 3 marks; have 2) | Need 1 more elective mark(s) for average (allowed groups: B; max 1 from Group B); current elective marks: B (ART 30)=80, B (PHYSICAL EDUCATION 30)=60; to meet 65, remaining elective(s) need avg >= 45.0"
    )
    assert two.student_avg is None and two.snapshot_result == "Likely ineligible"
    assert got[2, 1].missing.startswith("Missing English (English 30-1) | Average incomplete (need 3 marks; have 0) | Need 2 more elective mark(s)")
    assert (got[1, 3].snapshot_result, got[1, 3].uncheckable_reason, got[1, 3].next_step, got[1, 3].source_url) == ("Uncheckable", A.PLACEMENT_REASON, A.NEXT_STEP_NO_URL, "Source link missing")
    assert got[1, 3].notes == "English: assessment/placement required"
    assert got[1, 4].missing == "Missing Science (need 2 of: Biology 30, Chemistry 30)" and got[1, 4].notes == "Other requirements: portfolio | portfolio"
    assert (got[1, 4].confidence, got[1, 4].why_text) == ("Medium", "Program includes additional manual-review requirements.")
    assert got[2, 7].uncheckable_reason == A.EMPTY_REASON
    details = {(r.student_id, r.row_id): r.details for r in A.result_details(A.evaluate_people(programs, E.course_marks(marks))).collect()}
    assert len(details[1, 2].missing) == 2 and details[1, 3].warning.reason == A.PLACEMENT_REASON and details[1, 1].warning is None
    assert [r.place for r in A.sorted_results(A.evaluate_people(programs, E.course_marks(marks)), 2).filter("student_id = 1").collect()] == [1, 2]


def test_details_and_views(spark):
    asks = {"english_req": "30-1", "english_min": "75", "min_avg_final": "65", "avg_total": "3", "elective_pool": "B"}
    programs = programs_of(spark, asks, {"english_req": "Placement test", "program_url": ""}, {"science_req": "Two of Biology 30, Chemistry 30", "requirement_type": "notes: portfolio"}, {"english_req": "30-1", "social_req": "See Degree"}, {})
    marks = [(1, "English Language Arts 30-1", 70.0), (1, "Biology 30", 95.0), *[(1, c, m) for c, m in (("Art 30", 80.0), ("Physical Education 30", 60.0))], (2, "Math 31", 50.0)]
    marks = E.course_marks(spark.createDataFrame([(i, *m) for i, m in enumerate(marks)], "seq long, student_id long, course string, mark double"))
    got = {(r.student_id, r.row_id): r.details for r in D.people_details(programs, marks).collect()}
    assert sorted(got) == [(s, r) for s in (1, 2) for r in (1, 2, 3, 4, 5)]
    subject = lambda k, name: tuple(next(x for x in got[k].requirements if x.label == name))[1:]
    assert [x.label for x in got[1, 1].requirements] == ["English", "Math", "Social Studies", "Science"]
    assert subject((1, 1), "English") == ("low_mark", "English 30-1", 75.0, "English 30-1=70", ["English 30-1=70 < 75"])
    assert subject((2, 1), "English") == ("missing", "English 30-1", 75.0, "", ["Missing one of: English 30-1"])
    assert subject((1, 1), "Math") == ("not_required", "Not required", None, "", [])
    assert subject((1, 2), "English")[:2] == ("assessment", "assessment/placement required")
    assert subject((1, 3), "Science") == ("missing", "Need 2 of: Biology 30, Chemistry 30", None, "Biology 30=95", ["Only 1 of 2 required subjects present."])
    assert subject((1, 4), "English")[0] == "met" and subject((1, 4), "Social Studies")[:2] == ("unknown", "See Degree")
    one = got[1, 1]
    assert (one.average.min, one.average.student, one.average.total_courses, one.average.used_courses, one.average.complete, one.average.meets_minimum, one.average.needed_electives) == (65.0, 70.0, 3, 3, True, True, 2)
    assert [tuple(e) for e in one.electives.selected] == [("B", "ART 30", 80.0), ("B", "PHYSICAL EDUCATION 30", 60.0)] == [tuple(e) for e in one.electives.usable_top]
    assert (one.electives.allowed_groups, one.missing_reasons, one.snapshot_result) == (["B"], ["English mark too low: English 30-1=70 < 75"], "Likely ineligible")
    assert (tuple(one.warning), got[2, 1].average.meets_minimum, got[1, 5].average.meets_minimum) == (("high", "", [], "", ""), False, None)
    assert tuple(got[1, 2].warning) == ("uncheckable", D.WARNINGS["Uncheckable"], [], A.PLACEMENT_REASON, A.NEXT_STEP_NO_URL) and got[1, 2].source_url_missing
    assert (got[1, 3].warning.level, got[1, 3].warning.reasons) == ("medium", ["Program includes additional manual-review requirements."])
    assert (got[1, 3].notes, got[1, 3].advisories) == (["portfolio"], ["Other requirements: portfolio"])
    views = {}
    for r in D.result_views(A.evaluate_people(programs, marks)).collect():
        views.setdefault((r.student_id, r.view), []).append(r.row_id)
    assert {k: sorted(v) for k, v in views.items()}[1, "all"] == [1, 2, 3, 4, 5] and sorted(views[1, "ineligible"]) == [1, 3]
    assert all(len(views[s, "all"]) == sum(len(views.get((s, v), [])) for v in D.VIEWS.values()) for s in (1, 2))


def test_best_subset_is_exhaustive():
    rng = random.Random(7)
    for _ in range(400):
        units = [(tuple(sorted(rng.sample("ABCD", rng.choice([1, 1, 2])))), float(rng.randrange(40, 100))) for _ in range(rng.randrange(8))]
        need, caps = rng.randrange(1, 8), {g: rng.randrange(3) for g in "ABCD" if rng.random() < 0.4}
        sets = [(rng.randrange(1, 4), tuple(rng.sample("ABCD", 2)))] if rng.random() < 0.5 else []

        def best(limits, wanted):
            found = (0, 0.0)
            for k in range(1, min(need, len(units)) + 1):
                for own in itertools.combinations(units, k):
                    for way in itertools.product(*[u[0] for u in own]):
                        if all(way.count(g) <= n for g, n in limits.items()) and all(sum(way.count(g) for g in gs) >= n for n, gs in wanted):
                            found = max(found, (k, sum(u[1] for u in own)))
            return found

        want = best(caps, sets)
        want = want if want[0] else best({}, [])
        got = best_subset(units, need, caps, sets)
        assert (len(got), sum(units[i][1] for i, _ in got)) == want
        assert len({i for i, _ in got}) == len(got) and all(g in units[i][0] for i, g in got)


def test_plan_and_defaults(spark):
    choices = spark.createDataFrame([(1, "p1", "", "Art History"), (2, "", "s9", "Welding"), (3, "", "", "None alike")], "program_id long, plan_code string, subplan_code string, name string")
    plans = spark.createDataFrame(
        [(1, 1, "P2", ["S1"], "Art History"), (1, 2, "P1", ["S1"], "Other"), (2, 3, "A", ["S9 "], "x"), (2, 4, "B", [], "Welding"), (3, 5, "A", [], "x"), (3, 6, "A", [], "y")],
        "program_id long, plan_seq long, plan_code string, subplan_codes array<string>, name string",
    )
    assert {r.program_id: r.plan_seq for r in M.select_plan(choices, plans).collect()} == {1: 2, 2: 3, 3: 5}
