"""Profiles of programs whose pages were read by hand: each case is a program, and all are read in one run."""

from __future__ import annotations

import pytest

from sievework.operators import profile as P

OWN, REQ, BROAD = "https://school.example.org/programs/1", "https://school.example.org/programs/1/admission-requirements", "https://school.example.org/admissions/how-to-apply"
FIVE = "English 30-1 and Math 30-1. Social Studies 30-1. Two subjects from Groups A, B and C; maximum of one Group B."
ALONE = "Placement test rooms are here."
ELP, TESTS = (OWN, "Admission requires language proficiency."), (OWN + "/t", "TOEFL and CAEL are offered on campus.")
COURSE, GATE = (OWN, "Math 31."), (OWN, "Applicants: Mathematics placement assessment.")

CASES = {
    "courses": [(OWN, "Applicants must present English 30-1 or 30-2, 65% in Math 31 and Biology 30. A minimum overall average of 60% is required.")],
    "five": [(OWN, FIVE)],
    "five but told": [(OWN, FIVE + " Based on 4 subjects.")],
    "rules": [(OWN, "An average of 3 is used."), (OWN + "/b", "The average of five is used.")],
    "broad": [(BROAD, "Minimum average 70% for all.")],
    "broad, must": [(BROAD, "Minimum average 70%. Applicants must complete it.")],
    "broad, catalogue": [(BROAD, "Minimum average 70%. Applicants must complete it. Prerequisites: a lab.")],
    "gates": [(OWN, "Admission: proof of English language proficiency such as IELTS. Academic requirements may be met with an Accuplacer placement assessment in Mathematics.")],
    "no context": [(REQ, ALONE)],
    "context later": [(REQ, ALONE + " lorem" * 60 + " placement test for applicants")],
    "context far": [(REQ, ALONE + " lorem" * 60 + " applicants")],
    "elp then tests": [ELP, TESTS], "tests": [TESTS], "tests then elp": [TESTS, ELP],
    "course then gate": [COURSE, GATE], "gate then course": [GATE, COURSE],
    "longer stays": [(OWN, "Math 30-1 or 30-2."), (OWN, "Math 31.")],
    "longer comes": [(OWN, "Physics 30."), (OWN, "Biology 30 or Physics 30.")],
    "pathway": [(OWN, "Applicants must hold a two-year diploma. The competitive average is in the high 70s.")],
    "grade 12": [(OWN, "Three additional Grade 12 courses at the 30-1, 30-2 or 35 level.")],
    "nothing": [(None, None), (OWN, "  "), (OWN, "x" * 200_000)],
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(name, i, url, text, 1) for name, pages in CASES.items() for i, (url, text) in enumerate(pages)]
    docs = spark.createDataFrame(rows, "program_id string, doc_seq int, url string, text string, value int")
    out = {name: {} for name in CASES}
    for r in P.program_fields(docs).collect():
        assert r.field not in out[r.program_id]
        out[r.program_id][r.field] = (r.value, r.confidence, r.rule_id)
    return out


@pytest.fixture(scope="module")
def values(found):
    return {name: {f: v[0] for f, v in fields.items()} for name, fields in found.items()}


def test_courses_minimums_and_defaults(found):
    assert found["courses"] == {
        "min_avg_final": ("60", "high", "min_avg_pattern_1"), "english_req": ("English 30-1 or English 30-2", "high", "english_course_parse"),
        "english_requirement_mode": ("course", "high", "english_requirement_mode_course"), "math_req": ("Math 31", "high", "math_course_parse"),
        "math_requirement_mode": ("course", "high", "math_requirement_mode_course"), "math_min": ("65", "high", "math_min_parse"),
        "science_req": ("Biology 30", "high", "science_course_parse"), "bio_30_req": ("Yes", "high", "science_flag_parse"),
        "requirement_type": ("alberta_high_school_courses", "medium", "requirement_type_normalize"),
        "math_assessment_flag": ("No", "low", "math_assessment_default_no"), "hs_diploma_req": ("Yes", "medium", "hs_diploma_signal"),
    }


def test_five_courses_are_inferred(found):
    got = found["five"]
    assert got["avg_total"] == ("5", "medium", "subject_count_inference")
    assert got["elective_qty"][0] == "2" and got["elective_pool"][0] == "A,B,C"
    assert got["requirement_type"][:2] == ("alberta_high_school_courses; notes: max 1 Group B", "high")
    assert found["five but told"]["avg_total"] == ("4", "medium", "based_on_number")


def test_average_rules_by_their_order_over_pages(found):
    assert found["rules"]["avg_total"] == ("5", "high", "avg_of_five")


def test_broad_pages_need_context(values):
    assert [name for name in CASES if name.startswith("broad") and "min_avg_final" in values[name]] == ["broad, must"]


def test_gates(values):
    got = values["gates"]
    assert got["english_req"] == "English language proficiency" and got["english_requirement_mode"] == "elp"
    assert got["math_req"] == "Placement assessment" and got["math_requirement_mode"] == "placement_assessment"
    assert got["math_assessment_flag"] == "Yes" and got["elp_tests_mentioned"] == "IELTS" and got["requirement_type"] == "placement_assessment"
    assert "avg_total" not in got


def test_context_is_looked_for_around_every_mention(values):
    assert values["no context"] == values["context far"] == {}
    assert values["context later"]["math_assessment_flag"] == "Yes"


def test_earlier_gate_makes_later_pages_count(values):
    assert values["elp then tests"]["elp_tests_mentioned"] == "TOEFL; CAEL"
    assert values["tests"] == {} and "elp_tests_mentioned" not in values["tests then elp"]


def test_confidence_beats_length_and_length_beats_place(values):
    assert values["course then gate"]["math_req"] == values["gate then course"]["math_req"] == "Math 31"
    assert values["longer stays"]["math_req"] == "Math 30-1 or Math 30-2"
    assert values["longer comes"]["science_req"] == "Biology 30 or Physics 30"


def test_pathways_and_grade_12(values):
    got = values["pathway"]
    assert got["requirement_type"] == "regular_admission; notes: post-secondary pathway" and got["hs_diploma_req"] == "No"
    assert got["competitive_floor_numeric"] == "70"
    assert (values["grade 12"]["elective_qty"], values["grade 12"]["elective_pool"]) == ("3", "30-1,30-2,35")


def test_nothing(spark, values):
    assert values["nothing"] == {}
    assert P.program_fields(spark.createDataFrame([], "program_id long, doc_seq int, url string, text string")).count() == 0
