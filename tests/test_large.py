"""What holds for tables whose files are small and whose rows are not: plans, not sizes, show it on small tables."""

from __future__ import annotations

import re

import pytest
from conftest import SF

from sievework.plans import catalog


def plan(df) -> str:
    """The physical plan before any task has run, so with Spark's own estimates."""
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["jo08_match_canonical", "jo12_candidate_only", "ag13_match_summary", "jo11_proposed_removals"])
def test_rows_are_matched_without_broadcast(spark, name):
    """Both sides grow with the programs; Spark takes few bytes of a compressed file for few rows."""
    assert "Broadcast" not in plan(catalog.QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["mg02_structured_fields"])
def test_merge_broadcasts_no_rows(spark, name):
    assert "Broadcast" not in plan(catalog.QUERIES[name](spark, SF))


def test_overrides_broadcast_no_rows(spark):
    """Of all that the whole merge joins, only lists by institution may be sent to every task."""
    from sievework.operators import canonical as K
    from sievework.plans.views import view

    said = plan(K.with_overrides(view(spark, SF, "v_table"), view(spark, SF, "v_program_overrides")))
    assert said.count("BroadcastExchange") <= said.count("asked")
    assert "SortMergeJoin [t" in said and "SortMergeJoin [rs" in said and "SortMergeJoin [seq" in said and "BroadcastHashJoin [row_id" not in said


def test_a_text_that_many_rules_repeat_is_listed_once(spark):
    """An institution's list, which each of its programs meets, has its distinct texts in the order of their first rows."""
    from sievework.operators import rules as R

    programs = spark.sql("SELECT id AS row_id, 'North' AS institution, concat('P', id) AS program FROM range(4)")
    rules = spark.sql("SELECT id AS seq, 'North' AS institution, if(id % 500 = 7, 'P1', '*') AS program, concat('max ', 3 - id % 3, ' Group B') AS rule_text FROM range(2000)")
    rules = rules.unionByName(spark.sql("SELECT -1L AS seq, 'North' AS institution, 'P1' AS program, 'own' AS rule_text"))
    out = R.with_rules(programs, None, rules)
    every = "max 3 Group B; max 2 Group B; max 1 Group B"
    assert {r.row_id: r.rule_text for r in out.collect()} == {0: every, 1: every + "; own", 2: every, 3: every}
    assert "min(seq" in plan(out)


def test_legacy_names_come_from_rows_without_url_too(spark):
    """A legacy row that lacks a field is not written, but its name rescues the whole row of that name."""
    from sievework.plans import curation

    index = spark.sql("SELECT * FROM VALUES (7L, 'North', 'Old Trade', '', ''), (8L, 'North', 'Old trade', 'https://x.org/1', ''), (9L, 'North', 'No Trade', 'https://x.org/2', '') t(seq, institution, program_name, source_url, notes)")
    seeds = spark.sql("SELECT 1L AS seq, 'North' AS institution, 'Seed' AS program_name, 'https://x.org/3' AS source_url")
    none = spark.sql("SELECT 1L AS seq, 'North' AS institution, '' AS program, '' AS include_or_exclude, '' AS status, '' AS source_page_url, '' AS parent_admissions_url, '' AS notes")
    assert [tuple(r) for r in curation.ag02(index, seeds, none).collect()] == [("North", 1, 1, True)]


def test_pairs_are_counted_before_the_product(spark):
    """Programs are summed up below the join, so students meet counts and not each program."""
    said = plan(catalog.QUERIES["jo16_student_program_pairs"](spark, SF))
    assert said.index("BroadcastNestedLoopJoin") < said.index("partial_count")


def test_no_pair_of_student_and_class_is_shuffled(spark):
    """Above the product of evaluate nothing is joined or exchanged by pair; a gate, a part out of reach, two of three."""
    from sievework.operators import evaluate as E
    from sievework.plans.views import view

    programs, marks = view(spark, SF, "v_canonical"), E.course_marks(view(spark, SF, "v_marks"))
    said = plan(E.evaluate(programs, marks))
    assert "Exchange" not in said[: said.index("NestedLoopJoin")]
    classes, hits = E.class_hits(programs, marks)
    want = {(r.student_id, r.class_id): r.met for r in hits.collect()}
    out = E.evaluate(programs, marks).collect()
    assert len(out) == marks.select("student_id").distinct().count() * classes.count()
    assert {(r.student_id, r.class_id): r.met for r in out if r.met} == want


def test_required_marks_are_summed_up_without_pairs(spark):
    """The sums over programs are those of a row per pair, and nothing is joined by program."""
    from pyspark.sql import functions as F

    from sievework.operators import admission as A, evaluate as E
    from sievework.plans.views import view

    programs, marks = view(spark, SF, "v_canonical"), E.course_marks(view(spark, SF, "v_marks"))
    out = catalog.QUERIES["e07_required_marks"](spark, SF)
    pairs = A.required_marks(programs, marks).groupBy("student_id").agg(F.count("*").alias("pairs"), F.sum("n").alias("n"), F.sum("total").alias("total"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, pairs.collect()))
    assert not re.search(r"Join \[row_id|Join \[part", plan(out))


def test_hits_of_a_person_are_those_of_the_join(spark):
    from sievework.operators import admission as A, evaluate as E
    from sievework.plans.views import view
    from pyspark.sql import functions as F

    parts = A.subject_parts(view(spark, SF, "v_canonical")).filter("kind = 'parts'")
    marks = E.course_marks(view(spark, SF, "v_marks"))
    people = E.students_with_marks(marks).join(F.broadcast(A.listed_parts(parts))).select("student_id", F.explode(A.person_hits()).alias("h")).select("student_id", "h.*")
    assert sorted(map(str, people.collect())) == sorted(map(str, A.part_results(parts, marks).select("student_id", "part", "best", "used").collect()))


@pytest.mark.parametrize("name", ["e14_pair_messages", "e17_result_views", "e22_results", "e18_details", "e18_people_details"])
def test_results_are_counted_where_the_students_are(spark, name):
    """Between the product of students and classes and the first sums above it no pair is exchanged, sorted or joined."""
    said = plan(catalog.QUERIES[name](spark, SF))
    above = said[: said.index("NestedLoopJoin")].split("partial_")[-1]
    assert "Exchange" not in above and "Sort" not in above and "MergeJoin" not in above


def test_counted_results_are_those_of_each_pair(spark):
    from pyspark.sql import functions as F

    from sievework.operators import admission as A, details as D, evaluate as E
    from sievework.plans.mapping import _facts
    from sievework.plans.rules import rule_tables
    from sievework.plans.views import view

    programs, marks = view(spark, SF, "v_canonical"), E.course_marks(view(spark, SF, "v_marks"))
    averages, electives = rule_tables(programs)
    pairs = A.evaluate_people(programs, marks, avg_rules=averages, elective_rules=electives).groupBy("student_id", "snapshot_result").agg(F.count("*").alias("n"), F.sum(F.length("avg_used")).alias("used"))
    counted = A.counted_results(_facts(programs), marks).groupBy("student_id", "snapshot_result").agg(F.sum("n").alias("n"), F.sum(F.length("avg_used") * F.col("n")).alias("used"))
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, counted.collect()))
    whole = D.people_details(programs, marks, avg_rules=averages, elective_rules=electives).select("details.warning.level", F.explode("details.requirements").alias("r")).groupBy("r.label", "r.status", "level").agg(F.count("*").alias("n"), F.sum(F.size("r.issues")).alias("issues"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, catalog.QUERIES["e18_people_details"](spark, SF).select("label", "status", "level", "n", "issues").collect()))
