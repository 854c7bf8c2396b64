"""Institution rules of the average count, the default of five, trimming of pages, and all of it in a profile."""

from __future__ import annotations

from sievework.operators import adapters as A
from sievework.operators import profile as P

SCHEMA = "program_id long, doc_seq int, institution string, url string, text string"
CASES = [
    ("NAIT", ["Needs five 30-level subjects."], (5, "high", "five_30_level_subjects")),
    (" nait ", ["average of four", "Average calculated on five"], (5, "high", "average_calculated_on_five")),
    ("NAIT", ["The admission average is posted."], (5, "low", "nait_default_five")),
    ("NAIT", ["Nothing here"], None),
    ("NAIT", ["Menu average of four About the program Good. Privacy Policy Terms of Use average of four"], None),
    ("NAIT", ["Content is loading... average of four", "Academic requirements: average of five"], (5, "high", "avg_of_five")),
    ("NAIT", ["Content is loading... average of four"], (4, "high", "avg_of_four")),
    ("NAIT", ["Academic requirements Not ready to apply yet? x", "average of 12"], None),
    ("MacEwan University", ["five required Grade 12 subjects"], (5, "high", "five_required_grade12")),
    ("MACEWAN", ["average of 3", "five acceptable grade 12 subjects"], (5, "high", "five_acceptable_grade12")),
    ("MacEwan", ["five 30-level subjects and an admission average"], None),
    ("NorQuest College", ["the average of the best five marks"], (5, "high", "best_five_average")),
    ("NorQuest", ["five Grade 12 subjects, average of four"], (5, "medium", "five_grade12_subjects")),
    ("UAlberta", ["admission average of all five subjects"], (5, "high", "admission_average_five_subjects")),
    ("University of Alberta", ["An admission average is used", "and has five subjects", "average of four"], (5, "high", "admission_average_five_subjects")),
    ("UAlberta", ["of five subjects; average of four", "an admission average counts"], (4, "high", "avg_of_four")),
    ("UAlberta", ["an admission average counts"], (5, "low", "ualberta_default_five")),
    ("Elsewhere", ["admission average; five required Grade 12 subjects; based on 3 courses"], (3, "medium", "based_on_number")),
    (None, ["average of five"], (5, "high", "avg_of_five")),
    ("NAIT", [None, " "], None),
]


def pages(spark):
    return spark.createDataFrame([(k, i, inst, f"https://x/{i}", t) for k, (inst, texts, _) in enumerate(CASES) for i, t in enumerate(texts)], SCHEMA).repartition(4)


def test_average_counts_by_institution(spark):
    got = {r.program_id: (r.value, r.confidence, r.rule_id) for r in A.average_totals(pages(spark)).collect()}
    assert got == {k: want for k, (_, _, want) in enumerate(CASES) if want}
    assert A.average_totals(pages(spark).filter("false")).count() == 0


def test_profiles_take_the_rules_and_the_trimming(spark):
    found = {r.program_id: (int(r.value), r.confidence, r.rule_id) for r in P.program_fields(pages(spark)).filter("field = 'avg_total'").collect()}
    assert found == {k: want for k, (_, _, want) in enumerate(CASES) if want}
    plain = {r.program_id: r.value for r in P.program_fields(pages(spark).drop("institution")).filter("field = 'avg_total'").collect()}
    assert plain[4] == "4" and 2 not in plain and plain[6] == "4"


def test_trimmed_text(spark):
    frame = spark.createDataFrame([("a Academic requirements b  c Work at NAIT Emergency d",), ("Content is loading... x",), ("x Work at NAIT Emergency",), ("Privacy Policy Terms of Use",)], "t string")
    nait = [r[0] for r in frame.select(A.program_text("t", A.adapter_of(frame.t.substr(1, 0)))).collect()]
    assert nait[1] == "Content is loading... x"
    from pyspark.sql import functions as F

    cut = [r[0] for r in frame.select(A.program_text("t", F.lit("nait"))).collect()]
    assert cut == ["Academic requirements b c", "", "x", "Privacy Policy Terms of Use"]
