"""The canonical merge: what each step sets, precedence, the log, overrides by tier; gates and review reasons."""

from __future__ import annotations

import pytest
from conftest import SF

from sievework.operators import canonical as K
from sievework.operators import gates as G
from sievework.operators import quality as Q
from sievework.plans.views import view

ROW = ("institution", "program", "credential_type", "status", "program_url", *K.STRUCTURED)
OVERRIDE = "seq long, institution string, program string, credential_type string, status string, include_or_exclude string, source_page_url string, parent_admissions_url string, requirement_type_override string, min_avg_override string, elective_qty_override string, avg_total_override string"
RULE = "seq long, institution string, ruleset_key string, credential_scope string, requirement_type_pattern string, default_avg_total string, placement_required string"


def rows(spark, *held: dict, **more: str):
    base = {"institution": "North", "credential_type": "Diploma", "status": "Active"}
    names = [*ROW, *more]
    return spark.createDataFrame([(k, *[{**base, **more, **h}.get(c) for c in names]) for k, h in enumerate(held)], "row_id long, " + ", ".join(f"{c} string" for c in names))


def found(spark, *held: dict):
    names = ["institution", "program", "credential_type", "program_url", *[x for f in K.STRUCTURED for x in (f, f"{f}_confidence")]]
    return spark.createDataFrame([(k, *[{"institution": "north", "credential_type": "diploma", **h}.get(c) for c in names]) for k, h in enumerate(held)], "cand_id long, " + ", ".join(f"{c} string" for c in names))


def table(spark, schema: str, *held: dict):
    return spark.createDataFrame([tuple({"seq": k, "institution": "NORTH ", **h}.get(c.split()[0]) for c in schema.split(", ")) for k, h in enumerate(held)], schema)


def test_structured_confidence(spark):
    raw = rows(spark, {"program": "Art", "min_avg_final": "70", "hs_diploma_req": "Unknown", "social_req": None}, {"program": "Law"})
    got = found(
        spark, {"program": " art ", "min_avg_final": "65", "min_avg_final_confidence": " HIGH", "math_min": "50", "math_min_confidence": "low", "hs_diploma_req": "Yes", "hs_diploma_req_confidence": "low", "elective_qty": " ", "elective_qty_confidence": "high", "social_req": "Social 30-1", "social_req_confidence": "medium"},
    )
    art, law = K.apply_structured(K.start(raw), got).orderBy("row_id").collect()
    assert (art.min_avg_final, art.math_min, art.hs_diploma_req, art.elective_qty, art.social_req) == ("65", "", "Yes", "", "Social 30-1")
    assert [(x.field, x.step) for x in art.set_by] == [("min_avg_final", "structured:high"), ("social_req", "structured:medium"), ("hs_diploma_req", "structured:low")]
    assert law.set_by == [] and law.min_avg_final == ""


def test_rule_sets_in_order(spark):
    rules = table(
        spark, RULE, {"ruleset_key": "b", "credential_scope": "any", "default_avg_total": "4"}, {"ruleset_key": "A", "credential_scope": "", "default_avg_total": "3"}, {"ruleset_key": "z", "credential_scope": "degree / dip", "default_avg_total": "5.0", "placement_required": "true"},
        {"ruleset_key": "y", "credential_scope": "diploma", "requirement_type_pattern": "Placement", "placement_required": "yes"}, {"ruleset_key": "0", "credential_scope": "diploma", "requirement_type_pattern": "placement", "default_avg_total": "0"},
    )
    raw = rows(
        spark, {"program": "plain"}, {"program": "said", "requirement_type": "unknown", "social_req": "Social 30-1"}, {"program": "other", "credential_type": "Course"}, {"program": "no credential", "credential_type": ""},
        {"program": "blank with signal", "social_req": "Social 30-1", "math_assessment_flag": "No"}, {"program": "placed", "requirement_type": "placement_assessment; notes: x", "avg_total": "2"}, {"program": "elsewhere", "institution": "South"},
    )
    got = {r.program: (r.avg_total, r.requirement_type, r.math_assessment_flag) for r in K.apply_rulesets(K.start(raw), rules).collect()}
    assert got["plain"] == ("5", "", "Yes")  # a pattern needs a signal where the row has no type
    assert got["said"] == ("5", "unknown", "Yes")  # 'unknown' is a type that lacks the pattern
    assert got["other"] == ("3", "", "") and got["no credential"] == ("3", "", "")  # equally general rules go by key
    assert got["blank with signal"] == ("", "alberta_high_school_courses; notes: placement", "No")  # a pattern is no form, so it stays as a note
    assert got["placed"] == ("2", "placement_assessment; notes: x", "Yes") and got["elsewhere"] == ("", "", "")


def test_override_tiers(spark):
    u = "https://x.org/"
    ov = table(
        spark, OVERRIDE, {"program": "one", "source_page_url": u + "1/", "min_avg_override": "71"}, {"program": "two", "source_page_url": u + "2", "credential_type": "degree"}, {"program": "two b", "parent_admissions_url": u + "2#a", "credential_type": "Diploma"},
        {"program": "three", "source_page_url": u + "3", "credential_type": "diploma"}, {"program": "three b", "source_page_url": u + "3"}, {"program": "four", "credential_type": "diploma"}, {"program": "Four!", "credential_type": "DIPLOMA"}, {"program": "four"},
        {"program": "Applied animal health care", "status": "archived"}, {"program": "Applied animal health (evening)", "source_page_url": u + "9"}, {"program": "Heavy equipment one"}, {"program": "Heavy equipment two"}, {"program": "  ", "source_page_url": u + "5"},
    )
    asks = [
        ("any", "1", "Degree", 0, "url"), ("x", "2/", "diploma", 2, "url_credential"), ("Three", "3", "Diploma", 3, "url_program"), ("other", "3", "Diploma", None, None), ("four", "", "Diploma", 6, "key"), ("four", "", "Degree", 7, "key_without_credential"),
        ("Applied animal health", "", "Degree", 9, "name"), ("Heavy equipment", "", "Degree", None, None), ("x", "5", "Degree", None, None), ("", "", "", None, None),
    ]
    raw = rows(spark, *[{"program": p, "program_url": u + a if a else "", "credential_type": c} for p, a, c, _, _ in asks])
    got = {r.row_id: (r.seq, r.tier) for r in K.resolve_overrides(raw, ov).collect()}
    assert got == {k: (s, t) for k, (_, _, _, s, t) in enumerate(asks) if t}
    done = K.apply_overrides(K.with_overrides(K.start(raw), ov)).filter("row_id IN (0, 6)").orderBy("row_id").collect()
    assert (done[0].min_avg_final, done[0].program_url) == ("71", u + "1") and done[1].program_url == u + "9"
    assert [(x.field, x.step) for x in done[1].set_by] == [("program_url", "override:name")]


def test_merge_precedence(spark):
    raw = rows(
        spark, {"program": "Art", "english_req": "English 30-1 or 30-2", "min_avg_final": "60", "elective_qty": "Three", "math_req": "31"}, {"program": "ART", "english_req": "english 30-1 or 30-2", "min_avg_final": "60", "elective_qty": "Three", "math_req": "31"},
        {"program": "Gone"}, {"program": "Way", "credential_type": "Certificate", "requirement_type": "regular_admission; notes: post-secondary pathway", "avg_total": None}, {"program": "Only", "english_req": "ELA 30-1", "english_min": "60"}, note="kept",
    )
    got = found(spark, {"program": "art", "min_avg_final": "65", "min_avg_final_confidence": "high"})
    ov = table(spark, OVERRIDE, {"program": "gone", "include_or_exclude": " Exclude"}, {"program": "art", "elective_qty_override": "2"})
    rules = table(spark, RULE, {"ruleset_key": "r", "credential_scope": "certificate", "default_avg_total": "4", "requirement_type_pattern": "pathway"})
    out = K.build_canonical(raw, got, rules, ov)
    held = {r.row_id: r for r in out.collect()}
    assert sorted(held) == [0, 3, 4]  # excluded; equal whatever the case
    art = held[0]
    assert (art.english_req, art.english_requirement_mode, art.math_req, art.min_avg_final, art.avg_total, art.elective_qty, art.note) == ("English 30-1 or English 30-2", "course", "Math 31", "65", "5", "2", "kept")
    assert [x.step for x in art.set_by if x.field == "avg_total"] == ["inferred"] and [x.step for x in art.set_by if x.field == "elective_qty"] == ["override:key_without_credential"]
    assert (held[3].requirement_type, held[3].hs_diploma_req, held[3].display_for_high_school, held[3].avg_total) == ("post_secondary_pathway; notes: post-secondary pathway", "No", "No", "4")
    assert held[4].requirement_type == "course_min_only" and held[4].display_for_high_school == "Yes"
    assert {r.row_id for r in K.build_canonical(raw, got, rules, ov, preserve=("north",)).collect()} == {0, 1, 3, 4}
    empty = K.build_canonical(raw.limit(0), got.limit(0), rules.limit(0), ov.limit(0))
    assert empty.count() == 0 and empty.columns == out.columns


def test_log_names_every_change(spark):
    """A field differs from the raw table exactly where set_by says that a step set it, or came back to what it was."""
    raw = K.start(view(spark, SF, "v_table"))
    out = K.build_canonical(view(spark, SF, "v_table"), *[view(spark, SF, v) for v in ("v_found", "v_rulesets", "v_program_overrides")])
    before = {r.row_id: r for r in raw.collect()}
    changed = 0
    for r in out.collect():
        named = {x.field for x in r.set_by}
        differs = {f for f in (*K.STRUCTURED, "program_url") if r[f] != before[r.row_id][f]}
        assert differs <= named
        changed += len(differs)
    assert changed > 500


def test_seeds_fill(spark):
    raw = rows(spark, {"program": "Art", "credential_type": " ", "status": None}, {"program": "Law", "credential_type": "", "status": "closed"}, {"program": "Jazz", "credential_type": ""})
    seeds = spark.createDataFrame([(1, "north", "art", "Degree"), (2, "North", "ART", "Post-diploma"), (3, "north", "Law", None)], "seq long, institution string, program_name string, credential string")
    got = K.fill_from_seeds(K.start(raw), seeds).orderBy("row_id").collect()
    assert [(r.credential_type, r.status) for r in got] == [("Diploma", "Active"), ("Other", "closed"), ("", "Active")]


@pytest.mark.parametrize(("change", "gate"), [({"program_url": ""}, "url_missing"), ({"program_url": "www.x.org"}, "url_not_http"), ({"display_for_high_school": "maybe"}, "display_value"), ({"status": "closed"}, "key_collisions"), ({"program_url": "https://x.org/other"}, "visible_duplicates"), ({}, "exact_duplicates"), ({"min_avg_final": "x"}, "min_avg_final_not_a_number"), ({"institution": "nan"}, "key_blank"), (None, "")])
def test_gates_of_a_table(spark, change, gate):
    good = {"program": "Art", "program_url": "https://x.org/a", "display_for_high_school": "Yes", "requirement_type": "alberta_high_school_courses", "min_avg_final": "65", "social_req": "Social 30-1"}
    found_ = G.table_gates(rows(spark, good, *([] if change is None else [good | change]), display_for_high_school=""))
    errors = {r.gate for r in found_.collect() if r.severity == "error"}
    assert (gate in errors) if gate else not errors
    assert G.passes(found_).first().passed == (not gate)


def test_gates_without_rows_or_headers(spark):
    base = rows(spark, {"program": "Art"}, display_for_high_school="Yes")
    assert [r.gate for r in G.table_gates(base.limit(0)).collect()] == ["empty"]
    assert [(r.gate, r.scope, r.n) for r in G.table_gates(base.drop("status", "avg_total")).collect()] == [("missing_headers", "status, avg_total", 2)]


def test_review_reasons_of_institutions(spark):
    held = rows(spark, {"institution": "NorQuest", "program": "a", "status": "unknown"}, {"institution": "norquest", "program": "b", "status": ""}, {"institution": " UAlberta", "program": "c", "requirement_type": "see Faculty; notes: x"}, {"institution": "UAlberta", "program": "d", "requirement_type": "regular_admission; notes: x"}, {"program": "e", "math_assessment_flag": "maybe"})
    got = {r.row_id: r.reason_codes for r in Q.review_queue(held).collect()}
    assert got == {0: "credential_backfill", 2: "inheritance_placeholder|note_dump", 4: "placement_review"}
