"""Two runs: each reason of the gate, look-ups of issues, candidates taken into a table against a plain fold."""

from __future__ import annotations

import random

import pytest
from conftest import SF

from sievework.operators import promotion as P
from sievework.plans import catalog

RUN = "seq long, index_row_id string, institution string, program_name string, credential string, source_url string, " + ", ".join(f"{f} string" for f in P.FIELDS)
ISSUE = "issue_id long, issue_type string, field_name string, canonical_row_id string, institution string, program string, credential string, program_url string, expected_value string, status string, approval_state string"
DECISION = "seq long, institution string, program_name string, source_url string, decision string, reason_code string"


def run(spark, *rows: dict):
    held = [tuple({"seq": k, "institution": "North", "credential": "Diploma", **r}.get(c.split()[0]) for c in RUN.split(", ")) for k, r in enumerate(rows)]
    return spark.createDataFrame(held, RUN)


def issues(spark, *rows: dict):
    return spark.createDataFrame([tuple({"issue_id": k, "institution": "north", "credential": "diploma", "status": "open", **r}.get(c.split()[0]) for c in ISSUE.split(", ")) for k, r in enumerate(rows)], ISSUE)


def test_issue_tiers(spark):
    cand = run(
        spark, {"index_row_id": "R1", "program_name": "Art", "source_url": "u1", "avg_total": "5"}, {"index_row_id": "R2", "program_name": "Art", "source_url": "u2", "avg_total": "6"}, {"index_row_id": "R2", "program_name": "Law", "source_url": "u3", "avg_total": "7"},
        {"index_row_id": "", "program_name": "Law", "source_url": "U3 ", "avg_total": " 8  x"}, {"program_name": "Jazz", "source_url": "u9", "avg_total": "9", "english_req": "30-1"},
    )
    asks = [
        ({"canonical_row_id": " r1", "program": "Law", "expected_value": "5"}, None), ({"canonical_row_id": "R2", "program": "ART", "program_url": "U2", "expected_value": "6"}, None), ({"canonical_row_id": "R2", "program": "Law", "program_url": "u3", "expected_value": "8 X"}, None),
        ({"program": "Jazz", "program_url": "elsewhere", "expected_value": "9"}, None), ({"program": "Art", "expected_value": "5"}, ""), ({"program": "Jazz", "expected_value": "4"}, "9"), ({"program": "None", "expected_value": "4"}, ""), ({"program": "Jazz", "expected_value": " "}, None),
        ({"program": "Jazz", "expected_value": "4", "status": "Done"}, None), ({"program": "Jazz", "expected_value": "30-1", "field_name": "?", "issue_type": "Required_Course"}, None), ({"program": "Jazz", "expected_value": "x", "field_name": "?", "issue_type": "layout"}, ""),
        ({"program": "Jazz", "program_url": "u9", "expected_value": "DROP", "issue_type": "irrelevant_program"}, None), ({"program": "Jazz", "program_url": "u8", "expected_value": "drop", "issue_type": "irrelevant_program"}, ""), ({"program": "Jazz", "program_url": "u9", "expected_value": "keep", "issue_type": "irrelevant_program"}, "drop"),
    ]
    decisions = spark.createDataFrame([(1, "North", "Jazz", "u9", "keep", ""), (2, "NORTH", " jazz", "U9", "Drop", "")], DECISION)
    got = {r.issue_id: r for r in P.issue_regressions(issues(spark, *[{"field_name": "avg_total"} | a for a, _ in asks]), cand, decisions).collect()}
    assert {k: r.actual_value for k, r in got.items()} == {k: v for k, (_, v) in enumerate(asks) if v is not None}
    assert got[10].notes == P.SAYS_FIELD and got[12].notes == P.SAYS_DECISION and got[4].notes == P.SAYS_VALUE


@pytest.mark.parametrize("case", ["none", "regression", "drops", "coverage", "base", "cand"])
def test_each_reason_of_the_gate(spark, case):
    base = run(spark, {"program_name": "Art", "avg_total": "5"}, {"program_name": "Law"})
    cand = run(spark, {"program_name": "Art", "avg_total": "5", "math_req": "" if case == "coverage" else "30-1"}, {"program_name": "Law"})
    asks = issues(spark, {"program": "Art", "field_name": "avg_total", "expected_value": "6" if case == "regression" else "5"})
    drop = (1, "North", "x", "u", "drop", "dropped_blocked_url")
    before, after = spark.createDataFrame([drop], DECISION), spark.createDataFrame([drop] * (2 if case == "drops" else 1), DECISION)
    r = P.promotion_gate(base, cand, asks, before, after, 3 if case == "base" else 2, 3 if case == "cand" else 2).first()
    says = {"none": "", "regression": "Issue-pack regressions found: 1", "drops": "Candidate irrelevant drop count increased: 2 > 1", "coverage": "Net coverage delta is not positive: 0", "base": "Baseline row count mismatch: 2 != expected 3", "cand": "Candidate row count mismatch: 2 != expected 3"}
    assert (r.reasons, r.passed) == (says[case], case == "none")
    if case == "none":
        empty = P.promotion_gate(base.limit(0), cand.limit(0), asks.limit(0)).first()
        assert empty.reasons == "Net coverage delta is not positive: 0" and empty.base_drops is None


def test_candidates_against_a_fold(spark):
    rng = random.Random(4)
    fields = ("avg_total", "min_avg_final", "math_req")
    table_rows = [(k, rng.choice(["North", "South", ""]), f"P{rng.randint(0, 9)}", rng.choice(["D", "C"]), "https://x/ ", *[rng.choice(["", "5", "a"]) for _ in fields]) for k in range(1, 31)]
    schema = "row_no long, institution string, program string, credential_type string, program_url string, " + ", ".join(f"{f} string" for f in fields)
    table = spark.createDataFrame(table_rows, schema)
    for f in set(P.APPLIED) - set(fields):
        table = table.selectExpr("*", f"'' AS {f}")
    cand_rows = [(k, rng.choice(["", "canonical_000003", "canonical_99", "CANONICAL_5"]), rng.choice(["north", "south", ""]), f"p{rng.randint(0, 9)}", rng.choice(["d", "c", ""]), rng.choice(["", "", "boom"]), rng.choice(["", "day", "night"]), *[x for _ in fields for x in (rng.choice(["", "5", "6", "A"]), rng.choice(["High", "low", "medium"]))]) for k in range(80)]
    cand = spark.createDataFrame(cand_rows, "seq long, index_row_id string, institution string, program_name string, credential string, error string, profile string, " + ", ".join(f"{f} string, {f}_confidence string" for f in fields))
    for f in set(P.APPLIED) - set(fields):
        cand = cand.selectExpr("*", f"'' AS {f}", f"'high' AS {f}_confidence")
    packs = issues(spark, {"canonical_row_id": "CANONICAL_000003", "field_name": "Minimum Avg", "approval_state": "approved_overwrite"}, {"program": "P4", "credential": "d", "program_url": "https://x", "field_name": "math-req", "approval_state": "Approved_Overwrite"}, {"canonical_row_id": "canonical_000005", "field_name": "avg_total"})
    state = {(r[0], f): v for r in table_rows for f, v in zip(fields, r[5:], strict=True)}
    rows, log = {r[0]: r for r in table_rows}, []
    for seq, rid, inst, prog, cred, error, profile, *values in cand_rows:
        if error or profile not in ("", "day"):
            continue
        n = int(rid.rpartition("_")[2]) if rid else 0
        to = n if n in rows else None
        if to is None and inst and prog:
            same = [k for k, r in rows.items() if (r[1].lower(), r[2].lower()) == (inst, prog)]
            full = [k for k in same if cred and rows[k][3].lower() == cred]
            to = (full[0] if len(full) == 1 else None) if full else (same[0] if len(same) == 1 else None)
        if to is None:
            continue
        for f, v, c in zip(fields, values[::2], values[1::2], strict=True):
            old = state[to, f]
            agreed = (to, f) == (3, "min_avg_final") or f == "math_req" and (rows[to][1].lower(), rows[to][2], rows[to][3]) == ("north", "P4", "D")
            if v and c.lower() in ("high", "medium") and (not old or agreed and old.lower() != v.lower()):
                log.append((to, f, old, v, "overwrite_approved" if old else "fill", seq))
                state[to, f] = v
    new, made = P.apply_candidates(table, cand, packs, profile="day")
    assert sorted((r.row_no, r.field, r.prev_value, r.new_value, r.mode, r.seq) for r in made.collect()) == sorted(log) and any(x[4] != "fill" for x in log)
    got = {(r.row_no, f): r[f] for r in new.collect() for f in fields}
    assert got == state and new.columns == table.columns
    again, _ = P.apply_candidates(new, cand, packs, profile="day")
    assert {(r.row_no, f): r[f] for r in again.collect() for f in fields} == state


def test_queries_have_all_kinds_of_rows(spark):
    notes = {r.notes for r in catalog.QUERIES["jo10_issue_regressions"](spark, SF).collect()}
    assert notes == {P.SAYS_DECISION, P.SAYS_FIELD, P.SAYS_VALUE}
    assert {r.mode for r in catalog.QUERIES["mg10_candidate_log"](spark, SF).collect()} == {"fill", "overwrite_approved"}
    assert len(catalog.QUERIES["qa05_promotion_gate"](spark, SF).first().reasons.split("; ")) >= 4
