"""Queries of two runs: changes, coverage, issues by tiers, the gate, and applying candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators import promotion as P
from sievework.plans.keys import NS
from sievework.plans.registry import query

_low = lambda c: f"lower({NS(c)})"
_key = lambda t, *cs: "concat_ws(chr(31), " + ", ".join(_low(f"{t}.{c}") for c in cs) + ")"
_FULL = ("institution", "program_name", "credential", "source_url")
_LONG = lambda t, fields: " UNION ALL ".join(f"SELECT seq, {_key(t, *_FULL)} AS k, '{f}' AS field, {NS(f)} AS v FROM {t}" for f in fields)
_LAST = lambda t: f"(SELECT max(seq) FROM {t} GROUP BY {_key(t, *_FULL)})"
_CHANGES = f"""bl AS (SELECT * FROM ({_LONG("v_run_base", P.FIELDS)}) WHERE seq IN {_LAST("v_run_base")}), cl AS (SELECT * FROM ({_LONG("v_run_cand", P.FIELDS)}) WHERE seq IN {_LAST("v_run_cand")}),
  ch AS (SELECT coalesce(bl.k, cl.k) AS k, coalesce(bl.field, cl.field) AS field, coalesce(bl.v, '') AS b, coalesce(cl.v, '') AS c, bl.seq AS bs, cl.seq AS cs FROM bl FULL JOIN cl ON bl.k = cl.k AND bl.field = cl.field WHERE coalesce(bl.v, '') <> coalesce(cl.v, ''))"""


@query(
    "jo09_field_changes", "v_run_base", "v_run_cand",
    sql=f"""WITH {_CHANGES} SELECT {", ".join(f"coalesce(nullif({NS(f'y.{n}')}, ''), {NS(f'x.{n}')}) AS {n}" for n in _FULL)}, field AS field_name, b AS baseline_value, c AS candidate_value
      FROM ch LEFT JOIN v_run_base x ON x.seq = bs LEFT JOIN v_run_cand y ON y.seq = cs""",
)
def jo09(base: DataFrame, cand: DataFrame) -> DataFrame:
    """All 15 fields that differ between two runs."""
    return P.field_changes(base, cand)


@query("ag04_coverage_of_runs", "v_run_base", "v_run_cand", sql=" UNION ALL ".join(f"SELECT '{f}' AS field, b AS baseline_filled, c AS candidate_filled, c - b AS delta FROM (SELECT (SELECT count(*) FROM v_run_base WHERE {NS(f)} <> '') AS b, (SELECT count(*) FROM v_run_cand WHERE {NS(f)} <> '') AS c)" for f in P.FIELDS))
def ag04(base: DataFrame, cand: DataFrame) -> DataFrame:
    return P.coverage_delta(base, cand)


_ALIAS = lambda names: f"CASE regexp_replace(replace({_low('field_name')}, '-', '_'), '\\s+', '_', 'g') " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in names.items()) + f" ELSE regexp_replace(replace({_low('field_name')}, '-', '_'), '\\s+', '_', 'g') END"
_LIST = "(" + ", ".join(f"'{f}'" for f in P.FIELDS) + ")"
_ISSUES = f"""i AS (SELECT *, {_low("expected_value")} AS want, {_ALIAS(P.FIELD_NAMES)} AS named, CASE {_low("issue_type")} WHEN 'min_average' THEN 'min_avg_final' WHEN 'competitive_guidance' THEN 'competitive_final' WHEN 'avg_total' THEN 'avg_total' WHEN 'required_course' THEN 'english_req' ELSE '' END AS typed
    FROM v_issues WHERE {_low("status")} NOT IN ('closed', 'done', 'resolved', 'ignore', 'ignored') AND {NS("expected_value")} <> ''),
  f AS (SELECT *, CASE WHEN named IN {_LIST} THEN named ELSE typed END AS field FROM i WHERE {_low("issue_type")} <> 'irrelevant_program'),
  dec AS (SELECT {_key("v_decided_cand", "institution", "program_name", "source_url")} AS k, arg_max({_low("decision")}, seq) AS decision FROM v_decided_cand GROUP BY 1),
  ids AS (SELECT {_low("index_row_id")} AS k, any_value(seq) AS seq FROM v_run_cand WHERE {_low("index_row_id")} <> '' GROUP BY 1 HAVING count(*) = 1),
  fulls AS (SELECT {_key("v_run_cand", *_FULL)} AS k, max(seq) AS seq FROM v_run_cand GROUP BY 1), shorts AS (SELECT {_key("v_run_cand", *_FULL[:3])} AS k, any_value(seq) AS seq FROM v_run_cand GROUP BY 1 HAVING count(*) = 1),
  looked AS (SELECT f.*, coalesce(ids.seq, fulls.seq, shorts.seq) AS cs FROM f LEFT JOIN ids ON ids.k = {_low("canonical_row_id")} LEFT JOIN fulls ON fulls.k = {_key("f", "institution", "program", "credential", "program_url")} LEFT JOIN shorts ON shorts.k = {_key("f", "institution", "program", "credential")}),
  val AS (SELECT looked.*, coalesce(l.v, '') AS actual FROM looked LEFT JOIN ({_LONG("v_run_cand", P.FIELDS)}) l ON l.seq = cs AND l.field = looked.field WHERE looked.field IN {_LIST}),
  reg AS (SELECT issue_id, {NS("issue_type")} AS issue_type, 'irrelevant_program' AS field_name, {NS("expected_value")} AS expected_value, coalesce(dec.decision, '') AS actual_value, 'Candidate relevance decision mismatch.' AS notes
    FROM i LEFT JOIN dec ON dec.k = {_key("i", "institution", "program", "program_url")} WHERE {_low("issue_type")} = 'irrelevant_program' AND coalesce(dec.decision, '') <> want
    UNION ALL SELECT issue_id, {NS("issue_type")}, field, {NS("expected_value")}, '', 'Could not resolve field_name to candidate column.' FROM f WHERE field NOT IN {_LIST}
    UNION ALL SELECT issue_id, {NS("issue_type")}, field, {NS("expected_value")}, actual, 'Candidate value does not match expected_value.' FROM val WHERE lower(actual) <> want)"""


@query("jo10_issue_regressions", "v_issues", "v_run_cand", "v_decided_cand", sql=f"WITH {_ISSUES} SELECT * FROM reg")
def jo10(issues: DataFrame, cand: DataFrame, decisions: DataFrame) -> DataFrame:
    """Open issues that a run doesn't meet: by row id, full key or short key; relevance by its decision."""
    return P.issue_regressions(issues, cand, decisions)


_DROPS = lambda t: f"(SELECT count(*) FROM {t} WHERE {_low('decision')} = 'drop' AND {_low('reason_code')} IN ('dropped_evidence_non_program', 'dropped_blocked_url', 'dropped_blocked_name', 'dropped_not_in_seed', 'dropped_override_exclude'))"
_FILLED = lambda t: "(SELECT " + " + ".join(f"count(*) FILTER (WHERE {NS(f)} <> '')" for f in P.FIELDS) + f" FROM {t})"


@query(
    "qa05_promotion_gate", "v_run_base", "v_run_cand", "v_issues", "v_decided_base", "v_decided_cand",
    sql=f"""WITH {_CHANGES}, {_ISSUES}, g AS (SELECT (SELECT count(*) FROM v_run_base) AS base_rows, (SELECT count(*) FROM v_run_cand) AS cand_rows, ({_FILLED("v_run_cand")} - {_FILLED("v_run_base")})::BIGINT AS net_coverage,
        (SELECT count(*) FROM ch) AS changes, (SELECT count(*) FROM reg) AS regressions, {_DROPS("v_decided_base")} AS base_drops, {_DROPS("v_decided_cand")} AS cand_drops),
      r AS (SELECT *, concat_ws('; ', CASE WHEN regressions > 0 THEN 'Issue-pack regressions found: ' || regressions END, CASE WHEN cand_drops > base_drops THEN 'Candidate irrelevant drop count increased: ' || cand_drops || ' > ' || base_drops END,
        CASE WHEN net_coverage <= 0 THEN 'Net coverage delta is not positive: ' || net_coverage END, CASE WHEN base_rows <> 200 THEN 'Baseline row count mismatch: ' || base_rows || ' != expected 200' END, CASE WHEN cand_rows <> 100 THEN 'Candidate row count mismatch: ' || cand_rows || ' != expected 100' END) AS reasons FROM g)
      SELECT *, reasons = '' AS passed FROM r""",
)
def qa05(base: DataFrame, cand: DataFrame, issues: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    return P.promotion_gate(base, cand, issues, before, after, 200, 100)


_NAME = lambda t, p: f"{_low(f'{t}.institution')} <> '' AND {_low(f'{t}.{p}')} <> ''"
_IDENT = lambda t, c: f"concat_ws(chr(31), {_low(f'{t}.institution')}, {_low(f'{t}.program')}, {_low(f'{t}.{c}')}, regexp_replace({_low(f'{t}.program_url')}, '/+$', ''))"
_OFFERS = " UNION ALL ".join(f"SELECT seq, '{f}' AS field, {NS(f)} AS v, {_low(f'{f}_confidence')} AS confidence FROM fit" for f in P.APPLIED)
_HAD = " UNION ALL ".join(f"SELECT row_no, '{f}' AS field, {NS(f)} AS old FROM v_run_base" for f in P.APPLIED)
_APPLY = f"""fit AS (SELECT * FROM v_run_cand WHERE {NS("error")} = '' AND {_low("profile")} IN ('', 'day')),
  t1 AS (SELECT {_key("v_run_base", "institution", "program", "credential_type")} AS k, min(row_no) AS row_no, count(*) AS n FROM v_run_base WHERE {_NAME("v_run_base", "program")} GROUP BY 1), t2 AS (SELECT {_key("v_run_base", "institution", "program")} AS k, min(row_no) AS row_no FROM v_run_base WHERE {_NAME("v_run_base", "program")} GROUP BY 1 HAVING count(*) = 1),
  hit AS (SELECT c.seq, CASE WHEN b.row_no IS NOT NULL THEN b.row_no WHEN t1.n IS NOT NULL THEN CASE WHEN t1.n = 1 THEN t1.row_no END ELSE t2.row_no END AS row_no FROM fit c LEFT JOIN v_run_base b ON b.row_no = try_cast(regexp_extract({_low("c.index_row_id")}, '^canonical_([0-9]+)$', 1) AS BIGINT)
    LEFT JOIN t1 ON {_NAME("c", "program_name")} AND {_low("c.credential")} <> '' AND t1.k = {_key("c", "institution", "program_name", "credential")} LEFT JOIN t2 ON {_NAME("c", "program_name")} AND t2.k = {_key("c", "institution", "program_name")}),
  ok AS (SELECT *, {_ALIAS(P.APPLIED_NAMES)} AS f FROM v_issues WHERE {_low("approval_state")} = 'approved_overwrite'),
  yes AS (SELECT DISTINCT b.row_no, ok.f AS field FROM v_run_base b JOIN ok ON {_low("ok.canonical_row_id")} = printf('canonical_%06d', b.row_no) OR ({_NAME("ok", "program")} AND {_IDENT("ok", "credential")} = {_IDENT("b", "credential_type")})),
  o AS (SELECT hit.row_no, x.*, h.old, yes.row_no IS NOT NULL AS agreed, row_number() OVER (PARTITION BY hit.row_no, x.field ORDER BY x.seq) AS place FROM ({_OFFERS}) x JOIN hit USING (seq) JOIN ({_HAD}) h ON h.row_no = hit.row_no AND h.field = x.field LEFT JOIN yes ON yes.row_no = hit.row_no AND yes.field = x.field WHERE x.v <> '' AND confidence IN ('high', 'medium')),
  walk AS (SELECT row_no, field, place, CASE WHEN old = '' OR agreed AND lower(old) <> lower(v) THEN v ELSE old END AS now, old AS before, old = '' OR agreed AND lower(old) <> lower(v) AS changed, old = '' AS fills, confidence, seq FROM o WHERE place = 1
    UNION ALL SELECT o.row_no, o.field, o.place, CASE WHEN agreed AND lower(now) <> lower(v) THEN v ELSE now END, now, agreed AND lower(now) <> lower(v), false, o.confidence, o.seq FROM walk w JOIN o ON o.row_no = w.row_no AND o.field = w.field AND o.place = w.place + 1)"""


@query(
    "mg10_candidate_log", "v_run_base", "v_run_cand", "v_issues",
    sql=f"WITH RECURSIVE {_APPLY} SELECT printf('canonical_%06d', row_no) AS row_id, field, before AS prev_value, now AS new_value, CASE WHEN fills THEN 'fill' ELSE 'overwrite_approved' END AS mode, confidence, seq FROM walk WHERE changed",
)
def mg10_log(table: DataFrame, cand: DataFrame, issues: DataFrame) -> DataFrame:
    """What taking the day's candidates into the table changes."""
    return P.apply_candidates(table, cand, issues, profile="Day")[1].drop("row_no")


@query(
    "mg10_applied_table", "v_run_base", "v_run_cand", "v_issues",
    sql=f"""WITH RECURSIVE {_APPLY}, fin AS (SELECT row_no, field, arg_max(now, seq) AS v FROM walk WHERE changed GROUP BY 1, 2)
      SELECT b.row_no, {", ".join(f"coalesce((SELECT v FROM fin WHERE fin.row_no = b.row_no AND field = '{f}'), b.{f}) AS {f}" for f in P.APPLIED)} FROM v_run_base b""",
)
def mg10_table(table: DataFrame, cand: DataFrame, issues: DataFrame) -> DataFrame:
    """The table after that."""
    return P.apply_candidates(table, cand, issues, profile="Day")[0].select("row_no", *[F.col(f) for f in P.APPLIED])
