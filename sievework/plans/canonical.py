"""Queries of the canonical merge: structured values, rule sets, overrides, last normalisation, and all of them in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators import canonical as K
from sievework.operators import gates as G
from sievework.operators import quality as Q
from sievework.operators.canonical import OVERRIDES, STRUCTURED, WEAK
from sievework.plans.evaluation import _REASONS, _RULES as _ROW_RULES
from sievework.plans.keys import BLANKISH, HTTP, MODE, NK, NS, TOKENS, UK, WORDS, _display
from sievework.plans.registry import query

# SQL of the steps: each takes the name of a table of rows and gives a SELECT with the same columns.
_TEXTS = ("institution", "program", "credential_type", "status", "program_url", *STRUCTURED)
_low = lambda c: f"lower({NS(c)})"
_START = f"SELECT * REPLACE ({', '.join(f'{NS(c)} AS {c}' for c in _TEXTS)}) FROM v_table"


def _structured(src: str) -> str:
    keyed = lambda t, i: f"SELECT {i}, {_low('institution')} AS i, {NK('program')} AS p, {_low('credential_type')} AS c, {UK('program_url')} AS u FROM {t}"
    tier = lambda n, by, where: f"SELECT row_id, {n} AS t, max(cand_id) AS s FROM ({keyed(src, 'row_id')}) JOIN ({keyed('v_found', 'cand_id')}) USING ({by}) WHERE {where} GROUP BY 1"
    best = f"SELECT row_id, arg_min(s, t) AS s FROM ({tier(0, 'i, u', chr(117) + ' <> ' + chr(39) * 2)} UNION ALL {tier(1, 'i, p, c', 'c <> ' + chr(39) * 2)} UNION ALL {tier(2, 'i, p', 'true')}) GROUP BY 1"

    def value(f: str) -> str:
        how = f"coalesce({_low(f'x.{f}_confidence')}, '')"
        weak = f" OR ({how} = 'low' AND {BLANKISH(f'v.{f}')})" if f in WEAK else ""
        return f"CASE WHEN {NS(f'x.{f}')} <> '' AND ({how} IN ('high', 'medium'){weak}) THEN {NS(f'x.{f}')} ELSE v.{f} END AS {f}"

    return f"SELECT v.* REPLACE ({', '.join(map(value, STRUCTURED))}) FROM {src} v LEFT JOIN ({best}) b ON b.row_id = v.row_id LEFT JOIN v_found x ON x.cand_id = b.s"


def _forms(src: str) -> str:
    modes = ", ".join(f"{MODE(s, f'{s}_req', f'{s}_requirement_mode')} AS {s[0]}m" for s in ("english", "math"))
    shown = {"english": _display("english", "em"), "math": f"CASE WHEN mm = 'elp' AND {NS('math_req')} = '' THEN 'English language proficiency' ELSE {_display('math', 'mm')} END"}
    both = ", ".join(f"{t} AS {s}_req, CASE WHEN ({t}) = '' THEN '' ELSE {s[0]}m END AS {s}_requirement_mode" for s, t in shown.items())
    return f"SELECT * EXCLUDE (em, mm) REPLACE ({both}) FROM (SELECT *, {modes} FROM {src})"


_course = lambda s: f"({MODE(s, f'{s}_req', f'{s}_requirement_mode')} = 'course' AND {NS(f'{s}_req')} <> '')"
_filled = lambda *cs: "(" + " OR ".join(f"{NS(c)} <> ''" for c in cs) + ")"


def _kind(src: str, value: str, then: str) -> str:
    """src with requirement_type replaced by `then`, in which {k} is the form of `value`."""
    sub, average = f"({_course('english')} OR {_course('math')} OR {_filled('social_req', 'science_req', 'min_avg_final', 'elective_qty')})", _filled("min_avg_final", "avg_total")
    first = f"SELECT *, trim(regexp_replace({NS(value)}, '(?i);\\s*notes:\\s*notes:\\s*', '; notes: ', 'g')) AS kx, {sub} AS ks, ({sub} OR {average}) AS ka, {_low('math_assessment_flag')} = 'yes' AS km, CASE WHEN NOT {average} AND {_filled('english_min', 'math_min', 'social_min', 'science_min')} THEN 'course_min_only' ELSE 'alberta_high_school_courses' END AS kt FROM {src}"
    second = f"SELECT *, lower(kx) AS kl, CASE WHEN strpos(lower(kx), '; notes:') > 0 THEN substr(kx, strpos(lower(kx), '; notes:')) ELSE '' END AS kn FROM ({first})"
    form = """CASE WHEN kx = '' OR kl = 'unknown' THEN CASE WHEN km AND NOT ka THEN 'placement_assessment' WHEN ks THEN kt ELSE kx END
        WHEN km AND NOT starts_with(kl, 'placement_assessment') THEN concat(CASE WHEN ka THEN kt ELSE 'placement_assessment' END, kn) WHEN ka AND starts_with(kl, 'placement_assessment') THEN concat(kt, kn)
        WHEN regexp_matches(kl, '^(alberta_high_school_courses|course_min_only|placement_assessment|post_secondary_pathway|regular_admission|first_year_admission)(;|$)') THEN kx
        WHEN regexp_matches(kl, 'placement|assessment|accuplacer|casper') THEN concat(CASE WHEN ka THEN 'alberta_high_school_courses' ELSE 'placement_assessment' END, '; notes: ', kx) WHEN contains(kl, 'regular admission') THEN concat('regular_admission; notes: ', kx)
        WHEN ks OR regexp_matches(kl, 'see degree|refer to degree|group [abcd]|(english|mathematics|biology|chemistry|physics|science|social studies) 30') THEN concat('alberta_high_school_courses; notes: ', kx) ELSE kx END"""
    return f"SELECT * EXCLUDE (kx, ks, ka, km, kt, kl, kn) REPLACE ({then.format(k=form)} AS requirement_type) FROM ({second})"


_WORD = lambda c: f"coalesce(nullif(list_position({WORDS}, {c}), 0), 0)"
_COUNT = lambda c: f"CASE WHEN regexp_matches({c}, '\\b[0-9]+\\b') THEN regexp_extract({c}, '\\b([0-9]+)\\b', 1)::INTEGER ELSE {_WORD(c)} END"
_OF = f"regexp_extract({_low('science_req')}, '\\b(one|two|three|four|five|six|seven|eight|nine|ten|[0-9]+)\\s+of\\b', 1)"
_NAMES = f"len(list_distinct(list_filter(regexp_split_to_array({NS('science_req')}, '\\s*,\\s*|\\s+and\\s+'), lambda p: regexp_matches(lower(p), '\\b(english|ela|math|mathematics|social|aboriginal|biology|chemistry|physics|science|physical education|recreation)\\b'))))"
_UNITS = f"CASE WHEN {NS('science_req')} = '' THEN 0 WHEN {_OF} <> '' THEN {_COUNT(_OF)} WHEN regexp_matches({_low('science_req')}, '\\bor\\b') THEN 1 WHEN {_NAMES} BETWEEN 2 AND 6 THEN {_NAMES} ELSE 1 END"
_FIVE = f"(({_course('english')})::INT + ({_course('math')})::INT + ({NS('social_req')} <> '')::INT + {_UNITS} + {_COUNT(_low('elective_qty'))}) = 5"

_TOTAL = f"CASE WHEN NOT contains({_low('requirement_type')}, 'placement_assessment') AND ({NS('min_avg_final')} <> '' OR starts_with({_low('requirement_type')}, 'alberta_high_school_courses')) AND {_FIVE} THEN '5' ELSE '' END"


def _inferred(src: str) -> str:
    typed = _kind(src, "requirement_type", f"CASE WHEN {NS('requirement_type')} = '' THEN requirement_type ELSE {{k}} END")
    total = f"CASE WHEN {NS('avg_total')} <> '' THEN avg_total ELSE {_TOTAL} END"
    return f"SELECT * REPLACE ({total} AS avg_total) FROM ({typed})"


_says = lambda c: f"{_low(c)} NOT IN ('', 'unknown', 'none', 'null', 'nan', 'no')"
_SIGNAL = "(" + " OR ".join([*[f"({_course(s)} AND {_says(f'{s}_req')})" for s in ("english", "math")], *[_says(c) for c in ("min_avg_final", "social_req", "science_req", "elective_qty", "hs_diploma_req")]]) + ")"
_RULES = f"""SELECT {_low('institution')} AS ri, {NS('ruleset_key')} AS rk, CASE WHEN {_low('credential_scope')} = 'any' THEN [] ELSE list_filter(list_transform(regexp_split_to_array({_low('credential_scope')}, '[|,;/]'), lambda x: trim(x)), lambda x: x <> '') END AS rs, {_low('requirement_type_pattern')} AS rp, coalesce(try_cast(default_avg_total AS DOUBLE)::INTEGER, 0) AS rt, {_low('placement_required')} IN ('yes', 'y', 'true', '1', 'required') AS rf FROM v_rulesets"""


def _ruled(src: str) -> str:
    fits = f"(len(rs) = 0 OR ({_low('credential_type')} <> '' AND len(list_filter(rs, lambda s: contains({_low('credential_type')}, s))) > 0)) AND (rp = '' OR CASE WHEN zk <> '' THEN contains(zk, rp) ELSE zs END)"
    rows = f"SELECT *, {_low('requirement_type')} AS zk, {_SIGNAL} AS zs, {_low('institution')} AS ri FROM {src}"
    first = f"SELECT row_id, rk, rp, rt, rf FROM ({rows}) JOIN ({_RULES}) USING (ri) WHERE (rt > 0 OR rf) AND {fits} QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY (len(rs) > 0)::INT + (rp <> '')::INT DESC, lower(rk), rk) = 1"
    held = f"SELECT z.* EXCLUDE (ri) REPLACE (CASE WHEN {NS('avg_total')} = '' AND coalesce(rt, 0) > 0 THEN rt::VARCHAR ELSE avg_total END AS avg_total), f.* EXCLUDE (row_id, rt, rk) FROM ({rows}) z LEFT JOIN ({first}) f ON f.row_id = z.row_id"
    typed = _kind(f"({held})", "rp", "CASE WHEN zk IN ('', 'unknown') AND coalesce(rp, '') <> '' AND zs THEN {k} ELSE requirement_type END")
    return f"SELECT * EXCLUDE (zk, zs, rp, rf) REPLACE (CASE WHEN coalesce(rf, false) AND {BLANKISH('math_assessment_flag')} THEN 'Yes' ELSE math_assessment_flag END AS math_assessment_flag) FROM ({typed})"


_OV = f"""oa AS (SELECT seq, {_low('institution')} AS i, {NK('program')} AS p, {_low('credential_type')} AS c, {TOKENS('program')} AS tk, list_distinct(list_filter([CASE WHEN {HTTP('source_page_url')} THEN {UK('source_page_url')} END, CASE WHEN {HTTP('parent_admissions_url')} THEN {UK('parent_admissions_url')} END], lambda x: x IS NOT NULL)) AS us
    FROM v_program_overrides WHERE {_low('status')} NOT IN ('inactive', 'disabled', 'archived', 'off', 'no', 'false', '0') AND {NK('program')} <> ''),
  ou AS (SELECT seq, i, p, c, unnest(us) AS u FROM oa), ov AS (SELECT row_id, {_low('institution')} AS i, {NK('program')} AS p, {_low('credential_type')} AS c, {UK('program_url')} AS u, {TOKENS('program')} AS tk FROM v_table),
  oj AS (SELECT row_id, seq, (o.c = '' OR o.c = v.c) AS cok, o.p = v.p AS pok FROM ov v JOIN ou o USING (i, u) WHERE v.u <> ''),
  ot AS (SELECT row_id, 0 AS t, count(*) AS n, min(seq) AS seq FROM oj GROUP BY 1 UNION ALL SELECT row_id, 1, count(*), min(seq) FROM oj WHERE cok GROUP BY 1 UNION ALL SELECT row_id, 2, count(*), min(seq) FROM oj WHERE cok AND pok GROUP BY 1
    UNION ALL SELECT row_id, 3, 1, max(oa.seq) FROM ov JOIN oa USING (i, p, c) GROUP BY 1 UNION ALL SELECT row_id, 4, 1, max(oa.seq) FROM ov JOIN oa USING (i, p) WHERE oa.c = '' GROUP BY 1),
  ok AS (SELECT row_id, arg_min(seq, t) AS seq, min(t) AS t FROM ot WHERE n = 1 GROUP BY 1),
  os AS (SELECT v.row_id, oa.seq, len(list_intersect(v.tk, oa.tk)) / (len(v.tk) + len(oa.tk) - len(list_intersect(v.tk, oa.tk)))::DOUBLE AS score FROM ov v JOIN oa USING (i) WHERE v.row_id NOT IN (SELECT row_id FROM ok) AND (v.c = '' OR oa.c = '' OR oa.c = v.c) AND len(list_intersect(v.tk, oa.tk)) > 0),
  og AS (SELECT row_id, max(score) AS best FROM os GROUP BY 1), oz AS (SELECT row_id, min(seq) AS seq FROM os JOIN og USING (row_id) WHERE best >= 0.62 AND best - score < 0.1 GROUP BY 1 HAVING count(*) = 1),
  od AS (SELECT row_id, seq, ['url', 'url_credential', 'url_program', 'key', 'key_without_credential'][t + 1] AS tier FROM ok UNION ALL SELECT row_id, seq, 'name' FROM oz)"""
_OVERRIDE_URL = f"CASE WHEN {HTTP('o.parent_admissions_url')} THEN {NS('o.parent_admissions_url')} WHEN {HTTP('o.source_page_url')} THEN {NS('o.source_page_url')} END"


def _overridden(src: str) -> str:
    fields = ", ".join(f"coalesce(nullif({NS(f'o.{c}')}, ''), v.{f}) AS {f}" for f, c in OVERRIDES.items())
    return f"SELECT v.* REPLACE ({fields}, CASE WHEN NOT {HTTP('v.program_url')} THEN coalesce({_OVERRIDE_URL}, v.program_url) ELSE v.program_url END AS program_url) FROM {src} v LEFT JOIN od ON od.row_id = v.row_id LEFT JOIN v_program_overrides o ON o.seq = od.seq"


def _last(src: str) -> str:
    clean = f"CASE WHEN regexp_matches({_low('competitive_final')}, 'to be considered for admission to the program|international students must qualify for admission|^nimum grades you need to achieve|^entrance requirements:') THEN 'Competitive varies by year' ELSE {NS('competitive_final')} END"
    held = f"(SELECT * REPLACE ({clean} AS competitive_final) FROM ({_forms(src)}))"
    typed = _kind(held, "requirement_type", f"coalesce(nullif(replace({NS('({k})')}, 'notes: notes:', 'notes: '), ''), requirement_type)")
    placed = f"SELECT * REPLACE (CASE WHEN starts_with({_low('requirement_type')}, 'placement_assessment') THEN '' ELSE avg_total END AS avg_total) FROM ({typed})"
    notes = f"CASE WHEN strpos({_low('requirement_type')}, '; notes:') > 0 THEN substr({NS('requirement_type')}, strpos({_low('requirement_type')}, '; notes:')) ELSE '' END"
    low, named = _low("requirement_type"), f"({_course('english')} OR {_course('math')} OR {_filled('social_req', 'science_req')})"
    only = f"starts_with({low}, 'alberta_high_school_courses') AND NOT {_filled('min_avg_final')} AND NOT {_filled('avg_total')} AND {named}"
    way = f"starts_with({low}, 'regular_admission') AND contains({low}, 'post-secondary pathway')"
    moved = f"SELECT * REPLACE (CASE WHEN {only} THEN concat('course_min_only', {notes}) WHEN {way} THEN concat('post_secondary_pathway', {notes}) ELSE requirement_type END AS requirement_type) FROM ({placed})"
    away = f"starts_with({low}, 'post_secondary_pathway')"
    flagged = f"SELECT * REPLACE (CASE WHEN {away} THEN 'No' ELSE hs_diploma_req END AS hs_diploma_req, CASE WHEN {away} THEN 'No' ELSE math_assessment_flag END AS math_assessment_flag) FROM ({moved})"
    academic = f"({named} OR regexp_matches({low}, '^(alberta_high_school_courses|course_min_only)'))"
    gate = f"({_low('english_requirement_mode')} = 'elp' OR {_low('math_requirement_mode')} IN ('placement_assessment', 'other_gate') OR starts_with({low}, 'placement_assessment'))"
    shown = f"CASE WHEN {_low('hs_diploma_req')} = 'no' OR {away} OR ({_low('credential_type')} = 'other' AND NOT {academic}) OR (NOT {academic} AND ({_filled('min_avg_final', 'avg_total')} OR {gate})) THEN 'No' ELSE 'Yes' END"
    return f"SELECT * REPLACE ({shown} AS display_for_high_school) FROM ({flagged})"


_ALL = ("row_id", *_TEXTS, "display_for_high_school")


@query("mg02_structured_fields", "v_table", "v_found", sql=f"WITH n AS ({_START}), s AS ({_structured('n')}) SELECT row_id, {', '.join(STRUCTURED)} FROM s")
def mg02(table: DataFrame, found: DataFrame) -> DataFrame:
    """All 23 fields."""
    return K.apply_structured(K.start(table), found).select("row_id", *STRUCTURED)


@query("mg04_infer_average_total", "v_canonical", sql=f"SELECT row_id, {_TOTAL} AS avg_total FROM v_canonical")
def mg04(df: DataFrame) -> DataFrame:
    return df.select("row_id", Q.infer_average_total().alias("avg_total"))


@query("mg05_rule_sets", "v_table", "v_rulesets", sql=f"WITH n AS ({_START}), r AS ({_ruled('n')}) SELECT row_id, avg_total, requirement_type, math_assessment_flag FROM r")
def mg05(table: DataFrame, rules: DataFrame) -> DataFrame:
    return K.apply_rulesets(K.start(table), rules).select("row_id", "avg_total", "requirement_type", "math_assessment_flag")


@query("mg06_program_overrides", "v_table", "v_program_overrides", sql=f"WITH n AS ({_START}), {_OV}, r AS ({_overridden('n')}) SELECT r.row_id, tier, {', '.join(f'r.{f}' for f in OVERRIDES)}, r.program_url FROM r LEFT JOIN od ON od.row_id = r.row_id")
def mg06(table: DataFrame, overrides: DataFrame) -> DataFrame:
    """The override of a row by six tiers, and its four fields."""
    held = K.with_overrides(K.start(table), overrides)
    return K.apply_overrides(held.withColumn("tier", F.col("__override.tier"))).select("row_id", "tier", *OVERRIDES, "program_url")


@query("mg07_final_normalise", "v_table", sql=f"WITH n AS ({_START}), f AS ({_last('n')}) SELECT {', '.join(_ALL)} FROM f")
def mg07(table: DataFrame) -> DataFrame:
    return K.final_normalise(K.start(table)).select(*_ALL)


_MERGE = f"""n AS ({_START}), {_OV}, k AS (SELECT n.* FROM n LEFT JOIN od ON od.row_id = n.row_id LEFT JOIN v_program_overrides o ON o.seq = od.seq WHERE coalesce({_low('o.include_or_exclude')}, '') <> 'exclude'),
  s AS ({_structured('k')}), f AS ({_forms('s')}), i AS MATERIALIZED ({_inferred('f')}), r AS MATERIALIZED ({_ruled('i')}), o AS MATERIALIZED ({_overridden('r')}), l AS MATERIALIZED ({_last('o')})"""


@query(
    "mg09_build_canonical", "v_table", "v_found", "v_rulesets", "v_program_overrides",
    sql=f"WITH {_MERGE} SELECT {', '.join(_ALL)} FROM l QUALIFY institution = 'East' OR row_number() OVER (PARTITION BY {', '.join(f'lower({c})' for c in _ALL if c != 'row_id')} ORDER BY row_id) = 1",
)
def mg09(table: DataFrame, found: DataFrame, rules: DataFrame, overrides: DataFrame) -> DataFrame:
    """The whole merge."""
    return K.build_canonical(table, found, rules, overrides, preserve=("East",)).select(*_ALL)


_k = _low("requirement_type")
_TWELVE = [(c, t.replace("lower(math_assessment_flag) = 'yes'", f"{_low('math_assessment_flag')} NOT IN ('', 'no', 'n', 'false', '0', 'none', 'unknown')")) for c, t in _REASONS] + [
    ("inheritance_placeholder", f"regexp_matches({_k}, '(see|refer to) (degree|program)|see faculty')"), ("credential_backfill", f"{NS('institution')} = 'NorQuest' AND ({BLANKISH('credential_type')} OR {BLANKISH('status')})"),
    ("note_dump", f"{NS('institution')} = 'UAlberta' AND (contains({_k}, 'notes: notes:') OR (contains({_k}, 'notes:') AND NOT regexp_matches({_k}, '^(alberta_high_school_courses|course_min_only|placement_assessment|post_secondary_pathway|regular_admission|first_year_admission)')))"),
]


@query("qa04_twelve_reasons", "v_review", sql=f"SELECT * FROM (SELECT row_id, concat_ws('|', {', '.join(f'CASE WHEN {t} THEN {chr(39)}{c}{chr(39)} END' for c, t in sorted(_TWELVE))}) AS reason_codes FROM v_review) WHERE reason_codes <> ''")
def qa04(df: DataFrame) -> DataFrame:
    return Q.review_queue(df)


_G = lambda *cs: "concat_ws(chr(31), " + ", ".join(_low(c) for c in cs) + ")"
_SIG = "institution, program, credential_type, status, requirement_type, math_assessment_flag, program_url, min_avg_final, competitive_final, avg_total, english_req, english_requirement_mode, math_req, math_requirement_mode, social_req, science_req, elective_qty, hs_diploma_req, display_for_high_school, english_min, math_min".split(", ")
_groups = lambda name, by, where="true", of="count(*)": f"SELECT 'error' AS severity, '{name}' AS gate, '' AS scope, count(*) AS n, NULL::DOUBLE AS share FROM (SELECT {by} AS g FROM v_review WHERE {where} GROUP BY 1 HAVING {of} > 1) HAVING count(*) > 0"
_SEVERITY = {"avg_total_without_minimum": "warning", "avg_total_suspicious": "warning", "course_average_context": "warning"}
_COUNTED = [(r, t) for r, t in _ROW_RULES if r not in ("url_missing", "key_blank") and not r.startswith(("english_min_", "math_min_"))] + [("key_blank", " OR ".join(BLANKISH(c) for c in ("institution", "program", "credential_type", "program_url"))), ("course_average_context", dict(_REASONS)["course_average_context"])]
_LOCAL = [(f"blank_{f}", BLANKISH(f), "rows >= 10 AND n / rows >= 0.75") for f in ("requirement_type", "min_avg_final", "math_req", "english_req")] + [(f"spike_{t}", f"contains({_k}, '{t}')", "n >= 10 AND n / rows >= 0.15") for t in ("interview required", "portfolio required", "audition required", "casper required")]
_LOCAL += [("empty_shell", f"{NS('program_url')} <> '' AND " + " AND ".join(BLANKISH(c) for c in ("requirement_type", "min_avg_final", "competitive_final", "english_req", "math_req", "social_req", "science_req", "elective_qty")), "n > 0")]


@query(
    "qa02_table_gates", "v_review",
    sql=" UNION ALL ".join([
        f"SELECT 'error' AS severity, 'url_missing' AS gate, '' AS scope, n, n / rows::DOUBLE AS share FROM (SELECT count(*) AS rows, count(*) FILTER (WHERE {NS('program_url')} = '') AS n FROM v_review) WHERE n / rows::DOUBLE > 0.05",
        *[f"SELECT '{_SEVERITY.get(r, 'error')}', '{r}', '', count(*), NULL FROM v_review WHERE {t} HAVING count(*) > 0" for r, t in _COUNTED],
        _groups("exact_duplicates", _G(*_SIG)), _groups("key_collisions", _G("institution", "program", "credential_type", "program_url"), of=f"count(DISTINCT {_G('requirement_type', 'min_avg_final', 'elective_qty', 'status')})"),
        _groups("visible_duplicates", _G("institution", "program", "credential_type", "status"), f"{NS('display_for_high_school')} = 'Yes'"),
        *[f"SELECT 'warning', '{g}', scope, n, n / rows::DOUBLE FROM (SELECT {NS('institution')} AS scope, count(*) AS rows, count(*) FILTER (WHERE {t}) AS n FROM v_review GROUP BY 1) WHERE {w}" for g, t, w in _LOCAL],
    ]),
)
def qa02(df: DataFrame) -> DataFrame:
    """All gates of a table, by institution where they are local."""
    return G.table_gates(df)
