"""Queries of evaluation (E), quality (QA) and merge rules (MG)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import evaluate as E
from sievework.operators import quality as Q
from sievework.plans.keys import BLANKISH, HTTP, MODE, NS, WORDS
from sievework.plans.registry import query

_text = lambda x: "'" + x.replace("'", "''") + "'"
_key = "regexp_replace(regexp_replace(upper(trim(coalesce({c}, ''))), '\\.', '', 'g'), '\\s+', ' ', 'g')"
_ALIAS = "MAP {" + ", ".join(f"{_text(k)}: {_text(v)}" for k, v in E.ALIASES.items()) + "}"
CANON = lambda c: f"coalesce({_ALIAS}[{_key.format(c=c)}], {_key.format(c=c)})"
_MARKS = f"marks AS (SELECT student_id, {CANON('course')} AS course_key, arg_max(mark, seq) AS mark FROM v_marks GROUP BY 1, 2)"


@query("pr16_course_key", "v_marks", sql=f"SELECT seq, {CANON('course')} AS course_key FROM v_marks")
def pr16(marks: DataFrame) -> DataFrame:
    return marks.select("seq", E.canonical_course("course").alias("course_key"))


@query("pr17_course_catalog", "v_marks", sql=f"SELECT DISTINCT course, {CANON('course')} AS course_key FROM v_marks")
def pr17(marks: DataFrame) -> DataFrame:
    return marks.select("course").distinct().select("course", E.canonical_course("course").alias("course_key"))


@query("e01_course_marks", "v_marks", sql=f"WITH {_MARKS} SELECT * FROM marks")
def e01(marks: DataFrame) -> DataFrame:
    return E.course_marks(marks)


_EQUIV = "equiv(required, accepted) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b, _ in E.equivalencies()) + ")"


@query("e02_equivalencies", "v_marks", sql=f"WITH {_EQUIV}, c AS (SELECT DISTINCT course FROM v_marks) SELECT course, array_to_string(list_sort(list(coalesce(accepted, {CANON('course')}))), '; ') AS accepted FROM c LEFT JOIN equiv ON required = {CANON('course')} GROUP BY 1")
def e02(marks: DataFrame) -> DataFrame:
    return marks.select("course").distinct().select("course", F.array_join(F.array_sort(E.accepted_keys(F.col("course"))), "; ").alias("accepted"))


def _alternatives(s: str, p: str) -> str:
    name = {"english": "English ", "math": "Math "}[s]
    t = NS(f"replace({p}, '/', ' or ')")
    codes = f"list_transform(regexp_extract_all({t}, '\\b(\\d{{2}}-[12])\\b', 1), lambda c: concat('{name}', c))"
    parts = f"list_filter(regexp_split_to_array({t}, '(?i)\\s+or\\s+'), lambda q: q <> '')"
    out = f"CASE WHEN len({codes}) > 0 THEN {codes} ELSE {parts} END"
    if s == "math":
        out = f"list_transform(CASE WHEN regexp_matches({t}, '(?i)(math|mathematics)\\s*31\\b') AND NOT list_contains({out}, 'Math 31') THEN list_append(list_filter({out}, lambda q: NOT regexp_matches(q, '(?i)^(math|mathematics)\\s*31$')), 'Math 31') ELSE {out} END, lambda q: CASE WHEN q = '31' THEN 'Math 31' ELSE q END)"
    return f"list_distinct({out})"


def _kind(s: str) -> str:
    t, m = NS(f"{s}_req"), MODE(s, f"{s}_req", f"{s}_requirement_mode")
    return f"CASE WHEN {t} = '' THEN 'none' WHEN regexp_matches({t}, '(?i)^(See Degree|Refer to Degree)$') THEN 'unknown' WHEN {m} = 'placement_assessment' THEN 'assessment' WHEN {m} IN ('elp', 'other_gate') THEN 'unknown' WHEN regexp_matches({t}, '(?i)placement|assessment|test') THEN 'assessment' WHEN regexp_matches({t}, '(?i)english language proficiency|\\bunspecified\\b') THEN 'unknown' ELSE 'parts' END"


_sub = lambda s: f"SELECT row_id, '{s}' AS subject, {_kind(s)} AS kind, nullif(try_cast({s}_min AS DOUBLE), 0) AS min_mark, part_no - 1 AS part_no, 1 AS k, {_alternatives(s, 'p')} AS courses FROM (SELECT *, unnest(list_filter(regexp_split_to_array({NS(f'{s}_req')}, '(?i)\\s+and\\s+'), lambda x: x <> '')) AS p, generate_subscripts(list_filter(regexp_split_to_array({NS(f'{s}_req')}, '(?i)\\s+and\\s+'), lambda x: x <> ''), 1) AS part_no FROM v_canonical)"
_sci = f"SELECT row_id, 'science' AS subject, 'parts' AS kind, NULL::DOUBLE AS min_mark, 0 AS part_no, CASE WHEN regexp_matches(t, '(?i)^(Two|2)\\s+of\\b') THEN 2 ELSE 1 END AS k, list_distinct(list_filter(list_transform(string_split(regexp_replace(regexp_replace(t, '(?i)^(Two|2)\\s+of\\b', ''), '(?i)\\s+or\\s+', ',', 'g'), ','), lambda x: trim(x)), lambda x: x <> '')) AS courses FROM (SELECT row_id, {NS('science_req')} AS t FROM v_canonical) WHERE t <> ''"
_PARTS = f"parts AS (SELECT * FROM ({_sub('english')} UNION ALL {_sub('math')} UNION ALL {_sci}) WHERE kind = 'parts')"


@query("e04_requirement_parts", "v_canonical", sql=f"WITH {_PARTS} SELECT row_id, subject, part_no::INTEGER AS part_no, k::INTEGER AS k, array_to_string(list_sort(courses), '; ') AS courses, min_mark FROM parts")
def e04(programs: DataFrame) -> DataFrame:
    return E.requirement_parts(programs).filter("kind = 'parts'").select("row_id", "subject", "part_no", "k", F.array_join(F.array_sort("courses"), "; ").alias("courses"), "min_mark")


@query("e03_subject_kinds", "v_canonical", sql=f"SELECT row_id, {_kind('english')} AS english, {_kind('math')} AS math FROM v_canonical")
def e03(programs: DataFrame) -> DataFrame:
    kind = lambda s: E.subject_kind(F.col(f"{s}_req"), T.requirement_mode(s, f"{s}_req", f"{s}_requirement_mode"))
    return programs.select("row_id", kind("english").alias("english"), kind("math").alias("math"))


@query(
    "jo17_best_mark", "v_canonical", "v_marks",
    sql=f"""WITH {_PARTS}, {_MARKS}, {_EQUIV}, c AS (SELECT DISTINCT unnest(courses) AS course FROM parts), a AS (SELECT course, coalesce(accepted, {CANON('course')}) AS course_key FROM c LEFT JOIN equiv ON required = {CANON('course')})
      SELECT student_id, course, max(mark) AS mark FROM a JOIN marks USING (course_key) GROUP BY ALL""",
)
def jo17(programs: DataFrame, marks: DataFrame) -> DataFrame:
    parts = E.requirement_parts(programs).filter("kind = 'parts'").select(F.lit(0).alias("part"), "courses").distinct()
    return E.best_marks(parts, E.course_marks(marks)).drop("part")


_gate = f"(SELECT row_id, bool_or(x IN ('unknown', 'assessment')) AS gate FROM (SELECT row_id, unnest([{_kind('english')}, {_kind('math')}]) AS x FROM v_canonical) GROUP BY 1)"


def _evaluated(weight: str) -> str:
    """SQL over all pairs of students and classes; weight: what a class counts."""
    return f"""WITH {_PARTS}, {_MARKS}, {_EQUIV}, p AS (SELECT row_id, md5(concat(k, array_to_string(list_sort(courses), ';'), coalesce(min_mark, -1))) AS part, k, courses, min_mark FROM parts),
      cls AS (SELECT coalesce(parts, []) AS parts, gate, {weight} AS w FROM {_gate} LEFT JOIN (SELECT row_id, list_sort(list(DISTINCT part)) AS parts FROM p GROUP BY 1) USING (row_id) GROUP BY ALL),
      d AS (SELECT DISTINCT ON (part) part, k, courses, min_mark FROM p), dc AS (SELECT part, k, min_mark, unnest(courses) AS course FROM d),
      a AS (SELECT dc.*, coalesce(accepted, {CANON('course')}) AS course_key FROM dc LEFT JOIN equiv ON required = {CANON('course')}),
      b AS (SELECT student_id, part, any_value(k) AS k, course, max(mark) AS mark, any_value(min_mark) AS low FROM a JOIN marks USING (course_key) GROUP BY student_id, part, course),
      met AS (SELECT student_id, part FROM b GROUP BY ALL HAVING count(*) FILTER (WHERE low IS NULL OR mark >= low) >= any_value(k)),
      hits AS (SELECT student_id, parts, gate, count(*) AS n FROM (SELECT parts, gate, unnest(parts) AS part FROM cls) JOIN met USING (part) GROUP BY ALL),
      pairs AS (SELECT s.student_id, c.parts, c.gate, c.w, coalesce((SELECT n FROM hits h WHERE h.student_id = s.student_id AND h.parts = c.parts AND h.gate = c.gate), 0) AS met FROM (SELECT DISTINCT student_id FROM marks) s, cls c)
      SELECT student_id, CASE WHEN met < len(parts) THEN 'ineligible' WHEN gate OR len(parts) = 0 THEN 'uncheckable' ELSE 'likely eligible' END AS status, sum(w)::BIGINT AS n FROM pairs GROUP BY 1, 2"""


@query("e22_evaluate", "v_canonical", "v_marks", sql=_evaluated("1"))
def e22(programs: DataFrame, marks: DataFrame) -> DataFrame:
    return E.evaluate_summary(programs, E.course_marks(marks), "classes")


@query("e22_evaluate_all", "v_canonical", "v_marks", sql=_evaluated("1"))
def e22_all(programs: DataFrame, marks: DataFrame) -> DataFrame:
    """The same, by the name it had when e22_evaluate took a part of the students; here with a row per pair between."""
    return E.evaluate(programs, E.course_marks(marks)).groupBy("student_id", "status").agg(F.count("*").alias("n"))


@query("ag13_result_summary", "v_canonical", "v_marks", sql=_evaluated("count(*)"))
def ag13(programs: DataFrame, marks: DataFrame) -> DataFrame:
    """Eligible, ineligible and uncheckable programs of every student, from the parts that are met."""
    return E.evaluate_summary(programs, E.course_marks(marks))


_words = " ".join(f"WHEN regexp_matches(course_key, '{w}') THEN '{g}'" for g, w in E.GROUP_WORDS)
_EX = "MAP {" + ", ".join(f"{_text(k)}: {_text('/'.join(v))}" for k, v in E.EXACT_GROUPS.items()) + "}"
_GROUPS = f"coalesce({_EX}[course_key], nullif(concat_ws('/', {', '.join(f'CASE WHEN regexp_matches(course_key, {_text(w)}) THEN {_text(g)} END' for g, w in E.GROUP_WORDS)}), ''), CASE WHEN regexp_matches(course_key, '\\b31\\b|\\b(30|35)(-[0-9A-Z]+)?\\b') AND NOT regexp_matches(course_key, 'RAP|REGISTERED APPRENTICESHIP|WORK EXPERIENCE|GREEN CERTIFICATE|SPECIAL PROJECT|K AND E|KNOWLEDGE AND EMPLOYABILITY|LOCALLY DEVELOPED|LDC|\\bCALM\\b') THEN 'D' ELSE '' END)"


@query("e08_elective_groups", "v_marks", sql=f"WITH {_MARKS} SELECT DISTINCT course_key, {_GROUPS} AS groups FROM marks")
def e08(marks: DataFrame) -> DataFrame:
    return E.course_marks(marks).select("course_key").distinct().select("course_key", F.array_join(E.elective_groups(F.col("course_key")), "/").alias("groups"))


@query("e09_elective_candidates", "v_marks", sql=f"WITH {_MARKS} SELECT student_id, course_key, {_GROUPS} AS groups, mark FROM marks WHERE {_GROUPS} <> ''")
def e09(marks: DataFrame) -> DataFrame:
    return E.elective_candidates(E.course_marks(marks)).withColumn("groups", F.array_join("groups", "/"))


@query("e10_allowed_groups", "v_canonical", sql="SELECT row_id, CASE WHEN len(regexp_extract_all(upper(elective_pool), '\\b([ABCD])\\b', 1)) > 0 THEN array_to_string(list_sort(list_distinct(regexp_extract_all(upper(elective_pool), '\\b([ABCD])\\b', 1))), '') ELSE 'ABCD' END AS groups FROM v_canonical")
def e10(programs: DataFrame) -> DataFrame:
    return programs.select("row_id", F.array_join(F.array_sort(E.allowed_groups("elective_pool")), "").alias("groups"))


_QTY = f"coalesce(nullif(list_position({WORDS}, lower(trim(elective_qty))), 0), try_cast(elective_qty AS DOUBLE))"


@query("e11_average_total", "v_canonical", sql=f"SELECT row_id, (CASE WHEN try_cast(avg_total AS DOUBLE) > 0 THEN round(try_cast(avg_total AS DOUBLE)) WHEN {_QTY} IS NOT NULL THEN greatest(0, 2 + {_QTY}) WHEN row_id % 20 = 0 THEN 4 WHEN try_cast(min_avg_final AS DOUBLE) IS NOT NULL THEN 5 ELSE 0 END)::INTEGER AS total FROM v_canonical")
def e11(programs: DataFrame) -> DataFrame:
    total = E.average_total(T.to_number("avg_total"), T.elective_quantity("elective_qty"), F.lit(2), F.when(F.col("row_id") % 20 == 0, 4), F.col("institution"), T.to_number("min_avg_final"), five=("NORTH",))
    return programs.select("row_id", total.alias("total"))


_t = NS("requirement_type")
_place = f"regexp_matches({_t}, '(?i)^placement_assessment(\\b|;)|\\b(placement\\s+(assessment|test)|assessment/placement|accuplacer)\\b')"
_struct = "(try_cast(min_avg_final AS DOUBLE) IS NOT NULL OR " + " OR ".join(f"{NS(c)} <> ''" for c in ("english_req", "math_req", "social_req", "science_req", "elective_qty")) + ")"
_amb = "(" + " OR ".join(f"regexp_matches({NS(c)}, '(?i)\\b(see|refer to)\\s+degree\\b')" for c in ("requirement_type", "english_req", "math_req", "social_req", "science_req", "elective_qty")) + ")"
_loose = "(" + " OR ".join(f"regexp_matches({NS(c)}, '(?i)language proficiency|unspecified')" for c in ("english_req", "math_req")) + ")"
_manual = f"regexp_matches({_t}, '(?i)audition|portfolio|casper|interview|questionnaire')"


@query(
    "e16_confidence", "v_canonical",
    sql=f"""WITH s AS (SELECT row_id, {HTTP('program_url')} AS u, {_manual} AS m, {_loose} AS l, row_id % 3 = 0 AS st, {_place} OR NOT {_struct} OR {_amb} AS un FROM v_canonical),
      p AS (SELECT *, CASE WHEN u THEN 3 ELSE 1 END - m::INT - 2 * l::INT AS score FROM s), c AS (SELECT *, least(CASE WHEN score >= 3 THEN 3 WHEN score >= 2 THEN 2 ELSE 1 END, CASE WHEN u THEN 3 ELSE 1 END, CASE WHEN st THEN 2 ELSE 3 END) AS lv FROM p),
      w AS (SELECT row_id, CASE WHEN un THEN 'Uncheckable' ELSE ['Low', 'Medium', 'High'][lv] END AS confidence, list_filter([CASE WHEN NOT u THEN 'Source link missing.' END, CASE WHEN m THEN 'Manual review needed.' END, CASE WHEN l THEN 'Some text is not checkable.' END, CASE WHEN st THEN 'Data is old.' END], lambda x: x IS NOT NULL) AS why FROM c)
      SELECT row_id, confidence, CASE confidence WHEN 'Medium' THEN coalesce(array_to_string(why[:1], ' | '), '') WHEN 'Low' THEN coalesce(array_to_string(why[:3], ' | '), '') ELSE '' END AS why FROM w""",
)
def e16(programs: DataFrame) -> DataFrame:
    return E.confidence(programs, F.col("row_id") % 3 == 0)


_num = lambda c: f"CASE WHEN regexp_matches(trim({c}), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN trim({c})::DOUBLE END"
_low = f"lower({_t})"
_course = lambda s: f"({MODE(s, f'{s}_req', f'{s}_requirement_mode')} = 'course' AND NOT {BLANKISH(f'{s}_req')})"
_subjects = f"({_course('english')} OR {_course('math')} OR NOT {BLANKISH('social_req')} OR NOT {BLANKISH('science_req')})"
_RULES = [
    ("url_missing", f"{NS('program_url')} = ''"), ("url_not_http", f"{NS('program_url')} <> '' AND NOT {HTTP('program_url')}"), ("key_blank", " OR ".join(BLANKISH(c) for c in ("institution", "program", "credential_type"))),
    ("display_value", f"{NS('display_for_high_school')} NOT IN ('Yes', 'No')"),
    ("assessment_type_mismatch", f"lower(math_assessment_flag) = 'yes' AND {_low} <> '' AND NOT starts_with({_low}, 'placement_assessment') AND NOT {_subjects} AND {BLANKISH('min_avg_final')} AND {BLANKISH('avg_total')}"),
    ("placement_with_avg_total", f"starts_with({_low}, 'placement_assessment') AND NOT {BLANKISH('avg_total')}"), ("avg_total_without_minimum", f"starts_with({_low}, 'alberta_high_school_courses') AND NOT {BLANKISH('avg_total')} AND {BLANKISH('min_avg_final')}"),
    ("avg_total_range", f"{_num('avg_total')} <= 0 OR {_num('avg_total')} > 10"), ("avg_total_suspicious", f"{_num('avg_total')} > 5 AND {_num('avg_total')} <= 10"),
    *[(f"{c}_not_a_number", f"{NS(c)} <> '' AND ({_num(c)}) IS NULL") for c in Q.NUMBERS], *[(f"{c}_range", f"({_num(c)}) NOT BETWEEN 0 AND 100") for c in Q.NUMBERS],
]
for _s in ("english", "math"):
    _e, _m = f"lower({NS(f'{_s}_requirement_mode')})", MODE(_s, f"{_s}_req", f"{_s}_requirement_mode")
    _like = f"regexp_matches({NS(f'{_s}_req')}, '{T._COURSE[_s]}')"
    _RULES += [(f"{_s}_mode_invalid", f"{_e} NOT IN ('', 'course', 'placement_assessment', 'elp', 'other_gate')"), (f"{_s}_mode_conflict", f"{_e} IN ('', 'course', 'placement_assessment', 'elp', 'other_gate') AND {NS(f'{_s}_req')} <> '' AND ((({_m}) IN ('placement_assessment', 'elp', 'other_gate') AND {_like}) OR (({_m}) = 'course' AND regexp_matches(lower({_s}_req), 'placement|assessment|accuplacer|language proficiency')))")]


@query("qa01_validate_rows", "v_canonical", sql=" UNION ALL ".join(f"SELECT row_id, '{r}' AS rule FROM v_canonical WHERE {t}" for r, t in _RULES))
def qa01(df: DataFrame) -> DataFrame:
    return Q.validate_rows(df).select("row_id", "rule")


@query("qa02_validate_table", "v_canonical", sql=f"SELECT count(*) AS n, avg(({NS('program_url')} = '')::INT) AS missing_url, avg(({NS('program_url')} = '')::INT) > 0.05 AS failed FROM v_canonical")
def qa02(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.avg((T.norm_space("program_url") == "").cast("int")).alias("missing_url")).withColumn("failed", F.col("missing_url") > 0.05)


_noavg = f"({BLANKISH('min_avg_final')} AND {BLANKISH('avg_total')})"
_signal = "(" + " OR ".join(f"NOT {BLANKISH(c)}" for c in ("min_avg_final", "competitive_final", "avg_total", "english_req", "math_req", "social_req", "science_req", "elective_qty", "requirement_type", "hs_diploma_req")) + ")"
_st = lambda p: f"starts_with({_low}, '{p}')"
_REASONS = [
    ("empty_shell", f"{NS('credential_type')} IN ('Degree', 'Diploma', 'Certificate') AND {HTTP('program_url')} AND {BLANKISH('requirement_type')} AND NOT {_signal}"), ("unknown_requirement_type", f"{HTTP('program_url')} AND {BLANKISH('requirement_type')} AND {_signal}"),
    ("missing_subject_requirements", f"{_st('alberta_high_school_courses')} AND NOT {_subjects} AND NOT {_noavg}"),
    ("placement_review", f"(lower(math_assessment_flag) = 'yes' OR {_st('placement_assessment')}) AND (NOT {_subjects} OR ({BLANKISH('min_avg_final')} AND {BLANKISH('english_req')} AND {BLANKISH('math_req')}))"),
    ("placement_avg_total_conflict", f"{_st('placement_assessment')} AND NOT {BLANKISH('avg_total')}"), ("avg_total_suspicious", f"{_num('avg_total')} > 5"), ("avg_total_without_min", f"{_st('alberta_high_school_courses')} AND NOT {BLANKISH('avg_total')} AND {BLANKISH('min_avg_final')}"),
    ("course_average_context", f"{_st('course_min_only')} AND {_subjects} AND {_noavg}"), ("post_secondary_mixed_signal", f"{_st('post_secondary_pathway')} AND {_subjects}"),
]


@query("qa04_review_queue", "v_canonical", sql=f"SELECT * FROM (SELECT row_id, concat_ws('|', {', '.join(f'CASE WHEN {t} THEN {_text(c)} END' for c, t in sorted(_REASONS))}) AS reason_codes FROM v_canonical) WHERE reason_codes <> ''")
def qa04(df: DataFrame) -> DataFrame:
    return Q.review_queue(df)


@query("ag13_review_summary", "v_canonical", sql=" UNION ALL ".join(f"SELECT '{c}' AS reason_code, count(*) AS n FROM v_canonical WHERE {t} HAVING count(*) > 0" for c, t in _REASONS))
def ag13_review(df: DataFrame) -> DataFrame:
    return Q.review_queue(df).select(F.explode(F.split("reason_codes", r"\|")).alias("reason_code")).groupBy("reason_code").agg(F.count("*").alias("n"))


_c = lambda s: f"({MODE(s, f'{s}_req', f'{s}_requirement_mode')} = 'course' AND {NS(f'{s}_req')} <> '')"
_sub2 = f"({_c('english')} OR {_c('math')} OR " + " OR ".join(f"{NS(c)} <> ''" for c in ("social_req", "science_req", "min_avg_final", "elective_qty")) + ")"
_avg2 = f"({NS('min_avg_final')} <> '' OR {NS('avg_total')} <> '')"
_tok = f"CASE WHEN NOT {_avg2} AND ({NS('english_min')} <> '' OR {NS('math_min')} <> '') THEN 'course_min_only' ELSE 'alberta_high_school_courses' END"


@query(
    "mg03_requirement_type", "v_canonical",
    sql=f"""WITH t AS (SELECT *, {_t} AS x, lower({_t}) AS l, {_sub2} AS sub, {_sub2} OR {_avg2} AS ac, lower(math_assessment_flag) = 'yes' AS ma, {_tok} AS tok FROM v_canonical),
      s AS (SELECT *, CASE WHEN strpos(l, '; notes:') > 0 THEN substr(x, strpos(l, '; notes:')) ELSE '' END AS suf FROM t)
      SELECT row_id, CASE WHEN x = '' OR l = 'unknown' THEN CASE WHEN ma AND NOT ac THEN 'placement_assessment' WHEN sub THEN tok ELSE x END
        WHEN ma AND NOT starts_with(l, 'placement_assessment') THEN CASE WHEN ac THEN concat(tok, suf) ELSE concat('placement_assessment', suf) END WHEN ac AND starts_with(l, 'placement_assessment') THEN concat(tok, suf)
        WHEN regexp_matches(l, '^(alberta_high_school_courses|course_min_only|placement_assessment|post_secondary_pathway|regular_admission|first_year_admission)(;|$)') THEN x
        WHEN regexp_matches(l, 'placement|assessment|accuplacer|casper') THEN CASE WHEN ac THEN concat('alberta_high_school_courses; notes: ', x) ELSE concat('placement_assessment; notes: ', x) END
        WHEN contains(l, 'regular admission') THEN concat('regular_admission; notes: ', x) WHEN sub OR regexp_matches(l, 'see degree|refer to degree|group [abcd]|english 30') THEN concat('alberta_high_school_courses; notes: ', x) ELSE x END AS requirement_type FROM s""",
)
def mg03(df: DataFrame) -> DataFrame:
    return df.select("row_id", Q.normalise_requirement_type(df).alias("requirement_type"))


_acad = f"({_c('english')} OR {_c('math')} OR {NS('social_req')} <> '' OR {NS('science_req')} <> '' OR regexp_matches({_low}, '^(alberta_high_school_courses|course_min_only)'))"


@query(
    "mg08_display_flag", "v_canonical",
    sql=f"""SELECT row_id, CASE WHEN lower(hs_diploma_req) = 'no' OR {_st('post_secondary_pathway')} OR (lower({NS('credential_type')}) = 'other' AND NOT {_acad}) OR (NOT {_acad} AND ({_avg2} OR lower(english_requirement_mode) = 'elp' OR lower(math_requirement_mode) IN ('placement_assessment', 'other_gate') OR {_st('placement_assessment')})) THEN 'No' ELSE 'Yes' END AS display FROM v_canonical""",
)
def mg08(df: DataFrame) -> DataFrame:
    return df.select("row_id", Q.display_flag().alias("display"))


@query("qa06_average_rules_todo", "v_canonical", sql=f"SELECT DISTINCT institution, program FROM v_canonical WHERE {NS('min_avg_final')} <> '' AND {NS('avg_total')} = ''")
def qa06(df: DataFrame) -> DataFrame:
    return df.filter((T.norm_space("min_avg_final") != "") & (T.norm_space("avg_total") == "")).select("institution", "program").distinct()


@query("st03_stamps", "v_requests", sql="SELECT seq, sha256(concat_ws('|', identity::VARCHAR, event_type, payload)) AS stamp FROM v_requests")
def st03(df: DataFrame) -> DataFrame:
    return df.select("seq", F.sha2(F.concat_ws("|", F.col("identity").cast("string"), "event_type", "payload"), 256).alias("stamp"))


@query("io11_snapshot_metadata", "v_canonical", sql=f"SELECT institution, count(*) AS n, count(*) FILTER (WHERE display_for_high_school <> 'No') AS visible, count(*) FILTER (WHERE {HTTP('program_url')}) AS with_url FROM v_canonical GROUP BY 1")
def io11(df: DataFrame) -> DataFrame:
    return df.groupBy("institution").agg(F.count("*").alias("n"), F.count_if(F.col("display_for_high_school") != "No").alias("visible"), F.count_if(T.is_http_url("program_url")).alias("with_url"))
