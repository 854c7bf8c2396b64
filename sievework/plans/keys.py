"""Queries of the normalisers and keys (PR)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.plans.registry import query

# SQL twins of the column functions, for the oracles.
NS = lambda c: f"trim(regexp_replace(coalesce({c}::VARCHAR, ''), '\\s+', ' ', 'g'))"
NB = lambda c: f"CASE WHEN lower({NS(c)}) IN ('nan', 'none', 'null') THEN '' ELSE {NS(c)} END"
NK = lambda c: f"trim(regexp_replace(replace(replace(lower({NS(c)}), '&amp;', ' and '), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
UK = lambda c, frag=True, end="/$": (
    f"regexp_replace({f'regexp_replace(lower({NS(c)}), {chr(39)}#.*${chr(39)}, {chr(39)*2})' if frag else f'lower({NS(c)})'}, '{end}', '')"
)
FOLD = lambda *cs: "concat_ws('||', " + ", ".join(f"lower({NS(c)})" for c in cs) + ")"
WORDS = "['one','two','three','four','five','six','seven','eight','nine','ten']"
BLANKISH = lambda c: f"lower({NS(c)}) IN ('', 'nan', 'none', 'null', 'unknown')"
HTTP = lambda c: f"regexp_matches({NS(c)}, '^(?i:https?)://')"


@query("pr01_norm_space", "v_index", sql=f"SELECT seq, {NS('program_name')} AS name, {NB('credential')} AS credential FROM v_index")
def pr01(df: DataFrame) -> DataFrame:
    return df.select("seq", T.norm_space("program_name").alias("name"), T.norm_or_blank("credential").alias("credential"))


@query("pr02_name_key", "v_index", sql=f"SELECT seq, {NK('program_name')} AS name_key FROM v_index")
def pr02(df: DataFrame) -> DataFrame:
    return df.select("seq", T.name_key("program_name").alias("name_key"))


@query("pr03_url_key", "v_index", sql=f"SELECT seq, {UK('source_url')} AS one, {UK('source_url', end='/+$')} AS every, {UK('source_url', False, '/+$')} AS kept FROM v_index")
def pr03(df: DataFrame) -> DataFrame:
    return df.select("seq", T.url_key("source_url").alias("one"), T.url_key("source_url", slashes="all").alias("every"), T.url_key("source_url", False, "all").alias("kept"))


TOKENS = lambda c: (
    f"list_sort(list_distinct(list_filter(string_split({NS(f'''regexp_replace(regexp_replace(regexp_replace(lower({NS(c)}), '\\(.*?\\)', ' ', 'g'), '[‐-―]', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g')''')}, ' '), lambda x: x <> '')))"
)


@query("pr04_program_tokens", "v_index", sql=f"SELECT seq, array_to_string({TOKENS('program_name')}, ' ') AS tokens FROM v_index")
def pr04(df: DataFrame) -> DataFrame:
    return df.select("seq", F.array_join(T.program_tokens("program_name"), " ").alias("tokens"))


@query(
    "pr05_composite_keys", "v_index",
    sql=f"""SELECT seq, {FOLD('institution', 'program_name', 'source_url')} AS evidence_key,
        CASE WHEN lower({NS('institution')}) = '' OR {NK('program_name')} = '' THEN '' ELSE concat_ws('||', lower({NS('institution')}), {NK('program_name')}, lower({NS('credential')})) END AS override_key FROM v_index""",
)
def pr05(df: DataFrame) -> DataFrame:
    return df.select("seq", T.folded_key("institution", "program_name", "source_url").alias("evidence_key"), T.override_key("institution", "program_name", "credential").alias("override_key"))


SLUG = lambda c, sep: f"substr(regexp_replace(regexp_replace(lower(trim({c})), '[^a-z0-9]+', '{sep}', 'g'), '^{sep}+|{sep}+$', '', 'g'), 1, 60)"


@query(
    "pr06_program_id", "v_index",
    sql=f"""SELECT seq, concat(regexp_replace({SLUG("concat(institution, '-', program_name)", '-')}, '-+$', ''), '-',
        substr(sha1(concat(seq::VARCHAR, '::', institution, '::', program_name, '::', source_url)), 1, 12)) AS program_id FROM v_index""",
)
def pr06(df: DataFrame) -> DataFrame:
    return df.select("seq", T.program_id("seq", "institution", "program_name", "source_url").alias("program_id"))


@query(
    "pr07_program_key", "v_index",
    sql=f"""WITH k AS (SELECT seq, concat(array_to_string(list_filter([{SLUG('institution', '_')}, {SLUG('program_name', '_')}, {SLUG('credential', '_')}], lambda x: x <> ''), '__'), '_',
        substr(lower(rtrim(translate(base64(unhex(sha256(concat_ws('||', institution, program_name, credential, concat_ws('|', trim(institution), trim(program_name), trim(credential), trim(source_url)))))), '+/=', '-_'), '=')), 1, 12)) AS base FROM v_index),
      n AS (SELECT seq, base, row_number() OVER (PARTITION BY base ORDER BY seq) AS n FROM k)
      SELECT seq, CASE WHEN n = 1 THEN base ELSE concat(base, '_', n) END AS program_key FROM n""",
)
def pr07(df: DataFrame) -> DataFrame:
    base = T.program_key_base("institution", "program_name", "credential", ["institution", "program_name", "credential", "source_url"])
    n = F.row_number().over(Window.partitionBy("base").orderBy("seq"))
    keyed = df.select("seq", base.alias("base")).withColumn("n", n)
    return keyed.select("seq", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", "n")).alias("program_key"))


@query("pr08_explorer_key", "v_index", sql=f"SELECT seq, concat({SLUG('institution', '_')}, '__', {SLUG('program_name', '_')}, '_r', seq + 2) AS explorer_key FROM v_index WHERE trim(program_name) <> ''")
def pr08(df: DataFrame) -> DataFrame:
    """The row number is the stored input position: rows of a table have no other order."""
    key = F.concat(T.slug(F.col("institution"), "_"), F.lit("__"), T.slug(F.col("program_name"), "_"), F.lit("_r"), F.col("seq") + 2)
    return df.filter(F.trim("program_name") != "").select("seq", key.alias("explorer_key"))


_host = "lower(regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"


@query(
    "pr09_urls", "v_index",
    sql=f"""WITH h AS (SELECT seq, source_url, {HTTP('source_url')} AS http, {_host} AS host FROM v_index)
      SELECT seq, http, host, array_to_string(list_filter(string_split(host, '.'), lambda x: x <> '')[-2:], '.') AS root,
      host <> '' AND (host = 'school.example.org' OR host LIKE '%.school.example.org' OR 'school.example.org' LIKE concat('%.', host) OR array_to_string(list_filter(string_split(host, '.'), lambda x: x <> '')[-2:], '.') = 'example.org') AS same_site,
      concat('https://school.example.org', '/apply/', seq) AS resolved FROM h""",
)
def pr09(df: DataFrame) -> DataFrame:
    host = T.url_host("source_url")
    resolved = T.resolve_url(F.lit("https://school.example.org/programs/1?x=1"), F.concat(F.lit("/apply/"), F.col("seq")))
    return df.select("seq", T.is_http_url("source_url").alias("http"), host.alias("host"), T.root_domain(host).alias("root"), T.is_same_site(host, F.lit("school.example.org")).alias("same_site"), resolved.alias("resolved"))


@query("pr10_should_skip_url", "v_index", sql=f"SELECT seq, lower({NS('source_url')}) = '' OR regexp_matches(lower({NS('source_url')}), '^(mailto:|tel:|javascript:)') OR regexp_matches(lower({NS('source_url')}), '\\.(pdf|jpg|jpeg|png|gif|svg|zip|docx?|xlsx?)$') AS skip FROM v_index")
def pr10(df: DataFrame) -> DataFrame:
    return df.select("seq", T.should_skip_url("source_url").alias("skip"))


@query(
    "pr11_count_token", "v_canonical",
    sql=f"""WITH t AS (SELECT row_id, lower({NS('elective_qty')}) AS q, {NS('science_req')} AS s FROM v_canonical),
      w AS (SELECT *, lower(regexp_extract(s, '(?i)\\b(one|two|three|four|five|six|seven|eight|nine|ten|[0-9]+)\\b', 1)) AS f FROM t)
      SELECT row_id, CASE WHEN coalesce(list_position({WORDS}, q), try_cast(q AS INTEGER)) BETWEEN 1 AND 10 THEN coalesce(nullif(list_position({WORDS}, q), 0), try_cast(q AS INTEGER))::INTEGER END AS strict,
        CASE WHEN coalesce(nullif(list_position({WORDS}, f), 0), try_cast(f AS INTEGER)) BETWEEN 1 AND 10 THEN coalesce(nullif(list_position({WORDS}, f), 0), try_cast(f AS INTEGER))::INTEGER END AS within,
        coalesce(try_cast(regexp_extract(q, '\\b([0-9]+)\\b', 1) AS INTEGER), nullif(list_position({WORDS}, q), 0), 0)::INTEGER AS any_count FROM w""",
)
def pr11(df: DataFrame) -> DataFrame:
    return df.select("row_id", T.count_strict("elective_qty").alias("strict"), T.count_within("science_req").alias("within"), T.count_any("elective_qty").alias("any_count"))


@query("pr12_to_number", "v_canonical", sql=f"SELECT row_id, CASE WHEN regexp_matches(trim(min_avg_final), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN trim(min_avg_final)::DOUBLE END AS number, greatest(0.0, least(100.0, CASE WHEN regexp_matches(trim(min_avg_final), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN trim(min_avg_final)::DOUBLE END)) * CASE WHEN regexp_matches(trim(min_avg_final), '^[0-9]+$') THEN 1.0::DOUBLE END AS mark FROM v_canonical")
def pr12(df: DataFrame) -> DataFrame:
    return df.select("row_id", T.to_number("min_avg_final").alias("number"), T.clamp_mark("min_avg_final").alias("mark"))


@query(
    "pr13_dates", "v_marks",
    sql="""SELECT seq, strftime(taken, '%Y-%m-%d') AS iso, concat(strftime(taken, '%Y'), '-', strftime(taken, '%m'), '-', strftime(taken, '%d')) AS mdy,
      greatest(0, date_diff('day', taken::DATE, DATE '2000-01-01'))::INTEGER AS age FROM v_marks""",
)
def pr13(df: DataFrame) -> DataFrame:
    iso = T.to_ymd(F.date_format("taken", "yyyy-MM-dd HH:mm:ss"))
    return df.select("seq", iso.alias("iso"), T.to_ymd(F.date_format("taken", "M/d/yyyy")).alias("mdy"), T.age_days(iso, F.lit("2000-01-01").cast("date")).alias("age"))


@query(
    "pr14_flags", "v_overrides",
    sql=f"""SELECT seq, lower({NS('status')}) NOT IN ('inactive', 'disabled', 'archived', 'off', 'no', 'false', '0') AS active,
      CASE WHEN lower({NS('notes')}) IN ('yes', 'y', 'true', '1', 'required') THEN true WHEN lower({NS('notes')}) IN ('no', 'n', 'false', '0', 'not_required') THEN false ELSE true END AS flag, {BLANKISH('status')} AS blankish FROM v_overrides""",
)
def pr14(df: DataFrame) -> DataFrame:
    return df.select("seq", T.is_active_status("status").alias("active"), T.truthy("notes", True).alias("flag"), T.is_blankish("status").alias("blankish"))


@query(
    "pr15_credential_class", "v_index",
    sql=f"""WITH t AS (SELECT seq, lower({NB('program_name')}) AS n, lower(source_url) AS u FROM v_index)
      SELECT seq, CASE WHEN contains(u, '/apprenticeship/') OR contains(n, 'apprentice') THEN 'Apprenticeship' WHEN contains(n, 'bachelor') THEN 'Degree' WHEN contains(n, 'diploma') THEN 'Diploma' WHEN contains(n, 'certificate') THEN 'Certificate' WHEN contains(n, 'upgrading') THEN 'Course credits' ELSE 'Other' END AS by_index,
      CASE WHEN contains(n, 'diploma') THEN 'Diploma' WHEN contains(n, 'certificate') THEN 'Certificate' WHEN regexp_matches(n, 'degree|bachelor|major|honours') THEN 'Degree' ELSE 'Other' END AS by_seed FROM t""",
)
def pr15(df: DataFrame) -> DataFrame:
    return df.select("seq", T.credential_class("program_name", "source_url").alias("by_index"), T.credential_class("program_name", variant="seed").alias("by_seed"))


MODE = lambda subject, text, explicit: (
    f"CASE WHEN lower({NS(explicit)}) IN ('course', 'placement_assessment', 'elp', 'other_gate') THEN lower({NS(explicit)}) WHEN {NS(text)} = '' THEN '' WHEN regexp_matches(lower({NS(text)}), 'placement|assessment|accuplacer') THEN 'placement_assessment' "
    + (f"WHEN regexp_matches(lower({NS(text)}), 'language proficiency|ielts|toefl|duolingo|cael|pearson|pte') THEN 'elp' " if subject == "english" else "")
    + f"WHEN regexp_matches({NS(text)}, '{T._COURSE[subject]}') THEN 'course' ELSE 'other_gate' END"
)


@query("pr18_requirement_mode", "v_canonical", sql=f"SELECT row_id, {MODE('english', 'english_req', 'english_requirement_mode')} AS english_mode, {MODE('math', 'math_req', 'math_requirement_mode')} AS math_mode FROM v_canonical")
def pr18(df: DataFrame) -> DataFrame:
    return df.select("row_id", T.requirement_mode("english", "english_req", "english_requirement_mode").alias("english_mode"), T.requirement_mode("math", "math_req", "math_requirement_mode").alias("math_mode"))


def _display(subject: str, mode: str) -> str:
    name = "English" if subject == "english" else "Math"
    text = NS(f"{subject}_req")
    for pattern, to in [("(?i)\\bEnglish Language Arts\\b", "English"), ("(?i)\\bELA\\b", "English")] if subject == "english" else [("(?i)\\bMathematics\\b", "Math")]:
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    text = NS(f"regexp_replace({text}, '\\s*/\\s*', ' or ', 'g')")
    code = "((?:20|30)-[12]|31)"
    text = f"regexp_replace(regexp_replace({text}, '^{code}$', '{name} \\1'), '^(?i:{name}\\s+)?{code}\\s+or\\s+{code}$', '{name} \\1 or {name} \\2')"
    elp = f"WHEN {mode} = 'elp' THEN 'English language proficiency' " if subject == "english" else ""
    return f"CASE WHEN {mode} = 'placement_assessment' THEN 'Placement assessment' {elp}WHEN {mode} = 'course' THEN {text} ELSE {NS(f'{subject}_req')} END"


@query(
    "pr19_display_requirement", "v_canonical",
    sql=f"""WITH m AS (SELECT *, {MODE('english', 'english_req', 'english_requirement_mode')} AS em, {MODE('math', 'math_req', 'math_requirement_mode')} AS mm FROM v_canonical)
      SELECT row_id, {_display('english', 'em')} AS english, {_display('math', 'mm')} AS math FROM m""",
)
def pr19(df: DataFrame) -> DataFrame:
    show = lambda s: T.display_requirement(s, f"{s}_req", T.requirement_mode(s, f"{s}_req", f"{s}_requirement_mode"))
    return df.select("row_id", show("english").alias("english"), show("math").alias("math"))


_bad = "contains(lower(c), 'to be considered for admission to the program') OR contains(lower(c), 'international students must qualify for admission')"


@query(
    "pr20_competitive", "v_canonical",
    sql=f"""WITH t AS (SELECT row_id, {NS('competitive_final')} AS c FROM v_canonical)
      SELECT row_id, CASE WHEN {_bad} OR starts_with(lower(c), 'nimum grades you need to achieve') OR starts_with(lower(c), 'entrance requirements:') THEN 'Competitive varies by year' ELSE c END AS clean,
      c <> '' AND lower(c) <> 'competitive varies by year' AND ({_bad} OR (len(string_split(c, ' ')) > 24 AND regexp_matches(c, '[:.]'))) AS polluted FROM t""",
)
def pr20(df: DataFrame) -> DataFrame:
    return df.select("row_id", T.clean_competitive("competitive_final").alias("clean"), T.is_competitive_polluted("competitive_final").alias("polluted"))


@query("pr21_excerpt", "v_docs", sql=f"SELECT doc_id, {NS('substr(text, 51, 100)')} AS around, CASE WHEN length({NS('text')}) <= 40 THEN {NS('text')} ELSE concat(rtrim(substr({NS('text')}, 1, 37)), '...') END AS short FROM v_docs")
def pr21(df: DataFrame) -> DataFrame:
    return df.select("doc_id", T.excerpt(F.col("text"), F.lit(80), F.lit(120), 30).alias("around"), T.shorten("text", 40).alias("short"))
