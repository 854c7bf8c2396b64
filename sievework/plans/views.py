"""Domain-shaped views of the given tables, in SQL that Spark and DuckDB read alike: {table} stands for a table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_INST = "CASE p_partkey % 5 WHEN 0 THEN 'North' WHEN 1 THEN 'South' WHEN 2 THEN 'East' WHEN 3 THEN 'West' ELSE 'Central' END"
_COURSES = "English 30-1,English 30-2,Math 30-1,Math 30-2,Math 31,Biology 30,Chem 30,Physics 30,Science 30,Social 30-1,Art 30,English 20-1".split(",")
_COURSE = "CASE o_orderkey % 12 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_COURSES)) + " END"

VIEWS = {
    "v_index": f"""SELECT p_partkey AS seq, {_INST} AS institution,
      CASE WHEN p_partkey % 41 = 7 THEN '' WHEN p_partkey % 17 = 2 THEN 'How to apply'
           WHEN p_partkey % 11 = 3 THEN concat('  ', upper(p_name), '  &  ', p_type) WHEN p_partkey % 13 = 5 THEN concat(p_name, ' (', lower(p_type), ') Diploma')
           WHEN p_partkey % 7 = 1 THEN concat('Bachelor of ', p_name, ' ', p_brand) ELSE concat(p_name, ' ', p_type, ' ', p_brand) END AS program_name,
      CASE p_size % 5 WHEN 0 THEN 'Degree' WHEN 1 THEN 'Diploma' WHEN 2 THEN 'Certificate' WHEN 3 THEN 'Other' ELSE 'null' END AS credential,
      CASE WHEN p_partkey % 29 = 4 THEN '' WHEN p_partkey % 19 = 6 THEN concat('https://www.school.example.org/news/', CAST(p_partkey AS STRING))
           WHEN p_partkey % 5 = 2 THEN concat('https://School.example.org/Programs/', CAST(p_partkey % 900 AS STRING), '/#top')
           WHEN p_partkey % 31 = 9 THEN 'mailto:info@school.example.org' ELSE concat('https://school.example.org/programs/', CAST(p_partkey % 900 AS STRING), '/') END AS source_url,
      CASE WHEN p_partkey % 23 = 9 THEN 'Listing only: not a program ' WHEN p_partkey % 23 = 10 THEN 'checked' ELSE '' END AS notes
      FROM {{part}}""",
    "v_seed": f"""SELECT p_partkey AS seq, {_INST} AS institution, concat(p_name, ' ', p_type, ' ', p_brand) AS program_name,
      CASE p_size % 3 WHEN 0 THEN 'Degree' WHEN 1 THEN 'Diploma' ELSE 'Certificate' END AS credential,
      concat('https://school.example.org/programs/', CAST(p_partkey % 900 AS STRING)) AS source_url FROM {{part}} WHERE p_partkey % 3 = 0""",
    "v_overrides": """SELECT s_suppkey AS seq, CASE s_suppkey % 5 WHEN 0 THEN 'North' WHEN 1 THEN 'South' WHEN 2 THEN 'East' WHEN 3 THEN 'West' ELSE 'Central' END AS institution,
      CASE WHEN s_suppkey % 6 = 0 THEN 'How to apply' ELSE concat('Bachelor of red ring Brand#', CAST(s_suppkey % 25 AS STRING)) END AS program,
      CASE s_suppkey % 3 WHEN 0 THEN 'include' WHEN 1 THEN 'exclude' ELSE '' END AS include_or_exclude,
      CASE s_suppkey % 4 WHEN 3 THEN 'Archived' WHEN 2 THEN '' ELSE 'active' END AS status,
      CASE WHEN s_suppkey % 2 = 0 THEN concat('https://school.example.org/programs/', CAST(s_suppkey AS STRING), '/') ELSE '' END AS source_page_url,
      CASE WHEN s_suppkey % 5 = 0 THEN concat('https://school.example.org/parents/', CAST(s_suppkey AS STRING), '#x') ELSE '' END AS parent_admissions_url,
      CASE WHEN s_suppkey % 7 = 0 THEN 'reviewed' ELSE '' END AS notes FROM {supplier}""",
    "v_marks": f"""SELECT o_orderkey AS seq, o_custkey AS student_id, {_COURSE} AS course,
      CAST(40 + CAST(floor(o_totalprice) AS BIGINT) % 61 AS DOUBLE) AS mark, o_orderdate AS taken FROM {{orders}}""",
    "v_canonical": f"""SELECT p_partkey AS row_id, {_INST} AS institution, concat(p_name, CASE WHEN p_partkey % 9 < 3 THEN '' ELSE concat(' ', p_brand) END) AS program,
      CASE p_size % 5 WHEN 0 THEN 'Degree' WHEN 1 THEN 'Diploma' WHEN 2 THEN 'Certificate' WHEN 3 THEN 'Other' ELSE 'unknown' END AS credential_type,
      CASE WHEN p_partkey % 37 = 0 THEN 'closed' ELSE 'Active' END AS status,
      CASE WHEN p_partkey % 16 = 3 THEN '' WHEN p_partkey % 43 = 1 THEN 'ftp://old.example.org' ELSE concat('https://school.example.org/programs/', CAST(p_partkey % 900 AS STRING)) END AS program_url,
      CASE WHEN p_partkey % 3 = 0 THEN CAST(50 + p_size AS STRING) WHEN p_partkey % 53 = 1 THEN '6O' WHEN p_partkey % 59 = 1 THEN '120' ELSE '' END AS min_avg_final,
      CASE WHEN p_partkey % 21 = 0 THEN 'Entrance Requirements: see page' WHEN p_partkey % 22 = 0 THEN 'high 70s' ELSE '' END AS competitive_final,
      CASE WHEN p_partkey % 4 = 1 THEN '5' WHEN p_partkey % 61 = 3 THEN '6' WHEN p_partkey % 67 = 4 THEN '0' ELSE '' END AS avg_total,
      CASE p_partkey % 7 WHEN 0 THEN '30-1' WHEN 1 THEN 'ELA 30-1 / 30-2' WHEN 2 THEN 'English language proficiency' WHEN 3 THEN '30-1 or 30-2' WHEN 4 THEN '' WHEN 5 THEN 'English Language Arts 30-1' ELSE 'Placement test' END AS english_req,
      CASE p_partkey % 8 WHEN 0 THEN 'course' WHEN 1 THEN 'elp' WHEN 2 THEN 'bogus' ELSE '' END AS english_requirement_mode,
      CASE p_partkey % 6 WHEN 0 THEN 'Mathematics 30-1 and Mathematics 31' WHEN 1 THEN '30-2' WHEN 2 THEN '' WHEN 3 THEN 'Accuplacer' WHEN 4 THEN 'Math 30-1 or Math 30-2' ELSE '31' END AS math_req,
      CASE p_partkey % 10 WHEN 0 THEN 'course' WHEN 1 THEN 'placement_assessment' ELSE '' END AS math_requirement_mode,
      CASE p_partkey % 11 WHEN 0 THEN 'Social Studies 30-1' WHEN 1 THEN 'nan' ELSE '' END AS social_req,
      CASE p_partkey % 5 WHEN 0 THEN 'Biology 30 and Chemistry 30' WHEN 1 THEN 'Two of Biology 30, Chemistry 30, Physics 30' WHEN 2 THEN 'Science 30 or Physics 30' ELSE '' END AS science_req,
      CASE p_partkey % 6 WHEN 0 THEN 'Two' WHEN 1 THEN '1' WHEN 2 THEN 'See Degree' ELSE '' END AS elective_qty,
      CASE p_partkey % 4 WHEN 0 THEN 'Group A, C' WHEN 1 THEN 'B' ELSE '' END AS elective_pool,
      CASE p_partkey % 9 WHEN 0 THEN 'alberta_high_school_courses; notes: max 1 Group B' WHEN 1 THEN 'placement_assessment' WHEN 2 THEN 'post_secondary_pathway' WHEN 3 THEN 'Unknown' WHEN 4 THEN 'regular admission' WHEN 5 THEN 'course_min_only' WHEN 6 THEN 'Accuplacer test' ELSE '' END AS requirement_type,
      CASE p_partkey % 13 WHEN 0 THEN 'No' ELSE 'Yes' END AS hs_diploma_req, CASE p_partkey % 10 WHEN 3 THEN 'Yes' ELSE 'No' END AS math_assessment_flag,
      CASE WHEN p_partkey % 47 = 0 THEN 'maybe' WHEN p_partkey % 6 = 5 THEN 'No' ELSE 'Yes' END AS display_for_high_school,
      CASE WHEN p_partkey % 5 = 0 THEN CAST(50 + p_size % 30 AS STRING) ELSE '' END AS english_min, CASE WHEN p_partkey % 10 = 0 THEN '65' ELSE '' END AS math_min FROM {{part}}""",
    "v_candidate": f"""SELECT p_partkey + 1 AS cand_id, {_INST} AS institution, concat(p_name, CASE WHEN p_partkey % 9 < 3 THEN '' ELSE concat(' ', upper(p_brand)) END) AS program,
      CASE p_size % 5 WHEN 0 THEN 'Degree' WHEN 1 THEN 'Diploma' WHEN 2 THEN 'Certificate' WHEN 3 THEN 'Other' ELSE 'unknown' END AS credential_type,
      CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('https://school.example.org/programs/', CAST(p_partkey % 900 AS STRING), '/') END AS program_url,
      CASE WHEN p_partkey % 3 = 0 THEN CAST(50 + p_size + p_partkey % 2 AS STRING) ELSE '' END AS min_avg_final,
      CASE WHEN p_partkey % 2 = 0 THEN '5' ELSE '' END AS avg_total, CASE p_partkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence
      FROM {{part}} WHERE p_partkey % 8 <> 5""",
    "v_docs": """SELECT doc_id, CAST(floor(doc_id / 3) AS BIGINT) AS program_id, CAST(doc_id % 3 AS INT) AS doc_seq,
      CASE doc_id % 5 WHEN 0 THEN 'https://school.example.org/admissions/how-to-apply' WHEN 1 THEN 'https://school.example.org/programs-and-courses/' ELSE concat('https://school.example.org/programs/', CAST(doc_id AS STRING)) END AS url,
      concat(text, ' ', CASE doc_id % 12 WHEN 0 THEN 'Applicants must present a minimum overall average of 65% and English 30-1 or 30-2.'
        WHEN 1 THEN 'Admission average of five courses. Mathematics 30-1 with 70 percent is required.' WHEN 2 THEN 'Two subjects from Group A, B and C; maximum of one Group B.'
        WHEN 3 THEN 'The competitive admission average is in the high 70s this year.' WHEN 4 THEN 'Biology 30, Chemistry 30 and Physics 30 at 60%.' WHEN 5 THEN 'Applicants must submit a portfolio. CASPer is required for admission.'
        WHEN 6 THEN 'Entrance requires IELTS or TOEFL test scores for English language proficiency.' WHEN 7 THEN 'Academic requirements may be met with Accuplacer placement assessment in Mathematics.'
        WHEN 8 THEN '70% in Math 31; Social Studies 30-1 required; two-year diploma with minimum GPA accepted for admission.' WHEN 9 THEN 'Minimum average 150%. Three additional courses from groups B, D.'
        WHEN 10 THEN 'Based on 4 subjects. Prerequisites: lecture and lab credits.' ELSE '' END) AS text FROM {documents} WHERE text IS NOT NULL""",
    "v_rules": """SELECT doc_id, CAST(floor(doc_id / 3) AS BIGINT) AS program_id, concat(text, ' ', CASE doc_id % 16
        WHEN 0 THEN 'Notes: at most 2 Group B.' WHEN 1 THEN 'Up to one admission subject from group D may be used.' WHEN 2 THEN 'Group B maximum of two subjects; max 1 Group B' WHEN 3 THEN 'max 2 courses from option C'
        WHEN 4 THEN 'Each subject must be >= 60' WHEN 5 THEN 'Two admission subjects must be from Groups A/B' WHEN 6 THEN concat('Options C: max 1 course; up to 1 from Group D', chr(39), 's courses') WHEN 7 THEN 'Maximum two from Group B electives'
        WHEN 8 THEN 'Three admission subjects must be from group A, B or C; 1 more from groups D/A. Two admission subjects must be from groups C' WHEN 9 THEN 'Two additional admission subject from groups B or B; two additional from Group B'
        WHEN 10 THEN 'no more than 3 Group A; each subject must be >55 and Option D max 0' WHEN 11 THEN 'minimum mark of 60% in each; two groups A' WHEN 12 THEN 'Groups A, B, C and D' WHEN 13 THEN 'OPTION B electives - AT  MOST THREE' ELSE '' END) AS text FROM {documents} WHERE text IS NOT NULL""",
    "v_adapted": """SELECT doc_id, CAST(floor(doc_id / 3) AS BIGINT) AS program_id, CAST(doc_id % 3 AS INT) AS doc_seq, CASE CAST(floor(doc_id / 3) AS BIGINT) % 6 WHEN 0 THEN 'NAIT' WHEN 1 THEN 'MacEwan University ' WHEN 2 THEN 'norquest' WHEN 3 THEN 'University of Alberta' WHEN 4 THEN ' nait' ELSE 'North' END AS institution,
      concat(CASE WHEN doc_id % 7 = 2 THEN 'Content is loading... average of four ' ELSE '' END, text, ' ', CASE doc_id % 13 WHEN 0 THEN 'Academic requirements: five 30-level subject. Privacy Policy Terms of Use average of four' WHEN 1 THEN 'An average calculated on FIVE.' WHEN 2 THEN 'five required Grade 12 subjects, average of four'
        WHEN 3 THEN 'Five acceptable grade 12 subjects' WHEN 4 THEN 'the average of the best five' WHEN 5 THEN 'five Grade 12 subjects and four admission subjects' WHEN 6 THEN 'The admission average is over five subjects.' WHEN 7 THEN 'Admission average is looked at; based on 3 courses'
        WHEN 8 THEN 'An admission average. Not ready to apply yet? average of 2' WHEN 9 THEN 'About the program average of 12' WHEN 10 THEN 'their five subjects' ELSE '' END) AS text FROM {documents} WHERE text IS NOT NULL""",
    "v_pages": """SELECT page_id, url, concat(html, '<a href="/admission-requirements">Admission requirements</a><a class=x href="how-to-apply?id=', CAST(page_id % 7 AS STRING), '">How to <b>apply</b></a><a href="https://other.example.io/admissions">Else</a><a href="guide.pdf">English guide</a>') AS html FROM {pages}""",
    "v_samples": """SELECT s_suppkey AS seq, CASE s_suppkey % 3 WHEN 0 THEN ' North ' WHEN 1 THEN 'South  End' ELSE '' END AS institution, concat('Red  Ring #', CAST(s_suppkey % 25 AS STRING), ' (Dip.)') AS program,
      CASE s_suppkey % 3 WHEN 0 THEN 'Diploma' ELSE ' Degree' END AS credential, CASE s_suppkey % 4 WHEN 0 THEN 'Active ' ELSE '' END AS status,
      CASE s_suppkey % 4 WHEN 0 THEN 'Include' WHEN 1 THEN 'EXCLUDE' WHEN 2 THEN 'maybe' ELSE '' END AS include_or_exclude,
      CASE s_suppkey % 5 WHEN 0 THEN 'Inheritance link' WHEN 1 THEN 'manual_review' ELSE 'Average' END AS signal_type,
      CASE s_suppkey % 7 WHEN 0 THEN 'https://school.example.org/parent/1' WHEN 1 THEN 'see page' ELSE '' END AS parent_admissions_url,
      CASE s_suppkey % 2 WHEN 0 THEN concat('https://school.example.org/programs/', CAST(s_suppkey AS STRING)) ELSE 'n/a' END AS page_url,
      CASE s_suppkey % 6 WHEN 0 THEN '65' WHEN 1 THEN '65.50' WHEN 2 THEN '70.25' WHEN 3 THEN 'high' WHEN 4 THEN '80.0' ELSE '' END AS min_avg,
      CASE s_suppkey % 5 WHEN 0 THEN 'Five (5) courses' WHEN 1 THEN '10 marks' WHEN 2 THEN '12' WHEN 3 THEN 'four' ELSE '' END AS avg_total,
      CASE s_suppkey % 3 WHEN 0 THEN 'checked' ELSE '' END AS notes, CASE s_suppkey % 4 WHEN 0 THEN 'typical  case' ELSE '' END AS why,
      CASE s_suppkey % 6 WHEN 0 THEN 'placement_assessment' ELSE '' END AS requirement_type, CASE s_suppkey % 5 WHEN 0 THEN ' Two ' ELSE '' END AS elective_qty,
      '#a .b' AS requirements_selector, '' AS links_selector, CASE s_suppkey % 9 WHEN 0 THEN ' proof  here' ELSE '' END AS proof_text FROM {supplier}""",
    "v_plans": """SELECT p_partkey AS plan_seq, p_partkey % 300 AS program_id, concat('p', CAST(p_partkey % 7 AS STRING)) AS plan_code,
      concat('s', CAST(p_partkey % 3 AS STRING)) AS sub_a, concat('S', CAST(p_partkey % 4 + 2 AS STRING)) AS sub_b, concat(p_name, ' & ', p_brand) AS name FROM {part}""",
    "v_choices": """SELECT p_partkey AS program_id, CASE WHEN p_partkey % 3 = 0 THEN concat(' P', CAST(p_partkey % 7 AS STRING)) ELSE '' END AS plan_code,
      CASE WHEN p_partkey % 2 = 0 THEN concat('S', CAST(p_partkey % 6 AS STRING)) ELSE '' END AS subplan_code, concat(p_name, ' ', p_type) AS name FROM {part} WHERE p_partkey < 300""",
    "v_cards": """SELECT page_id, url, concat(html, '<a class="card program-card-title" href="/programs/', CAST(page_id % 50 AS STRING), '">Trade &amp; <b>Craft</b> ', CAST(page_id % 20 AS STRING),
      '</a><a href="/x" class="other">No</a><a href="list/', CAST(page_id % 30 AS STRING), '"><div class="big link-title">Arts  ', CAST(page_id % 9 AS STRING), '</div></a><a class="program-card-title" href="">Blank</a>') AS html FROM {pages}""",
    "v_requests": """SELECT event_id AS seq, user_id AS identity, ts, props AS payload, event_type FROM {events}""",
}


def _run(shift: int, blanks: int, confidence: bool) -> str:
    """SQL of a run's row for each part: 15 fields, some blank, some written otherwise; with their confidences if asked."""
    names = "min_avg_final competitive_final competitive_floor_numeric avg_total english_req english_min math_req math_min social_req social_min science_req science_min elective_qty elective_pool requirement_type".split()
    word = "concat(CASE WHEN p_partkey % 11 = {i} THEN '  V ' ELSE 'v' END, CAST((p_size + p_partkey * {s}) % (9 + {i}) AS STRING))"
    fields = [f"CASE WHEN p_partkey % {blanks + i % 4} = {i % 3} THEN '' ELSE {word.format(i=i % 11, s=shift + i % 2)} END AS {n}" for i, n in enumerate(names)]
    if confidence:
        fields += [f"CASE (p_partkey + {i}) % 4 WHEN 0 THEN ' High' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE '' END AS {n}_confidence" for i, n in enumerate(names)]
    return ", ".join(fields)


_NAMED = f"{_INST} AS institution, concat(p_name, ' ', CAST(p_partkey % 40 AS STRING))"
_ADDRESS = "concat('https://school.example.org/p/', CAST(p_partkey % 300 AS STRING))"
VIEWS |= {
    "v_run_base": f"SELECT p_partkey AS seq, p_partkey AS row_no, printf('canonical_%06d', p_partkey) AS index_row_id, {_NAMED} AS program_name, {_NAMED.partition(' AS institution, ')[2]} AS program, p_brand AS credential, p_brand AS credential_type, {_ADDRESS} AS source_url, {_ADDRESS} AS program_url, {_run(1, 3, False)} FROM {{part}}",
    "v_run_cand": f"""SELECT p_partkey AS seq, CASE p_partkey % 4 WHEN 0 THEN printf('canonical_%06d', p_partkey) WHEN 1 THEN printf('Canonical_%06d', p_partkey - p_partkey % 3) WHEN 2 THEN 'canonical_x' ELSE '' END AS index_row_id, {_NAMED.replace("concat(p_name", "concat(upper(p_name)")} AS program_name,
      CASE WHEN p_partkey % 9 = 2 THEN '' ELSE p_brand END AS credential, CASE WHEN p_partkey % 5 = 1 THEN concat({_ADDRESS}, '/x') ELSE {_ADDRESS} END AS source_url, CASE WHEN p_partkey % 31 = 3 THEN 'timeout' ELSE '' END AS error, CASE p_partkey % 7 WHEN 0 THEN 'Night' WHEN 1 THEN 'day' ELSE '' END AS profile, {_run(2, 4, True)} FROM {{part}} WHERE p_partkey % 13 <> 6""",
    "v_issues": f"""SELECT p_partkey AS issue_id, CASE p_partkey % 6 WHEN 0 THEN 'irrelevant_program' WHEN 1 THEN 'Min_Average' WHEN 2 THEN 'avg_total' WHEN 3 THEN 'required_course' WHEN 4 THEN 'layout' ELSE 'competitive_guidance' END AS issue_type,
      CASE p_partkey % 5 WHEN 0 THEN 'Minimum-Average' WHEN 1 THEN 'math req' WHEN 2 THEN '' WHEN 3 THEN 'elective_pool' ELSE 'English_Req' END AS field_name, CASE WHEN p_partkey % 3 = 0 THEN printf('CANONICAL_%06d', p_partkey + p_partkey % 2) ELSE '' END AS canonical_row_id,
      {_NAMED} AS program, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand END AS credential, CASE WHEN p_partkey % 3 = 2 THEN '' ELSE {_ADDRESS} END AS program_url, CASE p_partkey % 10 WHEN 0 THEN ' ' WHEN 1 THEN 'Drop' ELSE concat('V', CAST((p_size + p_partkey * 2) % 9 AS STRING)) END AS expected_value,
      CASE p_partkey % 8 WHEN 0 THEN 'Resolved' WHEN 1 THEN 'ignore' ELSE 'open' END AS status, CASE WHEN p_partkey % 2 = 0 THEN 'Approved_Overwrite' ELSE '' END AS approval_state FROM {{part}} WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0""",
    "v_decided_base": f"SELECT p_partkey AS seq, {_NAMED} AS program_name, {_ADDRESS} AS source_url, CASE WHEN p_partkey % 3 = 0 THEN 'drop' ELSE 'keep' END AS decision, CASE WHEN p_partkey % 4 = 0 THEN 'dropped_blocked_url' WHEN p_partkey % 4 = 1 THEN 'dropped_not_in_seed' ELSE 'kept' END AS reason_code FROM {{part}}",
    "v_decided_cand": f"SELECT p_partkey AS seq, {_NAMED} AS program_name, {_ADDRESS} AS source_url, CASE WHEN p_partkey % 2 = 0 THEN 'Drop ' ELSE 'keep' END AS decision, CASE WHEN p_partkey % 4 = 0 THEN 'Dropped_Blocked_Name' WHEN p_partkey % 4 = 1 THEN 'dropped_not_in_seed' ELSE 'kept' END AS reason_code FROM {{part}}",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in re.findall(r"\{(\w+)\}", text)}
    return spark.sql(text, **tables)


def with_views(body: str, *names: str) -> str:
    """A DuckDB query over views."""
    held = [f"{n} AS ({re.sub(r'{(\w+)}', r'\1', VIEWS[n])})" for n in names]
    recursive = " RECURSIVE" if body.lstrip().upper().startswith("WITH RECURSIVE") else ""
    body = re.sub(r"^\s*WITH( RECURSIVE)?\s", ", ", body, flags=re.I)
    return f"WITH{recursive} {', '.join(held)} {body}"

_CREDENTIALS = "CASE p_size % 5 WHEN 0 THEN 'Degree' WHEN 1 THEN 'Diploma' WHEN 2 THEN 'Certificate' WHEN 3 THEN 'Other' ELSE '' END"
# Values that a structured field may find, taken in turn; '' finds none.
_FOUND = {
    "min_avg_final": ["65", "", "nan"], "competitive_final": ["high 80s", "Entrance Requirements: ask", ""], "avg_total": ["5", "", "4"], "english_req": ["ELA 30-1/30-2", "", "IELTS 6.5"], "english_requirement_mode": ["", "COURSE", "odd"], "english_min": ["60", ""],
    "math_req": ["Mathematics 30-1 or 30-2", "31", "", "Math  30-1 or 30-2"], "math_requirement_mode": ["", "elp", "other_gate"], "math_min": ["", "55"], "social_req": ["Social Studies 30-2", ""], "social_min": ["", "50"], "science_req": ["Two of Biology 30, Chemistry 30, Physics 30", "", "Biology 30, Chemistry 30 and Physics 30", "Biology 30 or Chemistry 30"],
    "science_min": ["", "50", ""], "bio_30_req": ["Yes", ""], "chem_30_req": ["", "Yes"], "phys_30_req": ["Yes", "", ""], "sci_30_req": ["", "", "Yes"], "elective_qty": ["Two", "", "1 course", "see page"], "elective_pool": ["Group A", ""],
    "requirement_type": ["Unknown", "regular_admission; notes: notes: post-secondary pathway", "see degree", "alberta_high_school_courses; notes: notes: max 1 Group B", "", "post_secondary_pathway", "Casper"], "hs_diploma_req": ["Yes", "none", "No"], "math_assessment_flag": ["Yes", "", "No", "Unknown", "None"], "elp_tests_mentioned": ["IELTS", ""],
}
_REST = "credential_type, status, program_url, min_avg_final, competitive_final, avg_total, english_req, english_requirement_mode, math_req, math_requirement_mode, social_req, science_req, elective_qty, elective_pool, requirement_type, hs_diploma_req, math_assessment_flag, display_for_high_school, english_min, math_min"
_turn = lambda n, values: f"CASE {n} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"
VIEWS |= {
    "v_table": f"""SELECT t.*, CASE row_id % 8 WHEN 0 THEN '60' ELSE '' END AS social_min, CASE row_id % 9 WHEN 2 THEN '55' ELSE '' END AS science_min, CASE row_id % 5 WHEN 0 THEN 'Yes' ELSE '' END AS bio_30_req, '' AS chem_30_req, CAST(NULL AS STRING) AS phys_30_req, '' AS sci_30_req, CASE row_id % 6 WHEN 1 THEN 'none' WHEN 2 THEN 'TOEFL' ELSE '' END AS elp_tests_mentioned
      FROM ({VIEWS["v_canonical"]} UNION ALL SELECT row_id + 1000000000, institution, upper(program), {_REST} FROM ({VIEWS["v_canonical"]}) WHERE row_id % 10 = 4) t""",
    "v_found": f"SELECT p_partkey + 1 AS cand_id, {_INST} AS institution, concat(p_name, CASE WHEN p_partkey % 9 < 3 THEN '' ELSE concat(' ', upper(p_brand)) END) AS program, {_CREDENTIALS} AS credential_type, CASE WHEN p_partkey % 4 = 0 THEN concat('https://school.example.org/programs/', CAST(p_partkey % 900 AS STRING), '/') ELSE '' END AS program_url, "
    + ", ".join(f"{_turn(f'(p_partkey + p_size * {i % 3 + 1})', v)} AS {f}, {_turn(f'(p_partkey + {i})', ['high', ' Medium', 'low', 'none'])} AS {f}_confidence" for i, (f, v) in enumerate(_FOUND.items())) + " FROM {part} WHERE p_partkey % 8 <> 5",
    "v_program_overrides": f"""SELECT p_partkey AS seq, {_INST} AS institution, CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat('The ', p_name, ' ', p_brand) WHEN 2 THEN 'How to apply' WHEN 3 THEN concat(p_name, ' ', p_brand, ' (evening)') ELSE concat(p_name, ' ', p_brand) END AS program,
      CASE p_size % 7 WHEN 0 THEN 'Degree' WHEN 1 THEN 'diploma' WHEN 2 THEN {_CREDENTIALS} WHEN 3 THEN {_CREDENTIALS} ELSE '' END AS credential_type, CASE p_partkey % 13 WHEN 1 THEN 'Archived' WHEN 2 THEN '' ELSE 'active' END AS status, CASE p_partkey % 11 WHEN 3 THEN 'Exclude' WHEN 4 THEN 'include' ELSE '' END AS include_or_exclude,
      CASE WHEN p_partkey % 4 = 1 THEN concat('https://school.example.org/programs/', CAST(p_partkey % 60 AS STRING), '/') WHEN p_partkey % 4 = 2 THEN 'see page' ELSE '' END AS source_page_url, CASE WHEN p_partkey % 6 = 1 THEN concat('https://school.example.org/programs/', CAST(p_partkey % 45 AS STRING), '#top') ELSE '' END AS parent_admissions_url,
      {_turn("p_partkey", ["", "placement_assessment", "", "course_min_only"])} AS requirement_type_override, {_turn("p_partkey", ["77", "", ""])} AS min_avg_override, {_turn("p_partkey", ["", " 3 "])} AS elective_qty_override, {_turn("p_partkey", ["", "", "4"])} AS avg_total_override FROM {{part}} WHERE p_partkey % 3 <> 0""",
    "v_rulesets": """SELECT n_nationkey AS seq, CASE n_nationkey % 4 WHEN 0 THEN ' north' WHEN 1 THEN 'SOUTH' WHEN 2 THEN 'East' ELSE 'West' END AS institution, concat(CASE WHEN n_nationkey % 2 = 0 THEN 'R' ELSE 'r' END, CAST((n_nationkey * 7) % 25 AS STRING)) AS ruleset_key,
      CASE n_nationkey % 5 WHEN 0 THEN 'Degree | Diploma' WHEN 1 THEN 'any' WHEN 2 THEN 'certificate;other' WHEN 3 THEN '' ELSE 'degree' END AS credential_scope, CASE n_nationkey % 3 WHEN 0 THEN 'Alberta_High_School_Courses' WHEN 1 THEN '' ELSE 'placement' END AS requirement_type_pattern,
      CASE n_nationkey % 6 WHEN 0 THEN '5' WHEN 1 THEN '' WHEN 2 THEN 'x' WHEN 3 THEN '4.0' WHEN 4 THEN '5' ELSE '0' END AS default_avg_total, CASE n_nationkey % 7 WHEN 1 THEN 'Yes' WHEN 2 THEN 'true' ELSE 'no' END AS placement_required FROM {nation}""",
}
VIEWS["v_review"] = f"""SELECT row_id, CASE institution WHEN 'West' THEN 'UAlberta ' WHEN 'South' THEN 'NorQuest' ELSE institution END AS institution, program, CASE WHEN row_id % 7 = 2 THEN 'Nan' ELSE credential_type END AS credential_type, CASE WHEN row_id % 6 = 1 THEN ' ' ELSE status END AS status,
  CASE row_id % 11 WHEN 1 THEN 'See  Degree requirements' WHEN 2 THEN 'regular admission; notes: x' WHEN 3 THEN 'alberta_high_school_courses; notes: notes: y; casper required' WHEN 4 THEN 'Refer to Program' WHEN 5 THEN 'Notes: portfolio required' WHEN 6 THEN 'alberta_high_school_courses; Casper Required' ELSE requirement_type END AS requirement_type,
  CASE row_id % 9 WHEN 1 THEN 'maybe' WHEN 2 THEN 'N' WHEN 3 THEN '' ELSE math_assessment_flag END AS math_assessment_flag, program_url, min_avg_final, competitive_final, avg_total, english_req, english_requirement_mode, CASE WHEN institution = 'East' THEN '' ELSE math_req END AS math_req, math_requirement_mode, social_req, science_req, elective_qty, hs_diploma_req,
  display_for_high_school, english_min, math_min FROM ({VIEWS["v_canonical"]} UNION ALL SELECT * FROM ({VIEWS["v_canonical"]}) WHERE row_id % 20 < 3)"""
