"""Queries of text and HTML extraction (X)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import adapters as A
from sievework.operators import extract as X
from sievework.operators import profile as P
from sievework.plans.keys import NS
from sievework.plans.registry import query

_t = "t AS (SELECT doc_id, program_id, doc_seq, url, " + NS("text") + " AS t FROM v_docs)"
HAS = lambda p, c="t": f"regexp_matches({c}, '(?i){p}')"
GET = lambda p, g, c="t": f"regexp_extract({c}, '(?i){p}', {g})"


def _case(options: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in options) + " END"


_avg = [(f"{HAS(p)} AND {v or f'try_cast({GET(p, 1)} AS INTEGER)'} BETWEEN 1 AND 10", v or f"try_cast({GET(p, 1)} AS INTEGER)", r) for p, v, _, r in X.AVERAGE_COUNTS]


@query("x07_average_count", "v_docs", sql=f"WITH {_t} SELECT doc_id, {_case([(a, str(b)) for a, b, _ in _avg])}::INTEGER AS value, {_case([(a, f'''{chr(39)}{c}{chr(39)}''') for a, _, c in _avg])} AS rule_id FROM t")
def x07(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", X.average_count(T.norm_space("text")).alias("a")).select("doc_id", "a.value", "a.rule_id")


_STARTS = ("Minimum entrance requirements", "High School Course Pathway", "About the program", "About the Program", "Academic requirements")
_ENDS = ("Not ready to apply yet?", "Stay connected Sign up to receive updates on NAIT programs, services, and events.", "Work at NAIT Emergency", "Contact us View Frequently Asked Questions", "Privacy Policy Terms of Use")
_ordered = [("five required grade 12 subjects?", "macewan ualberta", 5, "high", "five_required_grade12"), ("five acceptable grade 12 subjects?", "macewan", 5, "high", "five_acceptable_grade12"), ("five 30-level subjects?", "nait", 5, "high", "five_30_level_subjects"), ("average calculated on five", "nait", 5, "high", "average_calculated_on_five")]
_ordered += [("average of the best five", "norquest", 5, "high", "best_five_average"), ("five grade 12 subjects?", "norquest", 5, "medium", "five_grade12_subjects"), ("admission average .* five subjects?", "ualberta", 5, "high", "admission_average_five_subjects")]
_ordered += [(p, "", v, "high", r) for p, v, r in (("average of five", 5, "avg_of_five"), ("five admission subjects?", 5, "five_admission_subjects"), ("based on five (?:courses|subjects)", 5, "based_on_five"), ("average of four", 4, "avg_of_four"), ("four admission subjects?", 4, "four_admission_subjects"))]
_said_here = lambda p, who: f"regexp_matches(t, '(?i)\\b{p}\\b')" + (f" AND list_contains(string_split('{who}', ' '), a)" if who else "")
_digits = lambda p: f"try_cast(regexp_extract(t, '(?i)\\b{p}', 1) AS INTEGER)"


@query(
    "x07_adapter_average", "v_adapted",
    sql=f"""WITH d AS (SELECT program_id, doc_seq, CASE upper(trim(institution)) WHEN 'NAIT' THEN 'nait' WHEN 'MACEWAN UNIVERSITY' THEN 'macewan' WHEN 'NORQUEST' THEN 'norquest' WHEN 'UNIVERSITY OF ALBERTA' THEN 'ualberta' ELSE '' END AS a, {NS("text")} AS t FROM v_adapted),
      s AS (SELECT *, substr(t, coalesce({", ".join(f"nullif(strpos(t, '{m}'), 0)" for m in _STARTS)}, 1)) AS u, contains(t, 'Content is loading...') AND coalesce({", ".join(f"nullif(strpos(t, '{m}'), 0)" for m in _STARTS)}, 0) = 0 AS shell FROM d),
      e AS (SELECT *, list_min(list_filter([{", ".join(f"strpos(u, '{m}')" for m in _ENDS)}], lambda i: i > 1)) AS stop FROM s), k AS (SELECT program_id, doc_seq, a, t, CASE WHEN a <> 'nait' THEN t WHEN shell THEN '' WHEN stop IS NULL THEN trim(u) ELSE trim(substr(u, 1, stop - 1)) END AS w FROM e),
      docs AS (SELECT program_id, doc_seq, a, CASE WHEN w = '' THEN t ELSE w END AS t FROM k WHERE t <> '' QUALIFY w <> '' OR bool_and(w = '') OVER (PARTITION BY program_id)),
      joined AS (SELECT program_id, any_value(a) AS a, string_agg(t, ' ' ORDER BY doc_seq) AS t FROM docs GROUP BY 1),
      hit AS (SELECT program_id, CASE {" ".join(f"WHEN {_said_here(p, w)} THEN ({v}, '{c}', '{r}')" for p, w, v, c, r in _ordered)} WHEN {_digits("average of ([0-9]+)")} BETWEEN 1 AND 10 THEN ({_digits("average of ([0-9]+)")}, 'medium', 'avg_of_number')
        WHEN {_digits("based on ([0-9]+) (?:courses|subjects)")} BETWEEN 1 AND 10 THEN ({_digits("based on ([0-9]+) (?:courses|subjects)")}, 'medium', 'based_on_number') WHEN a IN ('nait', 'ualberta') AND regexp_matches(t, '(?i)\\badmission average\\b') THEN (5, 'low', a || '_default_five') END AS x FROM joined)
      SELECT program_id, x[1]::INTEGER AS value, x[2] AS confidence, x[3] AS rule_id FROM hit WHERE x IS NOT NULL""",
)
def x07_adapters(docs: DataFrame) -> DataFrame:
    """The course count of every program by the rules of its institution, the general ones and the default."""
    return A.average_totals(docs).drop("snippet")


_low = [(f"try_cast({GET(p, 1)} AS INTEGER) BETWEEN 0 AND 100", f"try_cast({GET(p, 1)} AS INTEGER)") for p in X.MINIMUM_AVERAGES]


@query("x08_minimum_average", "v_docs", sql=f"WITH {_t} SELECT doc_id, {_case(_low)} AS value FROM t")
def x08(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", X.minimum_average(T.norm_space("text"))["value"].alias("value"))


@query("x09_competitive", "v_docs", sql=f"WITH {_t}, m AS (SELECT doc_id, t, coalesce(nullif({GET(X.COMPETITIVE[0], 0)}, ''), {GET(X.COMPETITIVE[1], 0)}) AS m FROM t), s AS (SELECT doc_id, m, {NS('substr(t, greatest(strpos(t, m) - 130, 1), length(m) + 130 + least(strpos(t, m) - 1, 130))')} AS s FROM m) SELECT doc_id, CASE WHEN m <> '' THEN s END AS value, CASE WHEN m <> '' THEN coalesce(try_cast(regexp_extract(s, '(?i)\\b(\\d{{2,3}})(?:\\.\\d+)?\\s*(?:%|percent)\\b', 1) AS INTEGER), try_cast(regexp_extract(s, '(?i)\\b(?:low|mid|high)\\s*(\\d{{2}})s\\b', 1) AS INTEGER)) END AS floor FROM s")
def x09(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", X.competitive(T.norm_space("text")).alias("c")).select("doc_id", "c.value", "c.floor")


def _labels(patterns) -> str:
    hits = ", ".join(f"{{'at': strpos(lower(t), nullif(lower({GET(p, 0)}), '')), 'label': '{n}'}}" for p, n in patterns)
    return f"list_transform(list_sort(list_filter([{hits}], lambda h: h.at > 0)), lambda h: h.label)"


@query("x10_courses", "v_docs", sql=f"WITH {_t} SELECT doc_id, array_to_string({_labels(X.SCIENCE)}, ' or ') AS science, array_to_string({_labels(X.SOCIAL)}, ' or ') AS social FROM t")
def x10(docs: DataFrame) -> DataFrame:
    t = T.norm_space("text")
    join = lambda p: F.coalesce(F.array_join(X.courses(t, p), " or "), F.lit(""))
    return docs.select("doc_id", join(X.SCIENCE).alias("science"), join(X.SOCIAL).alias("social"))


_mins = " , ".join(f"regexp_extract_all(t, '(?i)\\b(\\d{{2,3}})(?:\\.\\d+)?\\s*(?:%|percent)\\s*(?:in|for)\\s*{p}', 1), regexp_extract_all(t, '(?i){p}[^.;\\n]{{0,30}}?\\b(?:at|with|minimum(?:\\s+of)?|of)?\\s*(\\d{{2,3}})(?:\\.\\d+)?\\s*(?:%|percent)\\b', 1)" for p, _ in X.MATH)


@query("x11_course_minimums", "v_docs", sql=f"WITH {_t} SELECT doc_id, list_min(list_filter(list_transform(flatten([{_mins}]), lambda x: try_cast(x AS INTEGER)), lambda n: n BETWEEN 0 AND 100)) AS minimum FROM t")
def x11(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", X.course_minimum(T.norm_space("text"), X.MATH).alias("minimum"))


@query("x12_science_flags", "v_docs", sql=f"WITH {_t} SELECT doc_id, " + ", ".join(f"CASE WHEN {HAS(p)} THEN 'Yes' ELSE '' END AS {n.split()[0].lower()}_30_req" for p, n in X.SCIENCE) + " FROM t")
def x12(docs: DataFrame) -> DataFrame:
    held = X.courses(T.norm_space("text"), X.SCIENCE)
    return docs.select("doc_id", *[F.when(F.array_contains(held, n), "Yes").otherwise("").alias(f"{n.split()[0].lower()}_30_req") for _, n in X.SCIENCE])


_WL = "['one','two','three','four','five','six','seven','eight','nine','ten']"
_el = [(HAS(p), f"[coalesce(nullif(list_position({_WL}, lower({GET(p, 1)})), 0)::VARCHAR, {GET(p, 1)}), array_to_string(list_transform(regexp_extract_all({GET(p, 2)}, '(?i)\\b([ABCD])\\b', 1), lambda g: upper(g)), ',')]") for p in X.ELECTIVES]


@query("x13_electives", "v_docs", sql=f"WITH {_t}, e AS (SELECT doc_id, {_case(_el)} AS e FROM t) SELECT doc_id, try_cast(e[1] AS INTEGER) AS quantity, e[2] AS pool FROM e")
def x13(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", X.electives(T.norm_space("text")).alias("e")).select("doc_id", "e.quantity", "e.pool")


@query("x16_tests", "v_docs", sql=f"WITH {_t} SELECT doc_id, concat_ws('; ', {', '.join(f'CASE WHEN {HAS(p)} THEN {chr(39)}{n}{chr(39)} END' for p, n in X.TESTS)}) AS tests FROM t")
def x16(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", X.tests_mentioned(T.norm_space("text")).alias("tests"))


_broad = "(" + " OR ".join(f"contains(lower(url), '{u}')" for u in X.BROAD_URLS) + " OR regexp_matches(lower(url), '/programs-and-courses/?$'))"
_local = lambda p, c: f"len(list_filter(regexp_split_to_array(t, '{X.FRAGMENTS}'), lambda f: {HAS(p, 'f')} AND {HAS(c, 'f')})) > 0"


@query("fi09_broad_source", "v_docs", sql=f"WITH {_t} SELECT doc_id, {_broad} AS broad, NOT {_broad} OR ({NS('substr(t, -400)')} <> '' AND NOT {HAS(X.CATALOGUE, 'substr(t, -400)')} AND {HAS(X.BROAD_CONTEXT, 'substr(t, -400)')}) AS allowed FROM t")
def fi09(docs: DataFrame) -> DataFrame:
    last = F.substring(T.norm_space("text"), -400, 400)
    return docs.select("doc_id", X.broad_source(F.col("url")).alias("broad"), X.allow_broad_signal(F.col("url"), last).alias("allowed"))


@query("fi10_local_note", "v_docs", sql=f"WITH {_t} SELECT doc_id, {_local(X.NOTE_WORDS[1][0], X.STRICT_CONTEXT)} AS portfolio FROM t")
def fi10(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", X.local_note(T.norm_space("text"), X.NOTE_WORDS[1][0]).alias("portfolio"))


_notes = [(HAS(p), n) for p, n in X.GROUP_NOTES] + [(f"NOT {_broad} AND {_local(p, X.STRICT_CONTEXT)}", n) for p, n in X.NOTE_WORDS] + [(f"NOT {_broad} AND {HAS('\\bregular admission\\b')}", "regular admission"), (f"NOT {_broad} AND {_local(X.PATHWAY, X.PATHWAY_CONTEXT)}", "post-secondary pathway")]
_NOTES = "concat_ws('; ', " + ", ".join(f"CASE WHEN {a} THEN '{n}' END" for a, n in _notes) + ")"


@query("x18_notes", "v_docs", sql=f"WITH {_t} SELECT doc_id, {_NOTES} AS notes FROM t")
def x18(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.array_join(X.note_tokens(T.norm_space("text"), F.col("url")), "; ").alias("notes"))


_any = "(" + " OR ".join(HAS(p) for p, _ in [*X.ENGLISH, *X.MATH, *X.SCIENCE]) + ")"
_assess = HAS(r"\b(?:placement assessment|accuplacer)\b")


@query(
    "x19_requirement_type", "v_docs",
    sql=f"""WITH {_t}, n AS (SELECT doc_id, {_NOTES} AS n, {_any} AS c, {_assess} AS a FROM t), b AS (SELECT doc_id, n, CASE WHEN c THEN 'alberta_high_school_courses' WHEN a THEN 'placement_assessment' WHEN contains(n, 'post-secondary pathway') THEN 'post_secondary_pathway' WHEN contains(n, 'regular admission') THEN 'regular_admission' END AS b FROM n)
      SELECT doc_id, CASE WHEN b IS NOT NULL THEN CASE WHEN n <> '' THEN concat(b, '; notes: ', n) ELSE b END END AS requirement_type FROM b""",
)
def x19(docs: DataFrame) -> DataFrame:
    t = T.norm_space("text")
    has = T.any_of([X.found(t, p) for p, _ in [*X.ENGLISH, *X.MATH, *X.SCIENCE]])
    return docs.select("doc_id", X.requirement_type(has, X.found(t, r"\b(?:placement assessment|accuplacer)\b"), X.note_tokens(t, F.col("url"))).alias("requirement_type"))


_cand = f"""c AS (SELECT program_id, 'avg_total' AS field, doc_seq * 100 AS seq, ({_case([(a, str(b)) for a, b, _ in _avg])})::VARCHAR AS value, CASE WHEN {' OR '.join(a for a, _, r in _avg[:5])} THEN 3 ELSE 2 END AS r FROM t
  UNION ALL SELECT program_id, 'min_avg_final', doc_seq * 100 + 1, ({_case(_low)})::VARCHAR, 3 FROM t
  UNION ALL SELECT program_id, 'science_req', doc_seq * 100 + 5, array_to_string({_labels(X.SCIENCE)}, ' or '), 3 FROM t
  UNION ALL SELECT program_id, 'elp_tests', doc_seq * 100 + 7, concat_ws('; ', {', '.join(f'CASE WHEN {HAS(p)} THEN {chr(39)}{n}{chr(39)} END' for p, n in X.TESTS)}), 2 FROM t
  UNION ALL SELECT program_id, 'notes', doc_seq * 100 + 8, {_NOTES}, 2 FROM t), f AS (SELECT * FROM c WHERE coalesce(value, '') <> '')"""
_FIELDS = ["avg_total", "min_avg_final", "science_req", "elp_tests", "notes"]


@query("x30_resolve_fields", "v_docs", sql=f"WITH {_t}, {_cand} SELECT program_id, field, arg_max(value, (r, length(value), seq)) AS value FROM f GROUP BY ALL")
def x30(docs: DataFrame) -> DataFrame:
    return X.resolve_fields(X.candidates(docs).filter(F.col("field").isin(*_FIELDS))).select("program_id", "field", "value")


@query("x30_program_profile", "v_docs")
def x30_profile(docs: DataFrame) -> DataFrame:
    """All fields of all programs; tests hold it against pages read by hand."""
    return P.program_fields(docs).select("program_id", "field", "value", "confidence", "rule_id", "source_url")


@query("x32_evidence", "v_docs", sql=f"WITH {_t}, {_cand}, w AS (SELECT *, max((r, length(value))) OVER (PARTITION BY program_id, field ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM f) SELECT program_id, field, seq, value FROM w WHERE best IS NULL OR (r, length(value)) >= best")
def x32(docs: DataFrame) -> DataFrame:
    return X.accepted_evidence(X.candidates(docs).filter(F.col("field").isin(*_FIELDS))).select("program_id", "field", "seq", "value")


@query("wi04_prefix_max_accept", "v_docs", sql=f"WITH {_t}, {_cand}, w AS (SELECT *, max((r, length(value))) OVER (PARTITION BY program_id, field ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM f) SELECT field, count(*) AS accepted FROM w WHERE best IS NULL OR (r, length(value)) >= best GROUP BY 1")
def wi04(docs: DataFrame) -> DataFrame:
    return X.accepted_evidence(X.candidates(docs).filter(F.col("field").isin(*_FIELDS))).groupBy("field").agg(F.count("*").alias("accepted"))


_q, _o = {}, {}
_page_text = NS("""replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\\b[^<>]*>.*?(?:</script\\s*>|\\z)|<style\\b[^<>]*>.*?(?:</style\\s*>|\\z)|<noscript\\b[^<>]*>.*?(?:</noscript\\s*>|\\z)|<!--.*?(?:-->|\\z)', ' ', 'g'), '<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')""")
_q["x01_html_to_text"] = lambda pages: pages.select("page_id", X.html_text(F.col("html")).alias("text"))
_o["x01_html_to_text"] = f"SELECT page_id, {_page_text} AS text FROM v_pages"

_LINKS = r"""a AS (SELECT page_id, url AS base, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a\s*>', 1)) AS href, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a\s*>', 2)) AS label,
    unnest(range(len(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a\s*>', 1)))) AS position FROM v_pages),
  b AS (SELECT *, trim(href) AS h, regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS site, regexp_replace(base, '[?#].*$', '') AS page FROM a),
  u AS (SELECT page_id, base, position, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h WHEN h = '' THEN base WHEN starts_with(h, '//') THEN concat(regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1), h) WHEN starts_with(h, '/') THEN concat(site, h)
    WHEN starts_with(h, '?') THEN concat(page, h) WHEN starts_with(h, '#') THEN concat(regexp_replace(base, '#.*$', ''), h) ELSE concat(regexp_replace(page, '[^/]*$', ''), h) END AS url, trim(regexp_replace(regexp_replace(label, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM b),
  links AS (SELECT page_id, url, arg_min(base, position) AS base, min(position)::INTEGER AS position, arg_min(text, position) AS text FROM u WHERE regexp_matches(url, '^(?i:https?)://') AND NOT regexp_matches(lower(url), '\.(pdf|jpg|jpeg|png|gif|svg|zip|docx?|xlsx?)$') GROUP BY 1, 2)"""
_q["x02_html_links"] = lambda pages: X.html_links(pages).drop("base")
_o["x02_html_links"] = f"WITH {_LINKS} SELECT page_id, position, url, text FROM links"

_points = " + ".join([f"CASE WHEN contains(hay, '{w}') THEN {n} ELSE 0 END" for w, n in X.LINK_WORDS] + [f"CASE WHEN {' OR '.join(f'contains(hay, {chr(39)}{w}{chr(39)})' for w in ws)} THEN {n} ELSE 0 END" for ws, n in X.LINK_BONUS] + ["CASE WHEN contains(hay, 'competitive') AND contains(hay, 'admission') THEN 2 ELSE 0 END"])
_q["x04_score_links"] = lambda pages: X.html_links(pages).select("page_id", "url", X.link_score(F.col("url"), F.col("text")).alias("score"))
_o["x04_score_links"] = f"WITH {_LINKS}, s AS (SELECT *, lower(concat(url, ' ', text)) AS hay FROM links) SELECT page_id, url, ({_points})::INTEGER AS score FROM s"
_o["wi05_top_links"] = f"""WITH {_LINKS}, s AS (SELECT *, lower(concat(url, ' ', text)) AS hay, lower(regexp_extract(base, '://([^/?#:]*)', 1)) AS bh, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS uh FROM links),
  p AS (SELECT page_id, url, ({_points})::INTEGER AS score FROM s WHERE bh <> '' AND uh <> '' AND (bh = uh OR ends_with(uh, concat('.', bh)) OR ends_with(bh, concat('.', uh)) OR array_to_string(string_split(bh, '.')[-2:], '.') = array_to_string(string_split(uh, '.')[-2:], '.'))),
  r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, length(url), url)::INTEGER AS place FROM p WHERE score > 0) SELECT page_id, place, url, score FROM r WHERE place <= 8"""
_q["wi05_top_links"] = lambda pages: X.top_links(X.html_links(pages))

for _name, _made in _q.items():
    query(_name, "v_pages", sql=_o.get(_name))(_made)
