"""Requirement fields out of page texts, as column expressions; each text is read by JVM regular expressions only.

An extractor takes a text whose white space is collapsed and gives a struct (value, rule_id, snippet ...), null where
nothing is found. Candidates of all documents of a program are folded by ``resolve_fields``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import text as T

# The patterns that pages are read with.
ENGLISH = [(rf"\b(?:english\s+language\s+arts|english|ela)\s*{c}\b", f"English {c}") for c in ("20-1", "20-2", "30-1", "30-2")]
MATH = [(rf"\b(?:mathematics|math)\s*{c}\b", f"Math {c}") for c in ("20-1", "20-2", "30-1", "30-2", "31")]
SOCIAL = [(r"\bsocial\s+studies\s*30-1\b", "Social Studies 30-1"), (r"\bsocial\s+studies\s*30-2\b", "Social Studies 30-2"), (r"\baboriginal\s+studies\s*30\b", "Aboriginal Studies 30")]
SCIENCE = [(rf"\b{c}\s*30\b", f"{c.title()} 30") for c in ("biology", "chemistry", "physics", "science")]
TESTS = [(r"\bielts\b", "IELTS"), (r"\btoefl\b", "TOEFL"), (r"\bduolingo\b", "Duolingo"), (r"\bcael\b", "CAEL"), (r"\bpearson\b|\bpte\b", "Pearson")]
AVERAGE_COUNTS = [
    (r"\baverage of five\b", 5, "high", "avg_of_five"), (r"\bfive admission subjects?\b", 5, "high", "five_admission_subjects"), (r"\bbased on five (?:courses|subjects)\b", 5, "high", "based_on_five"),
    (r"\baverage of four\b", 4, "high", "avg_of_four"), (r"\bfour admission subjects?\b", 4, "high", "four_admission_subjects"),
    (r"\baverage of (\d+)\b", None, "medium", "avg_of_number"), (r"\bbased on (\d+) (?:courses|subjects)\b", None, "medium", "based_on_number"),
]
_PERCENT = r"(\d{2,3})(?:\.\d+)?\s*(?:%|percent)(?:\W|$)"
MINIMUM_AVERAGES = [
    rf"\bminimum(?:\s+overall|\s+admission)?\s+average(?:\s+of)?\s+{_PERCENT}", rf"\bminimum\s+admission\s+average\s+(?:is|of|:)\s*{_PERCENT}", rf"\bminimum\s+overall\s+average\s+of\s+{_PERCENT}",
    rf"\boverall\s+minimum\s+average\s+of\s+{_PERCENT}", rf"\ban\s+overall\s+minimum\s+average\s+of\s+{_PERCENT}",
]
COMPETITIVE = [r"\bcompetitive\s+(?:admission\s+)?average\b[^.:\n]{0,180}", r"\bcompetitive\b[^.:\n]{0,160}\b(?:average|averages|percent|%)\b[^.:\n]{0,80}"]
_N = "one|two|three|four|five|six|seven|eight|nine|ten|[0-9]+"
ELECTIVES = [rf"\b({_N})\s+(?:additional\s+)?{w}\s+from\s+(groups?\s+[A-D][^.;\n]*)" for w in ("subjects?", "courses?")]
GROUP_NOTES = [
    (r"\bmaximum of one group b\b|\bmax(?:imum)?\s+1\s+group b\b", "max 1 Group B"), (r"\bmaximum of two group b\b|\bmax(?:imum)?\s+2\s+group b\b", "max 2 Group B"),
    (r"\bmaximum of three subjects? from groups? a/c\b|\b3 subjects? from groups? a/c\b", "max 3 from Groups A/C"), (r"\bmaximum of one group d\b|\bmax(?:imum)?\s+1\s+group d\b", "max 1 Group D"),
]
STRICT_CONTEXT = r"\b(?:admission|admissions|entrance|require|required|requirements|applicant|applicants|application|eligibility|selection|pre-screening|must|submit|provide|non-academic)\b"
BROAD_CONTEXT = (
    r"\b(?:minimum\s+(?:entrance|admission)\s+requirements?|program\s+requirements?|subject\s+requirements?|applicants?\s+must|must\s+(?:complete|present|achieve)"
    r"|required\s+for\s+admission|admission\s+average|competitive\s+average|entrance\s+requirements?)\b"
)
CATALOGUE = r"\b(?:pre-?requisites?|lecture|lab|work experience|credit(?:s)?|course code|course description)\b"
ELP_CONTEXT = r"\b(?:english\s+language\s+proficiency|proficiency|admission|admissions|require|required|requirements|test\s+scores?|applicant|applicants)\b"
PATHWAY_CONTEXT = r"\b(?:admission|admissions|entrance|require|required|requirements|applicant|applicants|must|minimum|eligible|eligibility|accredited|recognized)\b"
PATHWAY = r"\b(?:two-year diploma|post-secondary credits?|minimum gpa|graduation gpa|accredited or recognized institution)\b"
BROAD_URLS = (
    "/admissions/how-to-apply", "/apply-enrol/admissions/application/how-to-apply", "/applying-to-norquest/how-to-apply", "/programs-and-courses/open-studies",
    "/programs-and-courses/microcredentials", "/english-language-proficiency", "/international-students/",
)
FRAGMENTS = r"[.;]\s+|\n+|\s+\|\s+|\s+-\s+"
NOTE_WORDS = [(r"\bcasper\b", "CASPer required"), (r"\bportfolio\b", "portfolio required"), (r"\baudition\b", "audition required"), (r"\binterview\b", "interview required")]
RANKS = {"none": 0, "low": 1, "medium": 2, "high": 3}


def _i(pattern: str) -> str:
    return f"(?i){pattern}"


def found(text: Column, pattern: str) -> Column:
    return text.rlike(_i(pattern))


def holds(low: Column, *words: str) -> Column:
    """Whether a lower-case text has one of the words: a byte search that spares most texts a regular expression."""
    return T.any_of([F.contains(low, F.lit(w)) for w in words])


def snippet(text: Column, pattern: str, radius: int = 100) -> Column:
    """The match with what stands around it."""
    at = F.regexp_instr(text, F.lit(_i(pattern))) - 1
    return T.excerpt(text, at, at + F.length(F.regexp_extract(text, _i(pattern), 0)), radius)


def broad_source(url: Column) -> Column:
    """Pages about applying in general."""
    u = F.lower(T.norm_space(url))
    return (u != "") & (T.any_of([F.contains(u, F.lit(x)) for x in BROAD_URLS]) | u.rlike("/programs-and-courses/?$"))


def allow_broad_signal(url: Column, shown: Column) -> Column:
    s = T.norm_space(shown)
    return ~broad_source(url) | ((s != "") & ~found(s, CATALOGUE) & found(s, BROAD_CONTEXT))


def local_note(text: Column, pattern: str, context: str = STRICT_CONTEXT) -> Column:
    """Whether one fragment of the text has both the pattern and its context."""
    return found(text, pattern) & F.exists(F.split(text, FRAGMENTS), lambda f: f.rlike(_i(pattern)) & f.rlike(_i(context)))


def _first(options: list[tuple[Column, Column]]) -> Column:
    out = None
    for test, made in options:
        out = F.when(test, made) if out is None else out.when(test, made)
    return out


def average_count(text: Column) -> Column:
    """struct(value, confidence, rule_id, snippet) of the first rule that gives 1..10."""
    options = []
    for pattern, value, confidence, rule in AVERAGE_COUNTS:
        n = F.lit(value) if value else F.regexp_extract(text, _i(pattern), 1).try_cast("int")
        options.append((found(text, pattern) & n.between(1, 10), F.struct(n.cast("int").alias("value"), F.lit(confidence).alias("confidence"), F.lit(rule).alias("rule_id"), snippet(text, pattern).alias("snippet"))))
    return _first(options)


def minimum_average(text: Column) -> Column:
    options = []
    for k, pattern in enumerate(MINIMUM_AVERAGES, 1):
        n = F.regexp_extract(text, _i(pattern), 1).try_cast("int")
        options.append((n.between(0, 100), F.struct(n.alias("value"), F.lit(f"min_avg_pattern_{k}").alias("rule_id"), snippet(text, pattern).alias("snippet"))))
    return _first(options)


def competitive(text: Column) -> Column:
    """struct(value: the passage, floor: its percentage or decade)."""
    options = []
    for pattern in COMPETITIVE:
        shown = snippet(text, pattern, 130)
        floor = F.coalesce(F.regexp_extract(shown, _i(r"\b(\d{2,3})(?:\.\d+)?\s*(?:%|percent)\b"), 1).try_cast("int"), F.regexp_extract(shown, _i(r"\b(?:low|mid|high)\s*(\d{2})s\b"), 1).try_cast("int"))
        options.append((found(text, pattern), F.struct(shown.alias("value"), floor.alias("floor"))))
    return _first(options)


def courses(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """Labels of the courses named, by first position; null if none."""
    hits = F.filter(F.array(*[F.struct(F.regexp_instr(text, F.lit(_i(p))).alias("at"), F.lit(n).alias("label")) for p, n in patterns]), lambda h: h["at"] > 0)
    return T.let(hits, lambda held: F.when(F.size(held) > 0, F.transform(F.array_sort(held), lambda h: h["label"])))


def with_shorthand(text: Column, labels: Column, subject: str) -> Column:
    """Codes after 'or' without their subject ('30-1 or 30-2') are added."""
    head = r"\b(?:english\s+language\s+arts|english|ela)" if subject == "English" else r"\b(?:mathematics|math)"
    pairs = ([("20-1", "20-2"), ("20-2", "20-1")] if subject == "Math" else []) + [("30-1", "30-2"), ("30-2", "30-1")]
    for a, b in pairs:
        short = found(text, rf"{head}\s*{a}\b[^.;\n]{{0,24}}\bor\b[^.;\n]{{0,12}}\b{b}\b")
        other = F.array(F.lit(f"{subject} {b}"))
        first = subject == "English" and b == "30-1"

        def step(held):  # called at once, within this turn
            add = F.array_contains(held, f"{subject} {a}") & ~F.array_contains(held, f"{subject} {b}") & short
            return F.when(add, F.concat(other, held) if first else F.concat(held, other)).otherwise(held)

        labels = T.let(labels, step)
    return labels


def course_minimum(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """The least percentage that stands before or after one of the courses."""
    every = []
    for p, _ in patterns:
        every.append(F.regexp_extract_all(text, F.lit(_i(rf"\b(\d{{2,3}})(?:\.\d+)?\s*(?:%|percent)\s*(?:in|for)\s*{p}")), F.lit(1)))
        every.append(F.regexp_extract_all(text, F.lit(_i(rf"{p}[^.;\n]{{0,30}}?\b(?:at|with|minimum(?:\s+of)?|of)?\s*(\d{{2,3}})(?:\.\d+)?\s*(?:%|percent)\b")), F.lit(1)))
    return F.array_min(F.filter(F.transform(F.concat(*every), lambda x: x.try_cast("int")), lambda n: n.between(0, 100)))


def electives(text: Column) -> Column:
    """struct(quantity, pool): how many courses and from which groups."""
    options = []
    for pattern in ELECTIVES:
        pool = F.array_distinct(F.transform(F.regexp_extract_all(F.regexp_extract(text, _i(pattern), 2), F.lit(_i(r"\b([ABCD])\b")), F.lit(1)), F.upper))
        options.append((found(text, pattern), F.struct(T.count_strict(F.regexp_extract(text, _i(pattern), 1)).alias("quantity"), F.array_join(pool, ",").alias("pool"))))
    return _first(options)


def tests_mentioned(text: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(found(text, p), n) for p, n in TESTS])), "; ")


def note_tokens(text: Column, url: Column) -> Column:
    """Group caps, documents to submit, and pathways, each once, in order."""
    return T.let(F.lower(text), lambda low: _note_tokens(text, low, ~broad_source(url)))


def _note_tokens(text: Column, low: Column, near: Column) -> Column:
    parts = [F.when(holds(low, "group") & found(text, p), n) for p, n in GROUP_NOTES]
    parts += [F.when(near & holds(low, n.split()[0].lower()) & local_note(text, p), n) for p, n in NOTE_WORDS]
    parts.append(F.when(near & holds(low, "regular admission") & found(text, r"\bregular admission\b"), "regular admission"))
    parts.append(F.when(near & holds(low, "two-year diploma", "post-secondary credit", "minimum gpa", "graduation gpa", "accredited or") & local_note(text, PATHWAY, PATHWAY_CONTEXT), "post-secondary pathway"))
    return F.array_compact(F.array(*parts))


def requirement_type(has_courses: Column, assessment: Column, notes: Column) -> Column:
    """The token by precedence, with the notes after it; null if nothing speaks for one."""
    base = F.when(has_courses, "alberta_high_school_courses").when(assessment, "placement_assessment").when(F.array_contains(notes, "post-secondary pathway"), "post_secondary_pathway").when(F.array_contains(notes, "regular admission"), "regular_admission")
    return F.when(base.isNotNull(), F.when(F.size(notes) > 0, F.concat(base, F.lit("; notes: "), F.array_join(notes, "; "))).otherwise(base))


def _candidates(t: Column, low: Column, url: Column) -> Column:
    text = lambda c: c.cast("string")
    listed = lambda c: F.array_join(c, " or ")
    level = holds(low, "20-", "30-")

    def rows(avg: Column, least: Column, comp: Column, el: Column) -> Column:
        made = [
            ("avg_total", text(avg["value"]), avg["confidence"], avg["rule_id"]),
            ("min_avg_final", text(least["value"]), F.lit("high"), least["rule_id"]),
            ("competitive_final", comp["value"], F.lit("medium"), F.lit("competitive")),
            ("english_req", F.when(level & holds(low, "english", "ela"), listed(with_shorthand(t, courses(t, ENGLISH), "English"))), F.lit("high"), F.lit("english_courses")),
            ("math_req", F.when(holds(low, "math"), listed(with_shorthand(t, courses(t, MATH), "Math"))), F.lit("high"), F.lit("math_courses")),
            ("science_req", F.when(holds(low, "biology", "chemistry", "physics", "science"), listed(courses(t, SCIENCE))), F.lit("high"), F.lit("science_courses")),
            ("elective_qty", text(el["quantity"]), F.lit("high"), F.lit("electives")),
            ("elp_tests", F.when(holds(low, *(n.lower() for _, n in TESTS), "pte"), tests_mentioned(t)), F.lit("medium"), F.lit("tests")),
            ("notes", F.array_join(_note_tokens(t, low, ~broad_source(url)), "; "), F.lit("medium"), F.lit("notes")),
        ]
        names = ("field", "rule_seq", "value", "confidence", "rule_id")
        every = F.array(*[F.struct(*[c.alias(n) for c, n in zip((F.lit(f), F.lit(i), v, c, r), names, strict=True)]) for i, (f, v, c, r) in enumerate(made)])
        return F.filter(every, lambda r: F.coalesce(r["value"], F.lit("")) != "")

    average = F.when(holds(low, "average of", "admission subject", "based on"), average_count(t))
    least = F.when(holds(low, "average"), minimum_average(t))
    comp = F.when(holds(low, "competitive"), competitive(t))
    pool = F.when(holds(low, "from group"), electives(t))
    return T.let(average, lambda a: T.let(least, lambda m: T.let(comp, lambda c: T.let(pool, lambda e: rows(a, m, c, e)))))


def candidates(docs: DataFrame) -> DataFrame:
    """docs (program_id, doc_seq, url, text) to long candidates (program_id, field, seq, value, confidence, rule_id, source_url)."""
    every = T.let(T.norm_space("text"), lambda t: T.let(F.lower(t), lambda low: _candidates(t, low, F.col("url"))))
    long = docs.select("program_id", "doc_seq", F.col("url").alias("source_url"), F.explode(every).alias("r"))
    return long.select("program_id", "source_url", "r.field", (F.col("doc_seq") * 100 + F.col("r.rule_seq")).alias("seq"), "r.value", "r.confidence", "r.rule_id")


def rank(confidence: Column) -> Column:
    out = F.lit(0)
    for name, n in RANKS.items():
        out = F.when(F.lower(confidence) == name, n).otherwise(out)
    return out


def resolve_fields(found_: DataFrame) -> DataFrame:
    """The value of each field after all candidates: highest rank, then longest, then last. An aggregate, so no sort."""
    order = F.struct(rank(F.col("confidence")), F.length("value"), "seq")
    best = F.max_by(F.struct("value", "confidence", "rule_id", "source_url"), order)
    return found_.groupBy("program_id", "field").agg(best.alias("b")).select("program_id", "field", "b.*")


def accepted_evidence(found_: DataFrame) -> DataFrame:
    """Every candidate that was accepted at its moment: not below the best (rank, length) before it."""
    mine = F.struct(rank(F.col("confidence")).alias("r"), F.length("value").alias("n"))
    before = Window.partitionBy("program_id", "field").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    held = found_.withColumn("mine", mine).withColumn("best", F.max("mine").over(before))
    return held.filter(F.col("best").isNull() | (F.col("mine") >= F.col("best"))).drop("mine", "best")


# Weights of link words.
LINK_WORDS = [(w, 2) for w in ("admission", "admissions", "entrance", "requirement", "requirements", "how-to-apply", "how to apply", "apply", "english", "math", "academic requirements")]
LINK_WORDS += [(w, -3) for w in ("tuition", "fees", "scholarship", "events", "news", "calendar", "residence", "housing", "donate", "alumni", "privacy", "contact")]
LINK_BONUS = [(("admission-requirements",), 8), (("admission requirements", "admission requirement"), 6), (("subject-requirements", "competitive-requirements"), 4), (("how to apply", "how-to-apply"), 1)]


def link_score(url: Column, text: Column, boosts: tuple[str, ...] = (), demotes: tuple[str, ...] = ()) -> Column:
    hay = F.lower(F.concat_ws(" ", url, F.coalesce(text, F.lit(""))))
    has = lambda w: F.contains(hay, F.lit(w))
    points = [F.when(has(w), n).otherwise(0) for w, n in [*LINK_WORDS, *((b, 4) for b in boosts), *((d, -4) for d in demotes)]]
    points += [F.when(T.any_of([has(w) for w in ws]), n).otherwise(0) for ws, n in LINK_BONUS]
    points.append(F.when(has("competitive") & has("admission"), 2).otherwise(0))
    total = points[0]
    for p in points[1:]:
        total = total + p
    return total


def html_links(pages: DataFrame) -> DataFrame:
    """page_id, position, url, text of the anchors of pages (page_id, url, html): absolute http URLs, the first of each URL."""
    pattern = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a\s*>"""
    get = lambda i: F.regexp_extract_all("html", F.lit(pattern), F.lit(i))
    # Resolved inside lambdas, so that no filter repeats the resolution.
    zipped = F.arrays_zip(get(1).alias("href"), get(2).alias("label"))
    made = F.transform(zipped, lambda a, i: F.struct(i.alias("position"), T.resolve_url(F.col("url"), a["href"]).alias("url"), a["label"].alias("label")))
    kept = F.filter(made, lambda x: x["url"].rlike("^(?i)https?://") & ~T.should_skip_url(x["url"]))
    long = pages.select("page_id", F.col("url").alias("base"), F.explode(kept).alias("x"))
    ok = long.select("page_id", "base", "x.position", "x.url", T.norm_space(F.regexp_replace("x.label", "<[^>]*>", " ")).alias("text"))
    first = F.min_by(F.struct("position", "text", "base"), "position")
    return ok.groupBy("page_id", "url").agg(first.alias("f")).select("page_id", F.col("f.base").alias("base"), F.col("f.position").alias("position"), "url", F.col("f.text").alias("text"))


def top_links(links: DataFrame, k: int = 8) -> DataFrame:
    """The k best links of the page's own site: score, then shorter, then URL."""
    same = T.is_same_site(T.url_host("base"), T.url_host("url"))
    held = links.filter(same).withColumn("score", link_score(F.col("url"), F.col("text"))).filter("score > 0")
    at = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), F.length("url"), "url"))
    return held.withColumn("place", at).filter(F.col("place") <= k).select("page_id", "place", "url", "score")


#: Elements that are not shown, to their own closing tag or the end; comments.
HIDDEN = "(?is)" + "|".join(rf"<{t}\b[^<>]*>.*?(?:</{t}\s*>|\z)" for t in ("script", "style", "noscript")) + r"|<!--.*?(?:-->|\z)"


def html_text(html: Column) -> Column:
    """Visible text of a page, white space collapsed."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " ")
    t = F.regexp_replace(t, "<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return T.norm_space(t)
