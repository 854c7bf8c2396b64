"""The whole profile of a program out of its pages: 24 fields, each with confidence, rule, snippet and source.

A page gives at most one candidate for each field, so a program's values are one aggregate over its pages. Texts are
read before the only shuffle, which is by program: the window over earlier pages and the aggregate share it, and what
crosses it are values and snippets, never texts. Rules of the average count are tried in their order over all pages
of a program; a rule is looked for within a page.

Null or blank texts give nothing; a program whose pages give nothing has no row in ``program_fields``. Pages of equal
program and place count as read in the order of their values. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import adapters as A
from sievework.operators import extract as X
from sievework.operators import quality as Q

# The fields, and the patterns of signals and gates.
FIELDS = [
    "min_avg_final", "competitive_final", "competitive_floor_numeric", "avg_total", "english_req", "english_requirement_mode", "english_min",
    "math_req", "math_requirement_mode", "math_min", "social_req", "social_min", "science_req", "science_min", "bio_30_req", "chem_30_req",
    "phys_30_req", "sci_30_req", "elective_qty", "elective_pool", "requirement_type", "hs_diploma_req", "math_assessment_flag", "elp_tests_mentioned",
]
POST_SECONDARY = (
    r"\b(?:two-year diploma|related diploma|business related-diploma|post-secondary credits?|minimum gpa|graduation gpa|accredited or recognized institution"
    r"|accredited it program|open studies courses|red seal trade|certified trades professionals|journeypersons?|direct route into (?:the )?third year"
    r"|third year of the bachelor of business administration|background in a red seal trade)\b"
)
HIGH_SCHOOL = r"\b(?:grade 12|high school|english language arts (?:20|30)|mathematics (?:20|30)|social studies 30|biology 30|chemistry 30|physics 30|science 30)\b"
ACADEMIC = r"\b(?:meet|satisfy)\s+(?:their\s+)?academic requirements\b"
REQUIREMENT_URLS = ("admission-requirements", "program-requirements", "competitive-requirements", "subject-requirements")
ASSESSMENT = r"\b(?:academic assessment|placement assessment|placement test|accuplacer|math assessment)\b"
ASSESSMENT_ROUTE = (
    rf"{ASSESSMENT}|\bmeet(?:ing)?(?: their)? academic requirements? with (?:a|an|free )?(?:academic )?assessment\b"
    r"|\bacademic requirements? (?:can|may) be met with (?:a|an|free )?(?:academic )?assessment\b"
)
ASSESSMENT_CONTEXT = (
    r"\b(?:academic\s+requirements?|admission|admissions|applicant|applicants|application|may\s+meet|can\s+meet|meet\s+their|free\s+assessment|accuplacer"
    r"|placement\s+assessment|math\s+assessment)\b"
)
_PLACEMENT = r"\b(?:placement\s+test|placement\s+assessment|academic\s+assessment|accuplacer|math\s+assessment)\b"
MATH_GATES = [rf"\bmathematics?\b[^.;\n]{{0,80}}{_PLACEMENT}", rf"{_PLACEMENT}[^.;\n]{{0,80}}\bmathematics?\b"]
_N = "one|two|three|four|five|six|seven|eight|nine|ten|[0-9]+"
GRADE_12 = rf"\b({_N})\s+additional\s+grade\s+12\s+courses?\b([^.;\n]{{0,160}})"
SCIENCE_FLAGS = {"bio_30_req": "Biology 30", "chem_30_req": "Chemistry 30", "phys_30_req": "Physics 30", "sci_30_req": "Science 30"}
SUBJECTS = {"english": (X.ENGLISH, "high"), "math": (X.MATH, "high"), "social": (X.SOCIAL, "medium"), "science": (X.SCIENCE, "high")}


def near_context(t: Column, pattern: str, context: str, radius: int = 140) -> Column:
    """The first match of the pattern, with radius characters on both sides, that has the context there; else null."""
    whole = rf"(?is)(?=(?:{pattern}))(?<=(^.{{0,{radius - 1}}}|.{{{radius}}}))((?:{pattern}))(?=(.{{0,{radius}}}))"
    part = lambda i: F.regexp_extract_all(t, F.lit(whole), F.lit(i))
    both = lambda a, b: F.concat(a, b)
    around = F.zip_with(F.zip_with(part(1), part(2), both), part(3), both)
    return F.get(F.filter(around, lambda w: w.rlike(f"(?i){context}")), F.lit(0))


def subject_facts(t: Column, patterns: list[tuple[str, str]], subject: str) -> Column:
    """struct(value: the courses by ' or ', minimum, snippet: from the first to the last of them); null without one."""
    found = F.array(*[F.struct(F.regexp_instr(t, F.lit(f"(?i){p}")).alias("at"), F.lit(n).alias("label")) for p, n in patterns])

    def facts(hits: Column) -> Column:
        labels = F.transform(hits, lambda h: h["label"])
        if subject in ("English", "Math"):
            labels = X.with_shorthand(t, labels, subject)
        shown = T.excerpt(t, F.get(hits, F.lit(0))["at"] - 1, F.element_at(hits, -1)["at"] - 1, 120)
        made = F.struct(F.array_join(labels, " or ").alias("value"), X.course_minimum(t, patterns).cast("string").alias("minimum"), shown.alias("snippet"))
        return F.when(F.size(hits) > 0, made)

    return T.let(F.array_sort(F.filter(found, lambda h: h["at"] > 0)), facts)


def elective_facts(t: Column) -> Column:
    """struct(quantity, pool, snippet): courses from groups A-D, else additional Grade 12 courses and their levels."""
    made = None
    for pattern, items in [*((p, r"\b([ABCD])\b") for p in X.ELECTIVES), (GRADE_12, r"\b(30-1|30-2|30|35)\b")]:
        pool = F.array_distinct(F.transform(F.regexp_extract_all(F.regexp_extract(t, f"(?i){pattern}", 2), F.lit(f"(?i){items}"), F.lit(1)), F.upper))
        quantity = T.count_strict(F.regexp_extract(t, f"(?i){pattern}", 1)).cast("string")
        option = (X.found(t, pattern), F.struct(quantity.alias("quantity"), F.array_join(pool, ",").alias("pool"), X.snippet(t, pattern).alias("snippet")))
        made = F.when(*option) if made is None else made.when(*option)
    return made


def page_facts(docs: DataFrame) -> DataFrame:
    """What each page (program_id, doc_seq, url, text) says, before anything is known of the others."""
    t, low, url, broad = F.col("t"), F.col("low"), F.col("url"), F.col("broad")
    has = lambda *words: X.holds(low, *words)
    pages = A.adapted(docs).select("program_id", "doc_seq", "adapter", "trimmed_away", F.coalesce("url", F.lit("")).alias("url"), F.col("text").alias("t"), X.broad_source(F.col("url")).alias("broad")).filter("t <> ''").withColumn("low", F.lower("t"))
    tests = "|".join(p for p, _ in X.TESTS)
    math_gate = None
    for pattern in MATH_GATES:
        option = (X.found(X.snippet(t, pattern, 140), ASSESSMENT_CONTEXT) & X.found(t, pattern), X.snippet(t, pattern, 140))
        math_gate = F.when(*option) if math_gate is None else math_gate.when(*option)
    assess = has("assessment", "placement test", "accuplacer")
    read = pages.select(
        "program_id", "doc_seq", "url", "broad", "adapter", "trimmed_away", F.substring("t", 1, 240).alias("head"), *[c.alias(n) for n, c in A.average_facts(t, F.col("adapter")).items()],
        F.when(has("average"), X.minimum_average(t)).alias("least"),
        F.when(has("competitive"), X.competitive(t)).alias("comp"),
        F.when(has("20-", "30-") & has("english", "ela"), subject_facts(t, X.ENGLISH, "English")).alias("english"),
        F.when(has("20-", "30-", "31") & has("math"), subject_facts(t, X.MATH, "Math")).alias("math"),
        F.when(has("social", "aboriginal"), subject_facts(t, X.SOCIAL, "Social")).alias("social"),
        F.when(has("30") & has("biology", "chemistry", "physics", "science"), subject_facts(t, X.SCIENCE, "Science")).alias("science"),
        F.when(has("from group", "additional grade"), elective_facts(t)).alias("pool"),
        F.when(~broad & has("language proficiency"), near_context(t, r"\blanguage\s+proficiency\b", X.ELP_CONTEXT)).alias("elp"),
        F.when(~broad & has(*(n.lower() for _, n in X.TESTS), "pte"), F.struct(X.tests_mentioned(t).alias("value"), X.snippet(t, tests, 140).alias("snippet"))).alias("tests"),
        F.when(~broad & assess & has("mathematic"), math_gate).alias("math_gate"),
        F.when(~broad & assess, near_context(t, ASSESSMENT, ASSESSMENT_CONTEXT)).alias("assess"),
        F.coalesce(F.when(~broad & assess, X.local_note(t, ASSESSMENT_ROUTE, ASSESSMENT_CONTEXT)), F.lit(False)).alias("route"),
        X.found(t, POST_SECONDARY).alias("pathway"), X.found(t, HIGH_SCHOOL).alias("school"),
        (T.any_of([F.contains(F.lower(url), F.lit(u)) for u in REQUIREMENT_URLS]) | X.found(t, ACADEMIC)).alias("context"),
        (~broad & has("regular admission") & X.found(t, r"\bregular admission\b")).alias("regular"),
        X.note_tokens(t, url).alias("notes"),
    )
    # Pages about applying in general count only where the passage itself speaks of requirements.
    speaks = lambda s: ~broad | (~X.found(s, X.CATALOGUE) & X.found(s, X.BROAD_CONTEXT))
    shown = {"least": "least.snippet", "comp": "comp.value", "pool": "pool.snippet"} | {s: f"{s}.snippet" for s in SUBJECTS}
    return read.withColumns({name: F.when(speaks(F.col(s)), F.col(name)) for name, s in shown.items()})


def _gates(pages: DataFrame) -> DataFrame:
    """Pages with their gates and whether they speak of requirements at all, given the pages before them."""
    tests = F.when(X.found(F.col("tests.snippet"), X.ELP_CONTEXT), F.col("tests.snippet"))
    english = F.when(F.col("english").isNull() & ~(F.col("pathway") & ~F.col("school")), F.coalesce("elp", tests))
    pages = pages.withColumns({"elp_gate": english, "math_gate": F.when(F.col("math").isNull(), F.col("math_gate"))})
    so_far = Window.partitionBy("program_id").orderBy("doc_seq").rowsBetween(Window.unboundedPreceding, 0)
    gated = lambda gate, subject: F.max(F.col(gate).isNotNull()).over(so_far) & ~F.max(F.col(subject).isNotNull()).over(so_far)
    some = T.any_of([F.col(c).isNotNull() for c in (*SUBJECTS, "pool.quantity", "least", "comp")])
    core = some | gated("elp_gate", "english") | gated("math_gate", "math") | F.col("pathway") | F.col("context")
    return pages.withColumn("core", core)


def _candidates() -> dict[str, tuple]:
    """field: (value, confidence, rule, snippet) as columns of a gated page."""
    col, given = F.col, lambda c: F.col(c).isNotNull()
    out = {
        "min_avg_final": (col("least.value").cast("string"), "high", col("least.rule_id"), col("least.snippet")),
        "competitive_final": (col("comp.value"), "medium", "competitive_context", col("comp.value")),
        "competitive_floor_numeric": (col("comp.floor").cast("string"), "low", "competitive_floor", col("comp.value")),
        "elective_qty": (col("pool.quantity"), "medium", "elective_qty_parse", col("pool.snippet")),
        "elective_pool": (F.when(given("pool.quantity") | ~col("broad"), col("pool.pool")), "medium", "elective_pool_parse", col("pool.snippet")),
    }
    for s, (_, sure) in SUBJECTS.items():
        out[f"{s}_req"] = (col(f"{s}.value"), sure, f"{s}_course_parse", col(f"{s}.snippet"))
        out[f"{s}_min"] = (col(f"{s}.minimum"), sure, f"{s}_min_parse", col(f"{s}.snippet"))
    for s, gate, named, mode in (("english", "elp_gate", "English language proficiency", "elp"), ("math", "math_gate", "Placement assessment", "placement_assessment")):
        course, sure = given(s), F.when(given(s), "high").otherwise("medium")
        pick = lambda a, b: F.when(course, a).when(given(gate), b)  # noqa: B023, E731
        shown = F.coalesce(f"{s}.snippet", gate)
        out[f"{s}_req"] = (pick(col(f"{s}.value"), F.lit(named)), sure, pick(F.lit(f"{s}_course_parse"), F.lit(f"{s}_gate_normalize")), shown)
        out[f"{s}_requirement_mode"] = (pick(F.lit("course"), F.lit(mode)), sure, pick(F.lit(f"{s}_requirement_mode_course"), F.lit(f"{s}_requirement_mode_gate")), shown)
    for f, label in SCIENCE_FLAGS.items():
        out[f] = (F.when(F.contains("science.value", F.lit(label)), "Yes"), "high", "science_flag_parse", col("science.snippet"))
    subject = T.any_of([given(s) for s in SUBJECTS])
    out["math_assessment_flag"] = (F.when(col("core") & given("assess"), "Yes"), "high", "math_assessment_detect", col("assess"))
    out["elp_tests_mentioned"] = (F.when(col("core"), col("tests.value")), "medium", "elp_test_detect", col("tests.snippet"))
    school = col("core") & col("school") & (~col("broad") | subject | given("pool.quantity") | given("least"))
    out["hs_diploma_req"] = (F.when(school, "Yes"), "medium", "hs_diploma_signal", F.substring("head", 1, 220))
    academic = subject | given("least")
    base = F.when(academic, "alberta_high_school_courses").when(col("route"), "placement_assessment").when((~col("broad") & col("pathway")) | col("regular"), "regular_admission")
    kind = F.when(F.size("notes") > 0, F.concat(base, F.lit("; notes: "), F.array_join("notes", "; "))).otherwise(base)
    sure = F.when(F.when(academic, (F.size("notes") > 0) | col("route")).otherwise(col("route")), "high").otherwise("medium")
    out["requirement_type"] = (F.when(col("core"), kind), sure, "requirement_type_normalize", col("head"))
    return out


def _field(value, confidence, rule, snippet, url) -> Column:
    lit = lambda c: c if isinstance(c, Column) else F.lit(c)
    return F.struct(*[lit(c).cast("string").alias(n) for c, n in zip((value, confidence, rule, snippet, url), ("value", "confidence", "rule_id", "snippet", "source_url"), strict=True)])


def program_profiles(docs: DataFrame) -> DataFrame:
    """program_id and a struct (value, confidence, rule_id, snippet, source_url) for each of FIELDS, null where nothing was found."""
    facts = page_facts(docs)
    pages = _gates(A.settled(facts) if "institution" in docs.columns else facts)
    url, seq = F.col("url"), F.col("doc_seq")
    best = []
    for name, (value, sure, rule, shown) in _candidates().items():
        sure = sure if isinstance(sure, Column) else F.lit(sure)
        order = F.struct(X.rank(sure), F.length(value), seq, value)
        best.append(F.max_by(_field(value, sure, rule, shown, url), F.when(F.coalesce(value, F.lit("")) != "", order)).alias(name))
    held = pages.groupBy("program_id").agg(*best, *A.average_aggregates(seq), F.min_by(url, seq).alias("url"), F.min_by("head", seq).alias("head"), F.max("pathway").alias("pathway"))
    held = held.withColumn("avg", A.average_total()).withColumn("avg_total", F.when(F.col("avg").isNotNull(), _field(F.col("avg.value"), F.col("avg.confidence"), F.col("avg.rule_id"), F.col("avg.snippet"), url)))
    return _defaults(held).select("program_id", *FIELDS)


def _defaults(held: DataFrame) -> DataFrame:
    """Fields that follow from others: no assessment beside a course, diplomas, and five courses that the parts add up to."""
    given = lambda f: F.col(f).isNotNull()
    course = {s: given(f"{s}_req") & (F.coalesce(F.col(f"{s}_requirement_mode.value"), F.lit("course")) == "course") for s in ("english", "math")}
    academic = course["english"] | course["math"] | given("science_req") | given("social_req")
    flag = _field("No", "low", "math_assessment_default_no", F.col("math_req.snippet"), F.col("math_req.source_url"))
    yes = _field("Yes", "low", "hs_diploma_subject_default", F.col("requirement_type.snippet"), F.col("requirement_type.source_url"))
    no = _field("No", "medium", "hs_diploma_post_secondary_pathway", F.substring("head", 1, 220), F.col("url"))
    counted = T.count_strict(F.regexp_extract("science_req.snippet", rf"(?i)\b({_N})\s+of\b", 1))
    science = F.when(given("science_req"), F.coalesce(counted, Q.unit_count("science_req.value"))).otherwise(0)
    one = lambda test: F.when(test, 1).otherwise(0)
    electives = F.coalesce(F.col("elective_qty.value").cast("int"), F.lit(0))
    total = one(given("social_req")) + one(course["english"]) + one(course["math"]) + science + electives
    kind = F.coalesce(F.col("requirement_type.value"), F.lit(""))
    signal = ~F.contains(kind, F.lit("placement_assessment")) & (given("min_avg_final") | F.startswith(kind, F.lit("alberta_high_school_courses")))
    part = lambda f, test: F.when(test, F.concat(F.lit(f"{f}="), F.col(f"{f}.value")))
    uses = [("social_req", given("social_req")), ("english_req", course["english"]), ("math_req", course["math"]), ("science_req", given("science_req")), ("elective_qty", given("elective_qty"))]
    shown = F.concat_ws("; ", *[part(f, test) for f, test in uses])
    five = _field("5", "medium", "subject_count_inference", shown, F.coalesce(*[F.when(test, F.col(f"{f}.source_url")) for f, test in uses]))
    return held.withColumns(
        {
            "math_assessment_flag": F.coalesce("math_assessment_flag", F.when(course["math"], flag)),
            "hs_diploma_req": F.coalesce("hs_diploma_req", F.when(academic, yes).when(F.col("pathway"), no)),
            "avg_total": F.coalesce("avg_total", F.when(signal & (total == 5), five)),
        }
    )


def program_fields(docs: DataFrame) -> DataFrame:
    """program_id, field, value, confidence, rule_id, snippet, source_url: a row for each field that was found."""
    every = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("f")) for f in FIELDS])
    long = program_profiles(docs).select("program_id", F.explode(F.filter(every, lambda x: x["f"].isNotNull())).alias("x"))
    return long.select("program_id", "x.field", "x.f.*")
