"""People against programs: requirement parts, marks, electives, averages, confidence.

A requirement is parts: each part needs k distinct courses out of a list, with a minimum mark. English and mathematics are an
AND of ORs (k = 1); science is "two of" or an OR. Programs with the same parts are one class, and people are
evaluated against classes, never against program rows; program columns are joined back at the end.
"""

from __future__ import annotations

from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators.electives import GROUPS, best_subset, limits_of, sets_of

# Names of courses that stand for others.
ALIASES = {
    "ENGLISH LANGUAGE ARTS 30-1": "ENGLISH 30-1", "ENGLISH LANGUAGE ARTS 30-2": "ENGLISH 30-2", "ENGLISH LANGUAGE ARTS 20-1": "ENGLISH 20-1", "ENGLISH LANGUAGE ARTS 20-2": "ENGLISH 20-2",
    "BIO 30": "BIOLOGY 30", "CHEM 30": "CHEMISTRY 30", "PHYS 30": "PHYSICS 30", "SCI 30": "SCIENCE 30",
    "MATHEMATICS 30-1": "MATH 30-1", "MATHEMATICS 30-2": "MATH 30-2", "MATHEMATICS 20-1": "MATH 20-1", "MATHEMATICS 20-2": "MATH 20-2", "MATHEMATICS 31": "MATH 31",
    "SOCIAL 30-1": "SOCIAL STUDIES 30-1", "SOCIAL 30-2": "SOCIAL STUDIES 30-2", "RECREATION LEADERSHIP (ADVANCED LEVEL CTS)": "RECREATION LEADERSHIP 30", "COMPUTING SCIENCE ADVANCED CTS": "COMPUTER SCIENCE ADVANCED CTS",
}
# Keywords of the elective groups, in the order they are tried.
GROUP_WORDS = [
    ("A", "LANGUAGE|FRANCAIS|FRENCH|SPANISH|GERMAN|JAPANESE|CHINESE|MANDARIN|CANTONESE|KOREAN|ARABIC|PUNJABI|HINDI|URDU|TAGALOG|ITALIAN|PORTUGUESE|RUSSIAN|UKRAINIAN|CREE|BLACKFOOT|LATIN|ASL|BILINGUAL|ENGLISH|SOCIAL STUDIES|HISTORY|GEOGRAPHY|PSYCHOLOGY|PHILOSOPHY|LAW|RELIGION|ABORIGINAL|NATIVE STUDIES|CANADIAN STUDIES|ECONOMICS"),
    ("C", "MATH|BIOLOGY|CHEMISTRY|PHYSICS|SCIENCE|CALCULUS|STATISTICS"),
    ("B", "ART|DRAMA|MUSIC|DANCE|PHYSICAL EDUCATION|RECREATION|COMMUNICATION TECHNOLOGY|CTS|COMPUTER SCIENCE|DESIGN STUDIES|CHORAL|INSTRUMENTAL|JAZZ"),
    ("D", "WELD|MECHANIC|CONSTRUCTION|CARPENTRY|AUTOMOTIVE|FOODS|FASHION|COSMETOLOGY|ESTHETICS|ENTERPRISE|TRADES"),
]
# Courses of each elective group by name; level 30 where no level is named.
GROUP_COURSES = {
    "A": [
        "ENGLISH 30-1", "ENGLISH 30-2", "ENGLISH 20-1", "ENGLISH 20-2", "SOCIAL STUDIES 30-1", "SOCIAL STUDIES 30-2", "SOCIAL STUDIES 20-1", "SOCIAL STUDIES 20-2", "WORLD GEOGRAPHY 30", "WORLD HISTORY 30", "HISTORY 30",
        "ABORIGINAL STUDIES 30", "CANADIAN STUDIES 30", "PSYCHOLOGY 30", "PHILOSOPHY 30", "RELIGIOUS STUDIES 30", "LAW 30", "ECONOMICS 30", "AMERICAN SIGN LANGUAGE AND DEAF CULTURE 35", "FRENCH LANGUAGE ARTS 30-1", "FRENCH LANGUAGE ARTS 30-2",
        "LATIN 30", "FRENCH 30", "FRANCAIS 30", "SPANISH 30", "GERMAN 30", "CHINESE 30", "JAPANESE 30",
        *[f"{n} LANGUAGE AND CULTURE 30" for n in ("ARABIC", "BLACKFOOT", "CHINESE", "CREE", "GERMAN", "ITALIAN", "JAPANESE", "KOREAN", "LATIN", "PUNJABI", "RUSSIAN", "SPANISH", "UKRAINIAN")],
        *[f"{n} LANGUAGE AND CULTURE 35" for n in ("ARABIC", "CHINESE", "GERMAN", "ITALIAN", "JAPANESE", "SPANISH")],
    ],
    "B": [
        "COMPUTER SCIENCE ADVANCED CTS", "COMPUTING SCIENCE ADVANCED CTS", "ART 30", "ART 31", "DRAMA 30", "CHORAL MUSIC 30", "INSTRUMENTAL MUSIC 30", "GENERAL MUSIC 30", "JAZZ 30", "MUSIC 30", "DANCE 35", "PHYSICAL EDUCATION 30",
        "RECREATION LEADERSHIP 30", "COMMUNICATION TECHNOLOGY ADVANCED CTS", "DESIGN STUDIES 30",
    ],
    "C": [
        "MATH 30-1", "MATH 30-2", "MATH 20-1", "MATH 20-2", "MATH 31", "BIOLOGY 30", "BIOLOGY 20", "CHEMISTRY 30", "CHEMISTRY 20", "PHYSICS 30", "PHYSICS 20", "SCIENCE 30", "SCIENCE 20", "CALCULUS 31",
        "COMPUTER SCIENCE ADVANCED CTS", "COMPUTING SCIENCE ADVANCED CTS",
    ],
    "D": [
        f"{n} 30" for n in (
            "ACCOUNTING", "AGRICULTURE", "AVIATION", "AUTOMOTIVE SERVICE TECHNICIAN", "BROADCASTING", "CARPENTRY", "CHILD DEVELOPMENT", "COMMUNITY HEALTH", "CONSTRUCTION", "COSMETOLOGY", "DRAFTING", "EARLY LEARNING AND CHILD CARE",
            "ELECTRO-TECHNOLOGIES", "ENERGY AND MINES", "ENTREPRENEURSHIP", "ESTHETICS", "FABRICATION", "FASHION STUDIES", "FINANCIAL MANAGEMENT", "FOOD STUDIES", "FOODS", "FORESTRY", "HEALTH CARE AIDE", "HEAVY EQUIPMENT", "HORTICULTURE",
            "MARKETING", "MECHANICS", "MULTIMEDIA", "NETWORK SYSTEMS", "OUTDOOR PURSUITS", "PHOTOGRAPHY", "PLUMBING", "ROBOTICS", "TOURISM", "WORKPLACE SAFETY", "WELDING",
        )
    ],
}
# Fixed value: senior courses that are no elective of group D.
NOT_IN_D = r"RAP|REGISTERED APPRENTICESHIP|WORK EXPERIENCE|GREEN CERTIFICATE|SPECIAL PROJECT|K AND E|KNOWLEDGE AND EMPLOYABILITY|LOCALLY DEVELOPED|LDC|\bCALM\b"
EXACT_GROUPS = {c: [g for g, held in GROUP_COURSES.items() if c in held] for own in GROUP_COURSES.values() for c in own}


def _mapped(key: Column, table: dict) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v))]
    return F.element_at(F.create_map(*pairs), key)


def canonical_course(c: Column | str) -> Column:
    key = T.course_key(c)
    return F.coalesce(_mapped(key, ALIASES), key)


def course_marks(marks: DataFrame) -> DataFrame:
    """student_id, course_key, mark: the last finite mark of each course."""
    held = marks.select("student_id", canonical_course("course").alias("course_key"), "mark", "seq").filter("course_key <> '' AND mark IS NOT NULL AND NOT isnan(mark)")
    return held.groupBy("student_id", "course_key").agg(F.max_by("mark", "seq").alias("mark"))


def equivalencies() -> list[tuple[str, str, int]]:
    """(required, accepted, order): itself; stream 1 for stream 2; level 30 for level 20."""
    out = []
    for subject, level, stream in product(("English", "Math", "Social Studies"), (20, 30), (1, 2)):
        accepted = [(level, stream)] + ([(level, 1)] if stream == 2 else []) + ([(30, stream)] if level == 20 else []) + ([(30, 1)] if level == 20 and stream == 2 else [])
        own = f"{subject} {level}-{stream}".upper()
        out += [(own, f"{subject} {a}-{b}".upper(), i) for i, (a, b) in enumerate(dict.fromkeys(accepted))]
    return out


def accepted_keys(course: Column) -> Column:
    """The canonical keys that a required course accepts, in order."""
    table: dict[str, list[str]] = {}
    for required, accepted, _ in equivalencies():
        table.setdefault(required, []).append(accepted)
    key = canonical_course(course)
    return F.coalesce(_mapped(key, table), F.array(key))


def alternatives(subject: str, text: Column) -> Column:
    """Courses of an OR list: codes with the subject's name, else the parts between 'or'; Math 31 has no dash."""
    name = {"english": "English ", "math": "Math ", "social": "Social Studies "}.get(subject, "")
    codes = lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"\b(\d{2}-[12])\b"), F.lit(1)), lambda c: F.concat(F.lit(name), c))
    parts = lambda t: F.filter(F.split(t, r"(?i)\s+or\s+"), lambda p: p != "")
    listed = lambda t: T.let(codes(t), lambda c: F.when(F.size(c) > 0, c).otherwise(parts(t)))

    def with_31(t: Column, held: Column) -> Column:
        lacks = t.rlike(r"(?i)(math|mathematics)\s*31\b") & ~F.array_contains(held, "Math 31")
        others = F.filter(held, lambda p: ~p.rlike(r"(?i)^(math|mathematics)\s*31$"))
        return F.transform(F.when(lacks, F.concat(others, F.array(F.lit("Math 31")))).otherwise(held), lambda p: F.when(p == "31", "Math 31").otherwise(p))

    both = (lambda t: T.let(listed(t), lambda held: with_31(t, held))) if subject == "math" else listed
    return F.array_distinct(T.let(T.norm_space(F.regexp_replace(text, "/", " or ")), both))


def subject_kind(text: Column, mode: Column) -> Column:
    t = T.norm_space(text)
    return (
        F.when(t == "", "none").when(t.rlike("(?i)^(See Degree|Refer to Degree)$"), "unknown").when(mode == "placement_assessment", "assessment").when(mode.isin("elp", "other_gate"), "unknown")
        .when(t.rlike("(?i)placement|assessment|test"), "assessment").when(t.rlike(r"(?i)english language proficiency|\bunspecified\b"), "unknown").otherwise("parts")
    )


def science_parts(text: Column) -> Column:
    """array of (k, courses)."""
    t = T.norm_space(text)
    two = t.rlike(r"(?i)^(Two|2)\s+of\b")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"(?i)^(Two|2)\s+of\b", ""), ";", ","), r"(?i)\s+or\s+", ",")
    listed = F.array_distinct(F.filter(F.transform(F.split(rest, ","), lambda p: F.trim(p)), lambda p: p != ""))
    return F.array(F.struct(F.when(two, 2).otherwise(1).alias("k"), listed.alias("courses")))


def requirement_parts(programs: DataFrame) -> DataFrame:
    """row_id, subject, kind, part_no, k, courses, min_mark: one row per part; one without courses for other kinds."""
    rows = []
    for subject in ("english", "math"):
        mode = T.requirement_mode(subject, f"{subject}_req", f"{subject}_requirement_mode")
        text = T.norm_space(f"{subject}_req")
        parts = F.transform(F.filter(F.split(text, r"(?i)\s+and\s+"), lambda p: p != ""), lambda p: F.struct(F.lit(1).alias("k"), alternatives(subject, p).alias("courses")))
        rows.append(programs.select("row_id", F.lit(subject).alias("subject"), subject_kind(text, mode).alias("kind"), T.to_number(f"{subject}_min").alias("min_mark"), parts.alias("parts")))
    text = T.norm_space("science_req")
    kind = F.when(text == "", "none").when(text.rlike("(?i)^(See Degree|Refer to Degree)$"), "unknown").otherwise("parts")
    rows.append(programs.select("row_id", F.lit("science").alias("subject"), kind.alias("kind"), F.lit(None).cast("double").alias("min_mark"), science_parts(text).alias("parts")))
    every = rows[0].unionByName(rows[1]).unionByName(rows[2])
    held = F.when(F.col("kind") == "parts", F.col("parts")).otherwise(F.array(F.struct(F.lit(0).alias("k"), F.array().cast("array<string>").alias("courses"))))
    long = every.select("row_id", "subject", "kind", F.when(F.col("min_mark") > 0, F.col("min_mark")).alias("min_mark"), F.posexplode(held).alias("part_no", "p"))
    return long.select("row_id", "subject", "kind", "part_no", "p.k", "p.courses", "min_mark")


def best_marks(parts: DataFrame, marks: DataFrame) -> DataFrame:
    """student_id, part, course, mark: the best mark of each required course of parts (part, courses) that a student has."""
    long = parts.select("part", F.explode("courses").alias("course")).distinct()
    keys = long.select("part", "course", F.explode(accepted_keys(F.col("course"))).alias("course_key"))
    return keys.join(marks, "course_key").groupBy("student_id", "part", "course").agg(F.max("mark").alias("mark"))


def class_parts(programs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes (class_id, gate, n_parts, parts, programs) and their distinct parts (part, k, courses, min_mark)."""
    keyed = requirement_parts(programs).withColumn("part", F.when(F.col("kind") == "parts", F.xxhash64("k", "courses", "min_mark")))
    own = keyed.groupBy("row_id").agg(F.array_sort(F.array_distinct(F.array_compact(F.collect_list("part")))).alias("parts"), F.max(F.col("kind").isin("unknown", "assessment")).alias("gate"))
    classes = own.groupBy("parts", "gate").agg(F.count("*").alias("programs")).withColumns({"class_id": F.xxhash64("parts", "gate"), "n_parts": F.size("parts")})
    return classes, keyed.filter("part IS NOT NULL").select("part", "k", "courses", "min_mark").dropDuplicates(["part"])


def class_hits(programs: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of class_parts and hits (student_id, class_id, met).

    A class is the set of its parts and counts its programs. Only its parts are joined with marks, each distinct part
    once a student; a student and a class that share no part make no row.
    """
    classes, distinct = class_parts(programs)
    scored = best_marks(distinct, marks).join(distinct.select("part", "k", "min_mark"), "part")
    enough = F.count_if(F.col("min_mark").isNull() | (F.col("mark") >= F.col("min_mark"))) >= F.first("k")
    met = scored.groupBy("student_id", "part").agg(enough.alias("ok")).filter("ok").select("student_id", "part")
    hits = classes.select("class_id", F.explode("parts").alias("part")).join(met, "part").groupBy("student_id", "class_id").agg(F.count("*").alias("met"))
    return classes, hits


def students_with_marks(marks: DataFrame) -> DataFrame:
    """student_id, marks (a map by course key) of course_marks, spread over tasks: few bytes each, but much work follows."""
    held = marks.groupBy("student_id").agg(F.map_from_entries(F.collect_list(F.struct("course_key", "mark"))).alias("marks"))
    return spread(held)


def spread(students: DataFrame) -> DataFrame:
    """students over as many tasks as a shuffle has, or as four rounds of all cores, whatever their bytes are."""
    spark = students.sparkSession
    return students.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), "student_id")


#: Classes up to this number are sent to every task.
CLASSES = 200_000


def to_every(students: DataFrame, classes: DataFrame) -> DataFrame:
    """Each student with each class, where the students are. The classes are counted before they are sent to all tasks;
    above CLASSES Spark reads them again for each part of the students, with nothing held but a part of either."""
    return students.join(F.broadcast(classes) if classes.count() <= CLASSES else classes)


def evaluate(programs: DataFrame, marks: DataFrame) -> DataFrame:
    """student_id, class_id, n_parts, met, status for every student and requirement class: their product, asked for as rows.

    A student carries marks and then the parts that are met; classes come to the students, so no pair is ever shuffled."""
    classes, distinct = class_parts(programs)
    accepts = F.transform("courses", accepted_keys).alias("accepts")
    listed = distinct.agg(F.collect_list(F.struct("part", "k", "min_mark", accepts)).alias("listed"))
    reached = lambda p: F.filter(p["accepts"], lambda keys: F.exists(keys, lambda key: F.coalesce(F.col("marks")[key] >= F.coalesce(p["min_mark"], F.col("marks")[key]), F.lit(False))))
    met = F.transform(F.filter("listed", lambda p: F.size(reached(p)) >= p["k"]), lambda p: p["part"])
    students = students_with_marks(marks).join(F.broadcast(listed)).select("student_id", met.alias("held"))
    out = to_every(students, classes.select("class_id", "gate", "n_parts", "parts")).withColumn("met", F.size(F.array_intersect("parts", "held")).cast("long"))
    status = F.when(F.col("met") < F.col("n_parts"), "ineligible").when(F.col("gate") | (F.col("n_parts") == 0), "uncheckable").otherwise("likely eligible")
    return out.select("student_id", "class_id", "n_parts", "met", status.alias("status"))


def evaluate_summary(programs: DataFrame, marks: DataFrame, count: str = "programs") -> DataFrame:
    """student_id, status, n: how many classes, or programs, a student is eligible for; without a row per pair.

    Classes that a student meets whole come from hits; those that ask nothing are alike for all, and the rest of the
    total is ineligible. So the work grows with hits, not with students times classes."""
    classes, hits = class_hits(programs, marks)
    weight = F.lit(1) if count == "classes" else F.col("programs")
    classes = classes.withColumn("weight", weight.cast("long"))
    total, free = classes.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("n_parts") == 0, F.col("weight"))), F.lit(0))).first()
    whole = hits.join(classes.select("class_id", "gate", "n_parts", "weight"), "class_id").filter("met = n_parts")
    own = whole.groupBy("student_id").agg(F.sum(F.when(~F.col("gate"), F.col("weight")).otherwise(0)).alias("yes"), F.sum(F.when(F.col("gate"), F.col("weight")).otherwise(0)).alias("unsure"))
    held = marks.select("student_id").distinct().join(own, "student_id", "left").fillna(0, ["yes", "unsure"])
    told = F.array(*[F.struct(F.lit(s).alias("status"), n.alias("n")) for s, n in (("likely eligible", F.col("yes")), ("uncheckable", F.col("unsure") + free), ("ineligible", F.lit(total - free) - F.col("yes") - F.col("unsure")))])
    return held.select("student_id", F.explode(F.filter(told, lambda x: x["n"] > 0)).alias("x")).select("student_id", "x.status", "x.n")


def program_classes(programs: DataFrame) -> DataFrame:
    """row_id, class_id: joins results back to programs."""
    keyed = requirement_parts(programs).withColumn("part", F.when(F.col("kind") == "parts", F.xxhash64("k", "courses", "min_mark")))
    held = keyed.groupBy("row_id").agg(F.array_sort(F.array_distinct(F.array_compact(F.collect_list("part")))).alias("parts"), F.max(F.col("kind").isin("unknown", "assessment")).alias("gate"))
    return held.select("row_id", F.xxhash64("parts", "gate").alias("class_id"))


def elective_groups(key: Column) -> Column:
    """Groups of a course by exact key, else by keywords, else D for a senior level that is not left out."""
    words = F.array_compact(F.array(*[F.when(key.rlike(w), g) for g, w in GROUP_WORDS]))
    senior = F.when(key.rlike(r"\b31\b|\b(30|35)(-[0-9A-Z]+)?\b") & ~key.rlike(NOT_IN_D), F.array(F.lit("D"))).otherwise(F.array().cast("array<string>"))
    return F.coalesce(_mapped(key, EXACT_GROUPS), F.when(F.size(words) > 0, words).otherwise(senior))


def elective_candidates(marks: DataFrame) -> DataFrame:
    """student_id, course_key, groups, mark."""
    return marks.select("student_id", "course_key", elective_groups(F.col("course_key")).alias("groups"), "mark").filter(F.size("groups") > 0)


def allowed_groups(pool: Column | str) -> Column:
    found = F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce(T.col(pool), F.lit(""))), F.lit(r"\b([ABCD])\b"), F.lit(1)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, GROUPS)))


def average_total(total: Column, electives: Column, slots: Column, rule: Column, institution: Column, minimum: Column, fallback: int = 5, five: tuple[str, ...] = ()) -> Column:
    """Courses in the average: from the data, slots and electives, a rule, an institution's default, the fallback, else 0."""
    return (
        F.when(total > 0, F.round(total).cast("int")).when(electives.isNotNull(), F.greatest(F.lit(0), slots + electives).cast("int")).when(rule.isNotNull(), rule.cast("int"))
        .when(minimum.isNotNull() & (F.upper(F.trim(institution)).isin(*five) if five else F.lit(False)), 5).when(minimum.isNotNull(), fallback).otherwise(0)
    )


def select_electives(cands: DataFrame, by: list[str]) -> DataFrame:
    """The best sum of at most ``need`` electives per group of ``by``: by, n_chosen, total.

    cands: by, course_key, groups (array), mark, need, caps (array of four, null: none), sets (array of (n, groups): at least
    n out of those groups together; null: none) and least (the mark each needs; null: none). As many as possible up to
    need under the rules, then the best sum; if no choice fits them, the same without caps and sets. A course in several
    groups counts for one of them, whichever is best.
    """
    unit = F.when(F.col("least").isNull() | (F.col("mark") >= F.col("least")), F.struct("groups", "mark"))
    held = cands.groupBy(*by).agg(F.collect_list(unit).alias("units"), *[F.first(c).alias(c) for c in ("need", "caps", "sets")])

    @F.pandas_udf("struct<n:int,total:double>")
    def best(units: pd.Series, need: pd.Series, caps: pd.Series, sets: pd.Series) -> pd.DataFrame:
        rows = []
        for us, n, cs, ss in zip(units, need, caps, sets, strict=True):
            chosen = best_subset([(tuple(u["groups"]), u["mark"]) for u in us], int(n), limits_of(cs), list(sets_of(ss)))
            rows.append((len(chosen), float(sum(us[i]["mark"] for i, _ in chosen))))
        return pd.DataFrame(rows, columns=["n", "total"])

    picked = held.withColumn("pick", best("units", "need", "caps", "sets"))
    return picked.select(*by, F.col("pick.n").alias("n_chosen"), F.col("pick.total").alias("total"))


def confidence(df: DataFrame, stale: Column) -> DataFrame:
    """row_id, confidence, why of programs: Uncheckable for placement, no requirement or a reference elsewhere, else 3 minus penalties."""
    kind, url = T.norm_space("requirement_type"), T.is_http_url("program_url")
    placement = kind.rlike(r"(?i)^placement_assessment(\b|;)|\b(placement\s+(assessment|test)|assessment/placement|accuplacer)\b")
    structured = T.to_number("min_avg_final").isNotNull() | T.any_of([T.norm_space(c) != "" for c in ("english_req", "math_req", "social_req", "science_req", "elective_qty")])
    ambiguous = T.any_of([T.norm_space(c).rlike(r"(?i)\b(see|refer to)\s+degree\b") for c in ("requirement_type", "english_req", "math_req", "social_req", "science_req", "elective_qty")])
    manual = kind.rlike("(?i)audition|portfolio|casper|interview|questionnaire")
    loose = T.any_of([T.norm_space(c).rlike("(?i)language proficiency|unspecified") for c in ("english_req", "math_req")])
    score = F.when(url, 3).otherwise(1) - F.when(manual, 1).otherwise(0) - F.when(loose, 2).otherwise(0)
    level = F.when(score >= 3, 3).when(score >= 2, 2).otherwise(1)
    level = F.least(level, F.when(url, 3).otherwise(1), F.when(stale, 2).otherwise(3))
    why = F.array_compact(F.array(F.when(~url, "Source link missing."), F.when(manual, "Manual review needed."), F.when(loose, "Some text is not checkable."), F.when(stale, "Data is old.")))
    out = F.when(placement | ~structured | ambiguous, "Uncheckable").otherwise(F.element_at(F.array(F.lit("Low"), F.lit("Medium"), F.lit("High")), level))
    most = F.when(out == "Medium", 1).when(out == "Low", 3).otherwise(0)
    return df.select("row_id", out.alias("confidence"), F.array_join(F.slice(why, F.lit(1), most), " | ").alias("why"))
