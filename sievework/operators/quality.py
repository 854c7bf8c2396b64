"""Quality rules, review reasons and merge rules over the canonical table: one pass, no join, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as T

NUMBERS = ("min_avg_final", "english_min", "math_min")
# Words of a flag that isn't set, phrases that point to another page's requirements, forms of a requirement type.
UNSET = ("", "no", "n", "false", "0", "none", "unknown")
ELSEWHERE = ("see degree", "refer to degree", "see program", "refer to program", "see faculty")
FORMS = ("alberta_high_school_courses", "course_min_only", "placement_assessment", "post_secondary_pathway", "regular_admission", "first_year_admission")


def has_course(subject: str) -> Column:
    return (T.requirement_mode(subject, f"{subject}_req", f"{subject}_requirement_mode") == "course") & ~T.is_blankish(f"{subject}_req")


def has_subjects() -> Column:
    return has_course("english") | has_course("math") | ~T.is_blankish("social_req") | ~T.is_blankish("science_req")


def validate_rows(df: DataFrame) -> DataFrame:
    """row_id, rule, severity of every rule that a row breaks."""
    kind = F.lower(T.norm_space("requirement_type"))
    rules = [
        ("url_missing", "warning", T.norm_space("program_url") == ""), ("url_not_http", "error", (T.norm_space("program_url") != "") & ~T.is_http_url("program_url")),
        ("key_blank", "error", T.any_of([T.is_blankish(c) for c in ("institution", "program", "credential_type")])),
        ("display_value", "error", ~T.norm_space("display_for_high_school").isin("Yes", "No")),
        ("competitive_polluted", "error", T.is_competitive_polluted("competitive_final")),
        ("assessment_type_mismatch", "error", (F.lower(T.norm_space("math_assessment_flag")) == "yes") & (kind != "") & ~F.startswith(kind, F.lit("placement_assessment")) & ~has_subjects() & T.is_blankish("min_avg_final") & T.is_blankish("avg_total")),
        ("placement_with_avg_total", "error", F.startswith(kind, F.lit("placement_assessment")) & ~T.is_blankish("avg_total")),
        ("avg_total_without_minimum", "warning", F.startswith(kind, F.lit("alberta_high_school_courses")) & ~T.is_blankish("avg_total") & T.is_blankish("min_avg_final")),
        ("avg_total_range", "error", (T.norm_space("avg_total") != "") & T.to_number("avg_total").isNotNull() & ~((T.to_number("avg_total") > 0) & (T.to_number("avg_total") <= 10))),
        ("avg_total_suspicious", "warning", (T.to_number("avg_total") > 5) & (T.to_number("avg_total") <= 10)),
    ]
    for c in NUMBERS:
        rules.append((f"{c}_not_a_number", "error", (T.norm_space(c) != "") & T.to_number(c).isNull()))
        rules.append((f"{c}_range", "error", ~T.to_number(c).between(0, 100)))
    for s in ("english", "math"):
        explicit, req = F.lower(T.norm_space(f"{s}_requirement_mode")), f"{s}_req"
        mode, like = T.requirement_mode(s, req, f"{s}_requirement_mode"), T.is_course_like(s, req)
        gate = F.lower(T.norm_space(req)).rlike("placement|assessment|accuplacer|language proficiency")
        rules.append((f"{s}_mode_invalid", "error", (explicit != "") & ~explicit.isin(*T.MODES)))
        rules.append((f"{s}_mode_conflict", "error", ((explicit == "") | explicit.isin(*T.MODES)) & (T.norm_space(req) != "") & ((mode.isin("placement_assessment", "elp", "other_gate") & like) | ((mode == "course") & gate))))
    hits = F.array(*[F.when(test, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))) for rule, severity, test in rules])
    return df.select("row_id", F.explode(F.array_compact(hits)).alias("h")).select("row_id", "h.*")


def review_queue(df: DataFrame, backfilled: tuple[str, ...] = ("NorQuest",), dumping: tuple[str, ...] = ("UAlberta",)) -> DataFrame:
    """row_id, reason_codes (sorted, joined by a bar) of rows that a person should look at: twelve reasons. Institutions
    whose credentials are backfilled from seeds lack one or a status; those that dump notes have some without a form."""
    kind = F.lower(T.norm_space("requirement_type"))
    starts = lambda p: F.startswith(kind, F.lit(p))
    signal = T.any_of([~T.is_blankish(c) for c in ("min_avg_final", "competitive_final", "avg_total", "english_req", "math_req", "social_req", "science_req", "elective_qty", "requirement_type", "hs_diploma_req")])
    direct = T.norm_space("credential_type").isin("Degree", "Diploma", "Certificate")
    no_average = T.is_blankish("min_avg_final") & T.is_blankish("avg_total")
    placement = ~F.lower(T.norm_space("math_assessment_flag")).isin(*UNSET) | starts("placement_assessment")
    of = lambda names: T.norm_space("institution").isin(*names)
    reasons = [
        ("empty_shell", direct & T.is_http_url("program_url") & T.is_blankish("requirement_type") & ~signal),
        ("unknown_requirement_type", T.is_http_url("program_url") & T.is_blankish("requirement_type") & signal),
        ("missing_subject_requirements", starts("alberta_high_school_courses") & ~has_subjects() & ~no_average),
        ("placement_review", placement & (~has_subjects() | (T.is_blankish("min_avg_final") & T.is_blankish("english_req") & T.is_blankish("math_req")))),
        ("placement_avg_total_conflict", starts("placement_assessment") & ~T.is_blankish("avg_total")),
        ("avg_total_suspicious", T.to_number("avg_total") > 5),
        ("avg_total_without_min", starts("alberta_high_school_courses") & ~T.is_blankish("avg_total") & T.is_blankish("min_avg_final")),
        ("course_average_context", starts("course_min_only") & has_subjects() & no_average),
        ("post_secondary_mixed_signal", starts("post_secondary_pathway") & has_subjects()),
        ("inheritance_placeholder", T.any_of([F.contains(kind, F.lit(p)) for p in ELSEWHERE])),
        ("credential_backfill", of(backfilled) & (T.is_blankish("credential_type") | T.is_blankish("status"))),
        ("note_dump", of(dumping) & (F.contains(kind, F.lit("notes: notes:")) | (F.contains(kind, F.lit("notes:")) & ~T.any_of([starts(p) for p in FORMS])))),
    ]
    codes = F.array_sort(F.array_compact(F.array(*[F.when(test, code) for code, test in reasons])))
    return df.select("row_id", F.array_join(codes, "|").alias("reason_codes")).filter("reason_codes <> ''")


def normalise_requirement_type(df: DataFrame, value: Column | str = "requirement_type") -> Column:
    """The requirement type as a token with notes, from the text and from what the other columns say."""
    text = F.trim(F.regexp_replace(T.norm_space(value), r"(?i);\s*notes:\s*notes:\s*", "; notes: "))
    low = F.lower(text)
    course = lambda s: (T.requirement_mode(s, f"{s}_req", f"{s}_requirement_mode") == "course") & (T.norm_space(f"{s}_req") != "")
    subject = course("english") | course("math") | T.any_of([T.norm_space(c) != "" for c in ("social_req", "science_req", "min_avg_final", "elective_qty")])
    minimum = T.any_of([T.norm_space(c) != "" for c in ("english_min", "math_min", "social_min", "science_min") if c in df.columns])
    average = (T.norm_space("min_avg_final") != "") | (T.norm_space("avg_total") != "")
    academic, assessed = subject | average, F.lower(T.norm_space("math_assessment_flag")) == "yes"
    token = F.when(~average & minimum, "course_min_only").otherwise("alberta_high_school_courses")
    at = F.locate("; notes:", low)
    suffix = F.when(at > 0, F.substring(text, at, F.length(text))).otherwise("")
    noted = lambda base: F.concat(base if isinstance(base, Column) else F.lit(base), F.lit("; notes: "), text)
    blank = (text == "") | (low == "unknown")
    starts = F.startswith(low, F.lit("placement_assessment"))
    return (
        F.when(blank & assessed & ~academic, "placement_assessment").when(blank & subject, token).when(blank, text)
        .when(assessed & ~starts & academic, F.concat(token, suffix)).when(assessed & ~starts, F.concat(F.lit("placement_assessment"), suffix))
        .when(academic & starts, F.concat(token, suffix))
        .when(low.rlike("^(alberta_high_school_courses|course_min_only|placement_assessment|post_secondary_pathway|regular_admission|first_year_admission)(;|$)"), text)
        .when(low.rlike("placement|assessment|accuplacer|casper"), F.when(academic, noted("alberta_high_school_courses")).otherwise(noted("placement_assessment")))
        .when(low.rlike("regular admission"), noted("regular_admission"))
        .when(subject | low.rlike("see degree|refer to degree|group [abcd]|english 30|mathematics 30|biology 30|chemistry 30|physics 30|science 30|social studies 30"), noted("alberta_high_school_courses"))
        .otherwise(text)
    )


def unit_count(c: Column | str) -> Column:
    """Courses that a requirement text implies: 'n of', one for 'or', the named courses of a list, else one."""
    t = T.norm_space(c)
    of = F.regexp_extract(t, r"(?i)\b(one|two|three|four|five|six|seven|eight|nine|ten|[0-9]+)\s+of\b", 1)
    parts = F.array_distinct(F.filter(F.split(t, r"\s*,\s*|\s+and\s+"), lambda p: p.rlike(r"(?i)\b(english|ela|math|mathematics|social|aboriginal|biology|chemistry|physics|science|physical education|recreation)\b")))
    return F.when(t == "", 0).when(of != "", T.count_any(of)).when(t.rlike(r"(?i)\bor\b"), 1).when(F.size(parts).between(2, 6), F.size(parts)).otherwise(1)


def infer_average_total() -> Column:
    """'5' where the parts of a row sum to exactly five and the row speaks of an average; else ''."""
    kind = F.lower(T.norm_space("requirement_type"))
    course = lambda s: F.when((T.requirement_mode(s, f"{s}_req", f"{s}_requirement_mode") == "course") & (T.norm_space(f"{s}_req") != ""), 1).otherwise(0)
    n = course("english") + course("math") + F.when(T.norm_space("social_req") != "", 1).otherwise(0) + unit_count("science_req") + T.count_any("elective_qty")
    signal = (T.norm_space("min_avg_final") != "") | F.startswith(kind, F.lit("alberta_high_school_courses"))
    return F.when(~F.contains(kind, F.lit("placement_assessment")) & signal & (n == 5), "5").otherwise("")


def display_flag() -> Column:
    """Whether a row is shown to high-school users."""
    kind, cred = F.lower(T.norm_space("requirement_type")), F.lower(T.norm_space("credential_type"))
    em, mm = (T.requirement_mode(s, f"{s}_req", f"{s}_requirement_mode") for s in ("english", "math"))
    academic = has_text_course("english") | has_text_course("math") | (T.norm_space("social_req") != "") | (T.norm_space("science_req") != "") | kind.rlike("^(alberta_high_school_courses|course_min_only)")
    average = (T.norm_space("min_avg_final") != "") | (T.norm_space("avg_total") != "")
    gate = (F.lower(T.norm_space("english_requirement_mode")) == "elp") | F.lower(T.norm_space("math_requirement_mode")).isin("placement_assessment", "other_gate") | kind.rlike("^placement_assessment")
    no = (F.lower(T.norm_space("hs_diploma_req")) == "no") | kind.rlike("^post_secondary_pathway") | ((cred == "other") & ~academic) | (~academic & (average | gate))
    return F.when(no, "No").otherwise("Yes")


def has_text_course(subject: str) -> Column:
    return (T.requirement_mode(subject, f"{subject}_req", f"{subject}_requirement_mode") == "course") & (T.norm_space(f"{subject}_req") != "")
