"""Gates of a whole table: what would stop its release, and what a person should know before it.

Rules of rows are counted in one pass. Equal rows, keys with several payloads and rows shown twice are groups by a digest
of their fields, so tasks combine before the shuffle and a group with a third of all rows is one counter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import quality as Q

# Columns a table must have, fields of its key and of what rows of one key must agree in, fields whose blanks are watched, notes that spread.
HEADERS = (
    "institution", "program", "credential_type", "status", "program_url", "min_avg_final", "competitive_final", "avg_total", "english_requirement_mode", "elective_qty", "math_requirement_mode",
    "requirement_type", "math_assessment_flag", "display_for_high_school",
)
KEY = ("institution", "program", "credential_type", "program_url")
PAYLOAD = ("requirement_type", "min_avg_final", "elective_qty", "status")
SHOWN = ("institution", "program", "credential_type", "status")
WATCHED = ("requirement_type", "min_avg_final", "math_req", "english_req")
SPREADING = ("interview required", "portfolio required", "audition required", "casper required")
SHELL = ("requirement_type", "min_avg_final", "competitive_final", "english_req", "math_req", "social_req", "science_req", "elective_qty")
BLANK_SHARE, SPIKE_SHARE, LEAST = 0.75, 0.15, 10
_SCHEMA = "severity string, gate string, scope string, n long, share double"


def _digest(fields) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.lower(T.norm_space(f)) for f in fields]), 256)


def table_gates(df: DataFrame, most_without_url: float = 0.05) -> DataFrame:
    """severity (error, warning), gate, scope (an institution, or ''), n, share of everything that doesn't hold.

    A table without all HEADERS or without rows has only that error. URLs may be missing on a share of rows. Blank
    watched fields, spreading notes and shells are warnings by institution (of LEAST rows or more, but for shells)."""
    if missing := [h for h in HEADERS if h not in df.columns]:
        return df.sparkSession.createDataFrame([("error", "missing_headers", ", ".join(missing), len(missing), None)], _SCHEMA)
    share, no_share = F.try_divide("n", "rows"), F.lit(None).cast("double")
    rows = df.agg(F.count("*").alias("rows"), F.count_if(T.norm_space("program_url") == "").alias("n"))
    empty = rows.filter("rows = 0").select(F.lit("error").alias("severity"), F.lit("empty").alias("gate"), F.lit("").alias("scope"), F.lit(0).cast("long").alias("n"), no_share.alias("share"))
    urls = rows.filter(share > most_without_url).select(F.lit("error").alias("severity"), F.lit("url_missing").alias("gate"), F.lit("").alias("scope"), "n", share.alias("share"))

    ruled = Q.validate_rows(df.withColumn("row_id", F.lit(0))).filter("rule NOT IN ('url_missing', 'key_blank', 'english_min_not_a_number', 'english_min_range', 'math_min_not_a_number', 'math_min_range')")
    kind = F.lower(T.norm_space("requirement_type"))
    bare = T.is_blankish("min_avg_final") & T.is_blankish("avg_total")
    more = F.array(
        F.when(T.any_of([T.is_blankish(c) for c in KEY]), F.struct(F.lit("key_blank").alias("rule"), F.lit("error").alias("severity"))),
        F.when(F.startswith(kind, F.lit("course_min_only")) & Q.has_subjects() & bare, F.struct(F.lit("course_average_context").alias("rule"), F.lit("warning").alias("severity"))),
    )
    ruled = ruled.select("rule", "severity").unionByName(df.select(F.explode(F.array_compact(more)).alias("m")).select("m.*"))
    counted = ruled.groupBy("severity", "rule").agg(F.count("*").alias("n")).select("severity", F.col("rule").alias("gate"), F.lit("").alias("scope"), "n", no_share.alias("share"))

    def groups(name: str, of: DataFrame, agg: Column) -> DataFrame:
        return of.groupBy("g").agg(agg.alias("m")).filter("m > 1").agg(F.count("*").alias("n")).filter("n > 0").select(F.lit("error").alias("severity"), F.lit(name).alias("gate"), F.lit("").alias("scope"), "n", no_share.alias("share"))

    own = [c for c in df.columns if c != "row_id"]
    equal = groups("exact_duplicates", df.select(_digest(own).alias("g")), F.count("*"))
    # Distinct (key, payload) first: a key's payloads are counted, never gathered.
    payloads = groups("key_collisions", df.select(_digest(KEY).alias("g"), _digest(PAYLOAD).alias("p")).distinct(), F.count("*"))
    twice = groups("visible_duplicates", df.filter(T.norm_space("display_for_high_school") == "Yes").select(_digest(SHOWN).alias("g")), F.count("*"))

    blank = {f"blank_{f}": T.is_blankish(f) if f in df.columns else F.lit(True) for f in WATCHED}
    spikes = {f"spike_{t}": F.contains(kind, F.lit(t)) for t in SPREADING}
    shell = {"empty_shell": (T.norm_space("program_url") != "") & ~T.any_of([~T.is_blankish(c) for c in SHELL if c in df.columns])}
    tests = blank | spikes | shell
    scope = F.coalesce(F.nullif(T.norm_space("institution"), F.lit("")), F.lit("<blank>"))
    wide = df.groupBy(scope.alias("scope")).agg(F.count("*").alias("rows"), *[F.count_if(t).alias(name) for name, t in tests.items()])
    long = wide.unpivot(["scope", "rows"], list(tests), "gate", "n")
    many = F.when(F.startswith("gate", F.lit("blank_")), (F.col("rows") >= LEAST) & (share >= BLANK_SHARE)).when(F.startswith("gate", F.lit("spike_")), (F.col("n") >= LEAST) & (share >= SPIKE_SHARE)).otherwise(F.col("n") > 0)
    local = long.filter(many).select(F.lit("warning").alias("severity"), "gate", "scope", "n", share.alias("share"))
    out = empty
    for part in (urls, counted, equal, payloads, twice, local):
        out = out.unionByName(part)
    return out


def passes(found: DataFrame) -> DataFrame:
    """One row: errors, warnings, passed."""
    count = lambda s: F.count_if(F.col("severity") == s)
    return found.agg(count("error").alias("errors"), count("warning").alias("warnings")).withColumn("passed", F.col("errors") == 0)
