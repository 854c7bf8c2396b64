"""Composed stages: overrides by row, evaluation results with messages, rebuilds from seeds, gates of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import extract as X
from sievework.operators.fuzzy import best_fuzzy_match


def apply_overrides(df: DataFrame, overrides: DataFrame, fields: list[str]) -> DataFrame:
    """df with the non-blank fields of the override of each row (row_id, the fields, program_url); a URL only where the row has no http URL."""
    held = df.join(overrides.select("row_id", *[T.norm_or_blank(f).alias(f"o_{f}") for f in [*fields, "program_url"]]), "row_id", "left")
    pick = lambda f: F.when(F.coalesce(f"o_{f}", F.lit("")) != "", F.col(f"o_{f}")).otherwise(F.col(f))
    url = F.when(~T.is_http_url("program_url") & T.is_http_url("o_program_url"), F.col("o_program_url")).otherwise(F.col("program_url"))
    return held.select(*[url.alias(c) if c == "program_url" else pick(c).alias(c) if c in fields else F.col(c) for c in df.columns])


def rebuild_from_seed(seeds: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per seed: the fields of its fuzzy match, or a placeholder; never a seed lost or doubled."""
    tokens = lambda d, n: d.select(F.col(d.columns[0]).alias("id"), F.col("institution").alias("block"), T.program_tokens(n).alias("tokens"), T.name_key(n).alias("name"), T.url_key("program_url" if "program_url" in d.columns else "source_url").alias("url"))
    match = best_fuzzy_match(tokens(seeds, "program_name"), tokens(rows, "program"), 0.55, 0.08, "distinct_name")
    held = seeds.join(match, F.col("seq") == F.col("left_id"), "left").join(rows.select(F.col("row_id").alias("right_id"), "requirement_type", "min_avg_final"), "right_id", "left")
    return held.select("seq", "institution", "program_name", "source_url", "status", F.coalesce("requirement_type", F.lit("")).alias("requirement_type"), F.coalesce("min_avg_final", F.lit("")).alias("min_avg_final"))


def snapshot_result(missing: Column, confidence: Column) -> Column:
    return F.when(confidence == "Uncheckable", "Uncheckable").when(missing > 0, "Likely ineligible").otherwise("Likely eligible")


def average_messages(df: DataFrame, total: int) -> DataFrame:
    """key columns and reasons of rows (minimum, used, average): incomplete, too low; compares the unrounded average."""
    short, low = F.col("used") < total, F.col("average") < F.col("minimum")
    reasons = F.array_compact(
        F.array(
            F.when(short, F.concat(F.lit(f"Average incomplete (need {total} marks; have "), F.col("used").cast("string"), F.lit(")"))),
            F.when(~short & low, F.concat(F.lit("Admission average too low ("), F.format_number("average", 1), F.lit(" < "), F.col("minimum").cast("int").cast("string"), F.lit(")"))),
        )
    )
    return df.withColumn("reasons", F.array_join(reasons, "; "))


def gates(docs: DataFrame) -> DataFrame:
    """doc_id and the gates of a page: language proficiency, mathematics placement, assessment."""
    t = T.norm_space("text")
    near = ~X.broad_source(F.col("url"))
    assess = r"\b(?:placement\s+test|placement\s+assessment|academic\s+assessment|accuplacer|math\s+assessment)\b"
    context = r"\b(?:academic\s+requirements?|admission|admissions|applicant|applicants|application|may\s+meet|can\s+meet|meet\s+their|free\s+assessment|accuplacer|placement\s+assessment|math\s+assessment)\b"
    first = rf"\bmathematics?\b[^.;\n]{{0,80}}{assess}"
    other = rf"{assess}[^.;\n]{{0,80}}\bmathematics?\b"
    math = (X.found(t, first) & X.found(X.snippet(t, first, 140), context)) | (X.found(t, other) & X.found(X.snippet(t, other, 140), context))
    language = X.found(t, r"\blanguage\s+proficiency\b") & X.found(X.snippet(t, r"\blanguage\s+proficiency\b", 140), X.ELP_CONTEXT)
    pathway = X.found(t, X.PATHWAY)
    school = T.any_of([X.found(t, p) for p, _ in [*X.ENGLISH, *X.MATH, *X.SCIENCE]])
    return docs.select("doc_id", (near & language & ~(pathway & ~school)).alias("language_gate"), (near & math).alias("math_gate"), (near & X.local_note(t, assess, context)).alias("assessment"))
