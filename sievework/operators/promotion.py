"""Two runs of an extraction side by side, the gate between them, and taking a run's values into the table.

Keys of programs are white-space and case blind. Look-ups go by tiers in one join: both sides give a row per tier, the
right side is folded to one row per (tier, key) before it, so a key that many rows share adds one row to each left row.
Values stay in arrays over FIELDS until a change is known; orders (which candidate comes first) are windows over
(row, field), never a group in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import text as T

# Fields of a run, names that stand for them, field of an issue type, states, reasons of drops, what a regression says.
FIELDS = (
    "min_avg_final", "competitive_final", "competitive_floor_numeric", "avg_total", "english_req", "english_min", "math_req", "math_min",
    "social_req", "social_min", "science_req", "science_min", "elective_qty", "elective_pool", "requirement_type",
)
APPLIED = tuple(f for f in FIELDS if f != "competitive_floor_numeric")
FIELD_NAMES = {"minimum_average": "min_avg_final", "minimum_avg": "min_avg_final", "competitive_guidance": "competitive_final"}
APPLIED_NAMES = FIELD_NAMES | {"min_average": "min_avg_final"}
OF_TYPE = {"min_average": "min_avg_final", "competitive_guidance": "competitive_final", "avg_total": "avg_total", "required_course": "english_req", "irrelevant_program": "irrelevant_program"}
CLOSED = ("closed", "done", "resolved", "ignore", "ignored")
IRRELEVANT = ("dropped_evidence_non_program", "dropped_blocked_url", "dropped_blocked_name", "dropped_not_in_seed", "dropped_override_exclude")
SAYS_DECISION = "Candidate relevance decision mismatch."
SAYS_FIELD = "Could not resolve field_name to candidate column."
SAYS_VALUE = "Candidate value does not match expected_value."
APPROVED = "approved_overwrite"
CONFIDENT = ("high", "medium")


def token(c: Column | str) -> Column:
    return F.lower(T.norm_space(c))


def key(*columns: str) -> Column:
    return F.concat_ws("\x1f", *[token(c) for c in columns])


def _named(c: Column | str, names: dict[str, str]) -> Column:
    t = F.regexp_replace(F.regexp_replace(token(c), "-", "_"), r"\s+", "_")
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), t), t)


def _values(fields: tuple[str, ...] = FIELDS) -> Column:
    return F.array(*[T.norm_space(f) for f in fields])


def _last(df: DataFrame, by: Column, *values: Column) -> DataFrame:
    """The last row (by seq) of each key."""
    return df.groupBy(by.alias("k")).agg(F.max_by(F.struct(*values), "seq").alias("r")).select("k", "r.*")


def field_changes(base: DataFrame, cand: DataFrame) -> DataFrame:
    """institution, program_name, credential, source_url, field_name, baseline_value, candidate_value: all fields that
    differ between runs (seq, institution, program_name, credential, source_url, FIELDS); a program that one run lacks
    differs in the fields that the other has. Of rows with one key the last counts."""
    names = ("institution", "program_name", "credential", "source_url")
    own = lambda df, p: _last(df, key(*names), *[T.norm_space(n).alias(f"{p}_{n}") for n in names], _values().alias(f"{p}_values"))
    both = own(base, "b").join(own(cand, "c"), "k", "full_outer")
    none = F.array_repeat(F.lit(""), len(FIELDS))
    pairs = F.arrays_zip(F.array(*map(F.lit, FIELDS)).alias("field"), F.coalesce("b_values", none).alias("before"), F.coalesce("c_values", none).alias("after"))
    named = [F.coalesce(F.nullif(F.col(f"c_{n}"), F.lit("")), F.col(f"b_{n}"), F.lit("")).alias(n) for n in names]
    long = both.select(*named, F.explode(F.filter(pairs, lambda p: p["before"] != p["after"])).alias("d"))
    return long.select(*names, F.col("d.field").alias("field_name"), F.col("d.before").alias("baseline_value"), F.col("d.after").alias("candidate_value"))


def coverage_delta(base: DataFrame, cand: DataFrame) -> DataFrame:
    """field, baseline_filled, candidate_filled, delta for every field."""
    def filled(df: DataFrame, name: str) -> DataFrame:
        one = df.agg(*[F.count_if(T.norm_space(f) != "").alias(f) for f in FIELDS])
        return one.unpivot([], list(FIELDS), "field", name)

    return filled(base, "baseline_filled").join(filled(cand, "candidate_filled"), "field").withColumn("delta", F.col("candidate_filled") - F.col("baseline_filled"))


def issue_field(issue: str = "field_name", kind: str = "issue_type") -> Column:
    """The field an issue is about: as named, else by its type, else ''."""
    named = _named(issue, FIELD_NAMES)
    of_type = F.element_at(F.create_map(*[F.lit(x) for kv in OF_TYPE.items() for x in kv]), token(kind))
    return F.when(named.isin(*FIELDS), named).otherwise(F.coalesce(of_type, F.lit("")))


def issue_regressions(issues: DataFrame, cand: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """issue_id, issue_type, field_name, expected_value, actual_value, notes of the open issues that a run doesn't meet.

    issues: issue_id, issue_type, field_name, canonical_row_id, institution, program, credential, program_url,
    expected_value, status. A candidate row is looked up by row id (where one row has it), by full key (of several the
    last), by the key without URL (where one row has it). Issues of relevance compare the decision (of several the last)
    for institution, program and URL. Without expected value an issue asks nothing."""
    expected = T.norm_space("expected_value")
    open_ = issues.filter(~token("status").isin(*CLOSED) & (expected != "")).withColumns({"field": issue_field(), "expected": expected, "relevance": token("issue_type") == "irrelevant_program", "__issue": F.monotonically_increasing_id()})
    own = [F.col("issue_id"), T.norm_space("issue_type").alias("issue_type")]

    about = open_.filter("relevance").withColumn("k", key("institution", "program", "program_url"))
    if decisions is None:
        decided = about.withColumn("actual", F.lit(""))
    else:
        known = _last(decisions, key("institution", "program_name", "source_url"), token("decision").alias("actual"))
        decided = about.join(known, "k", "left").withColumn("actual", F.coalesce("actual", F.lit("")))
    wrong = decided.filter(F.col("actual") != token("expected")).select(*own, F.lit("irrelevant_program").alias("field_name"), F.col("expected").alias("expected_value"), F.col("actual").alias("actual_value"), F.lit(SAYS_DECISION).alias("notes"))

    rest = open_.filter("NOT relevance")
    unknown = rest.filter(~F.col("field").isin(*FIELDS)).select(*own, F.col("field").alias("field_name"), F.col("expected").alias("expected_value"), F.lit("").alias("actual_value"), F.lit(SAYS_FIELD).alias("notes"))

    tier = lambda t, k: F.struct(F.lit(t).alias("t"), k.alias("k"))
    blank = "\x1f" * 3
    asked = F.array(tier(0, F.nullif(token("canonical_row_id"), F.lit(""))), tier(1, F.nullif(key("institution", "program", "credential", "program_url"), F.lit(blank))), tier(2, key("institution", "program", "credential")))
    held = F.array(tier(0, F.nullif(token("index_row_id"), F.lit(""))), tier(1, key("institution", "program_name", "credential", "source_url")), tier(2, key("institution", "program_name", "credential")))
    rows = cand.select("seq", _values().alias("values"), F.explode(held).alias("x")).select("seq", "values", "x.*").filter("k IS NOT NULL")
    rows = rows.groupBy("t", "k").agg(F.count("*").alias("n"), F.max_by("values", "seq").alias("values")).filter("t = 1 OR n = 1")
    checked = rest.filter(F.col("field").isin(*FIELDS))
    long = checked.select("__issue", F.explode(asked).alias("x")).select("__issue", "x.*").filter("k IS NOT NULL")
    found = long.join(rows, ["t", "k"]).groupBy("__issue").agg(F.min_by("values", "t").alias("values"))
    actual = F.coalesce(F.get(F.col("values"), (F.array_position(F.array(*map(F.lit, FIELDS)), F.col("field")) - 1).cast("int")), F.lit(""))
    missed = checked.join(found, "__issue", "left").withColumn("actual", actual).filter(F.lower("actual") != token("expected"))
    return wrong.unionByName(unknown).unionByName(missed.select(*own, F.col("field").alias("field_name"), F.col("expected").alias("expected_value"), F.col("actual").alias("actual_value"), F.lit(SAYS_VALUE).alias("notes")))


def irrelevant_drops(decisions: DataFrame) -> DataFrame:
    return decisions.filter((token("decision") == "drop") & token("reason_code").isin(*IRRELEVANT))


def promotion_gate(
    base: DataFrame, cand: DataFrame, issues: DataFrame, base_decisions: DataFrame | None = None, cand_decisions: DataFrame | None = None, expected_base: int = 0, expected_cand: int = 0
) -> DataFrame:
    """One row: what the comparison counts, passed, and the reasons against promotion in order. Every count is an aggregate of its own, and
    they meet as rows of one small union."""
    both = base_decisions is not None and cand_decisions is not None
    n = lambda df, name, value=None: df.agg((F.count("*") if value is None else value).cast("long").alias("v")).select(F.lit(name).alias("name"), "v")
    filled = lambda: sum((F.count_if(T.norm_space(f) != "") for f in FIELDS), F.lit(0))
    counts = [n(base, "base_rows"), n(cand, "cand_rows"), n(base, "base_filled", filled()), n(cand, "cand_filled", filled()), n(issue_regressions(issues, cand, cand_decisions if both else None), "regressions"), n(field_changes(base, cand), "changes")]
    if both:
        counts += [n(irrelevant_drops(base_decisions), "base_drops"), n(irrelevant_drops(cand_decisions), "cand_drops")]
    every = counts[0]
    for c in counts[1:]:
        every = every.unionByName(c)
    get = lambda name: F.max(F.when(F.col("name") == name, F.col("v"))).alias(name)
    row = every.agg(*[get(x) for x in ("base_rows", "cand_rows", "base_filled", "cand_filled", "regressions", "changes", "base_drops", "cand_drops")])
    net = F.col("cand_filled") - F.col("base_filled")
    text = lambda c: c.cast("string")
    counted = lambda name, label, want: F.when(F.lit(want > 0) & (F.col(name) != want), F.concat(F.lit(f"{label} row count mismatch: "), text(F.col(name)), F.lit(f" != expected {want}")))
    reasons = F.array_compact(F.array(
        F.when(F.col("regressions") > 0, F.concat(F.lit("Issue-pack regressions found: "), text(F.col("regressions")))),
        F.when(F.col("cand_drops") > F.col("base_drops"), F.concat(F.lit("Candidate irrelevant drop count increased: "), text(F.col("cand_drops")), F.lit(" > "), text(F.col("base_drops")))),
        F.when(net <= 0, F.concat(F.lit("Net coverage delta is not positive: "), text(net))),
        counted("base_rows", "Baseline", expected_base), counted("cand_rows", "Candidate", expected_cand),
    ))
    return row.select("base_rows", "cand_rows", net.alias("net_coverage"), "changes", "regressions", "base_drops", "cand_drops", F.array_join(reasons, "; ").alias("reasons"), (F.size(reasons) == 0).alias("passed"))


def row_token(row_no: Column | str) -> Column:
    return F.format_string("canonical_%06d", T.col(row_no))


def match_candidates(table: DataFrame, cand: DataFrame) -> DataFrame:
    """seq, row_no, status of candidates for rows of a table (row_no from 1, institution, program, credential_type): by row id;
    else by institution, program and credential (several are ambiguous); else by institution and program where one row has them."""
    named = lambda i, p: (token(i) != "") & (token(p) != "")
    tier = lambda t, k: F.struct(F.lit(t).alias("t"), k.alias("k"))
    digits = F.regexp_extract(token("index_row_id"), "^canonical_([0-9]{1,18})$", 1).try_cast("long")
    asked = F.array(
        tier(0, digits.cast("string")), tier(1, F.when(named("institution", "program_name") & (token("credential") != ""), key("institution", "program_name", "credential"))),
        tier(2, F.when(named("institution", "program_name"), key("institution", "program_name"))),
    )
    held = F.array(tier(0, F.col("row_no").cast("string")), tier(1, F.when(named("institution", "program"), key("institution", "program", "credential_type"))), tier(2, F.when(named("institution", "program"), key("institution", "program"))))
    rows = table.select("row_no", F.explode(held).alias("x")).select("row_no", "x.*").filter("k IS NOT NULL").groupBy("t", "k").agg(F.count("*").alias("n"), F.min("row_no").alias("row_no")).filter("t < 2 OR n = 1")
    long = cand.select("seq", F.explode(asked).alias("x")).select("seq", "x.*").filter("k IS NOT NULL")
    best = long.join(rows, ["t", "k"]).groupBy("seq").agg(F.min_by(F.struct("n", "row_no"), "t").alias("b"))
    status = F.when(F.col("b").isNull(), "no_match").when(F.col("b.n") > 1, "ambiguous").otherwise("matched")
    return cand.select("seq").join(best, "seq", "left").select("seq", F.when(status == "matched", F.col("b.row_no")).alias("row_no"), status.alias("status"))


def apply_candidates(table: DataFrame, cand: DataFrame, issues: DataFrame, allowed: tuple[str, ...] = CONFIDENT, profile: str = "") -> tuple[DataFrame, DataFrame]:
    """The table after the candidates, and the log of changes (row_no, row_id, field, prev_value, new_value, mode, confidence, seq).

    table: row_no from 1, institution, program, credential_type, program_url and APPLIED; cand: seq, index_row_id, institution,
    program_name, credential, error, profile and each of APPLIED with its _confidence. Candidates without an error, of
    the profile asked for or of none, are taken in order: a value of an allowed confidence fills a blank; it takes a
    filled field's place only where an issue approves that (row id and field, or the row's identity and field), and not
    where it differs in case alone. Applying the same candidates again gives the same table."""
    matched = match_candidates(table, cand).filter("status = 'matched'").select("seq", "row_no")
    fit = cand.filter(T.norm_space("error") == "")
    if token_ := " ".join(profile.split()).lower():
        fit = fit.filter(token("profile").isin("", token_))
    found = F.array(*[F.struct(F.lit(f).alias("field"), T.norm_space(f).alias("value"), token(f"{f}_confidence").alias("confidence")) for f in APPLIED])
    offers = fit.select("seq", F.explode(F.filter(found, lambda x: (x["value"] != "") & x["confidence"].isin(*allowed))).alias("x")).select("seq", "x.*").join(matched, "seq")

    identity = lambda i, p, c, u: F.when((token(i) != "") & (token(p) != ""), F.concat_ws("\x1f", token(i), token(p), token(c), F.regexp_replace(token(u), "/+$", "")))
    agreed = issues.filter(token("approval_state") == APPROVED).withColumn("field", _named("field_name", APPLIED_NAMES)).filter("field <> ''")
    by_row = agreed.select(token("canonical_row_id").alias("row_id"), "field").filter("row_id <> ''").distinct()
    by_name = agreed.select(identity("institution", "program", "credential", "program_url").alias("identity"), "field").filter("identity IS NOT NULL").distinct()
    had = F.array(*[F.struct(F.lit(f).alias("field"), T.norm_space(f).alias("existing")) for f in APPLIED])
    fields = table.select("row_no", row_token("row_no").alias("row_id"), identity("institution", "program", "credential_type", "program_url").alias("identity"), F.explode(had).alias("x")).select("row_no", "row_id", "identity", "x.*")
    held = offers.join(fields, ["row_no", "field"]).join(by_row.withColumn("a", F.lit(True)), ["row_id", "field"], "left").join(by_name.withColumn("b", F.lit(True)), ["identity", "field"], "left")
    held = held.withColumn("approved", F.coalesce("a", "b", F.lit(False)))

    order = Window.partitionBy("row_no", "field").orderBy("seq")
    earlier = F.lag("value").over(order)
    first = (F.row_number().over(order) == 1) & (F.col("existing") == "")
    # Where overwriting is approved, the value so far is the one before, whatever its case.
    held = held.withColumn("filling", first).withColumn("changes", first | (F.col("approved") & (F.lower(F.coalesce(earlier, F.col("existing"))) != F.lower("value"))))
    so_far = F.last(F.when(F.col("changes"), F.col("value")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    log = held.withColumn("prev_value", F.coalesce(so_far, F.col("existing"))).filter("changes")
    log = log.select("row_no", "row_id", "field", "prev_value", F.col("value").alias("new_value"), F.when(F.col("filling"), "fill").otherwise("overwrite_approved").alias("mode"), "confidence", "seq")

    final = log.groupBy("row_no", "field").agg(F.max_by("new_value", "seq").alias("value")).groupBy("row_no").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("__new"))
    new = table.join(final, "row_no", "left")
    return new.select(*[F.coalesce(F.try_element_at("__new", F.lit(c)), F.col(c)).alias(c) if c in APPLIED else F.col(c) for c in table.columns]), log
