"""The canonical table out of all its inputs, and for each row which step set which field.

Order of precedence: raw values, structured values, forms of subjects and inference, rule sets, overrides, last
normalisation, first of equal rows. Each input is found by keys in one join: the table is shuffled by row for structured
values and for overrides, and once for equal rows; rule sets come as one ordered array an institution, which the join
takes to the rows, so no row meets all rules as rows of its own. Columns beside those named pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import curation as C
from sievework.operators import merge as M
from sievework.operators import quality as Q
from sievework.operators.fuzzy import best_fuzzy_match

# Structured fields in their order, those that a value of low confidence fills, what overrides hold, signals of rule sets.
STRUCTURED = (
    "min_avg_final", "competitive_final", "avg_total", "english_req", "english_requirement_mode", "english_min", "math_req", "math_requirement_mode", "math_min", "social_req", "social_min", "science_req", "science_min",
    "bio_30_req", "chem_30_req", "phys_30_req", "sci_30_req", "elective_qty", "elective_pool", "requirement_type", "hs_diploma_req", "math_assessment_flag", "elp_tests_mentioned",
)
WEAK = ("requirement_type", "hs_diploma_req", "math_assessment_flag", "elp_tests_mentioned")
OVERRIDES = {"requirement_type": "requirement_type_override", "min_avg_final": "min_avg_override", "elective_qty": "elective_qty_override", "avg_total": "avg_total_override"}
NO_SIGNAL = ("", "unknown", "none", "null", "nan", "no")
LEAST, GAP = 0.62, 0.10

_low = lambda c: F.lower(T.norm_space(c))


def _set(df: DataFrame, values: dict[str, Column], step: Column) -> DataFrame:
    """df with the values; set_by grows by (field, step) of those that change."""
    df = df.withColumns({f"__{f}": v for f, v in values.items()})
    entries = F.array(*[F.when(~F.col(f"__{f}").eqNullSafe(F.col(f)), F.struct(F.lit(f).alias("field"), step.alias("step"))) for f in values])
    df = df.withColumn("set_by", F.concat("set_by", F.array_compact(entries)))
    return df.withColumns({f: F.col(f"__{f}") for f in values}).drop(*[f"__{f}" for f in values])


def start(raw: DataFrame) -> DataFrame:
    """The raw table with its texts normalised (null is '') and an empty set_by."""
    texts = ("institution", "program", "credential_type", "status", "program_url", *STRUCTURED)
    return raw.withColumns({c: T.norm_space(c) for c in texts} | {"set_by": F.array().cast("array<struct<field:string,step:string>>")})


def apply_structured(df: DataFrame, found: DataFrame, keyed: DataFrame | None = None) -> DataFrame:
    """All 23 fields of the extraction found for a row (cand_id, institution, program, credential_type, program_url, each
    field and its _confidence): medium and high win, low only fills WEAK fields that say nothing, a blank never wins.
    keyed: the rows with their keys, where df is costly and these haven't changed since."""
    match = M.resolve_structured(df if keyed is None else keyed, found).filter("right_id IS NOT NULL").select(F.col("left_id").alias("row_id"), F.col("right_id").alias("cand_id"))
    texts = lambda cs: F.transform(F.array(*cs), T.norm_space)
    values = found.select("cand_id", texts(STRUCTURED).alias("__new"), F.transform(F.array(*[f"{f}_confidence" for f in STRUCTURED]), lambda h: F.lower(T.norm_space(h))).alias("__how"))
    # Both grow with the rows, and Spark takes a compressed file for few: a table of 46 texts a row is no broadcast.
    held = df.join(match.join(values.hint("merge"), "cand_id").drop("cand_id").hint("merge"), "row_id", "left")
    # One lambda over the 23 fields, as 23 expressions of their own would be too much code for one method.
    own = F.arrays_zip(F.array(*map(F.lit, STRUCTURED)).alias("field"), F.array(*STRUCTURED).alias("old"), F.col("__new").alias("new"), F.col("__how").alias("how"))

    def taken(x: Column) -> Column:
        weak = (x["how"] == "low") & x["field"].isin(*WEAK) & T.is_blankish(x["old"])
        return (x["new"] != "") & (x["new"] != x["old"]) & (x["how"].isin("high", "medium") | weak)

    took = F.when(F.col("__new").isNotNull(), F.filter(own, taken))
    held = held.withColumn("__took", F.coalesce(F.transform(took, lambda x: F.struct(x["field"].alias("field"), x["new"].alias("new"), F.concat(F.lit("structured:"), x["how"]).alias("step"))), F.array().cast("array<struct<field:string,new:string,step:string>>")))
    held = held.withColumn("__values", F.map_from_entries(F.transform("__took", lambda x: F.struct(x["field"], x["new"]))))
    value = lambda f: F.coalesce(F.try_element_at("__values", F.lit(f)), F.col(f)).alias(f)
    log = F.concat("set_by", F.transform("__took", lambda x: F.struct(x["field"].alias("field"), x["step"].alias("step")))).alias("set_by")
    return held.select(*[log if c == "set_by" else value(c) if c in STRUCTURED else F.col(c) for c in df.columns])


def subjects(df: DataFrame) -> DataFrame:
    """English and mathematics as shown, with their modes; without anything to show there is no mode."""
    values = {}
    for s in ("english", "math"):
        mode = T.requirement_mode(s, f"{s}_req", f"{s}_requirement_mode")
        shown = T.display_requirement(s, f"{s}_req", mode)
        if s == "math":
            shown = F.when((mode == "elp") & T.is_blank("math_req"), "English language proficiency").otherwise(shown)
        values |= {f"{s}_req": shown, f"{s}_requirement_mode": F.when(shown == "", "").otherwise(mode)}
    return _set(df, values, F.lit("form"))


def infer(df: DataFrame) -> DataFrame:
    df = _set(df, {"requirement_type": F.when(T.is_blank("requirement_type"), F.col("requirement_type")).otherwise(Q.normalise_requirement_type(df))}, F.lit("form"))
    return _set(df, {"avg_total": F.when(T.is_blank("avg_total"), Q.infer_average_total()).otherwise(F.col("avg_total"))}, F.lit("inferred"))


def ordered_rules(rules: DataFrame) -> DataFrame:
    """inst, rules: an institution's rule sets that say something, the more specific first, then by key. It is a written list, a few rows an institution."""
    scope, pattern, none = _low("credential_scope"), _low("requirement_type_pattern"), F.array().cast("array<string>")
    tokens = F.when(scope == "any", none).otherwise(F.filter(F.transform(F.split(scope, "[|,;/]"), T.norm_space), lambda t: t != ""))
    total = F.coalesce(F.bround(T.to_number("default_avg_total")).cast("int"), F.lit(0))
    held = rules.select(_low("institution").alias("inst"), T.norm_space("ruleset_key").alias("key"), tokens.alias("tokens"), pattern.alias("pattern"), total.alias("total"), T.truthy("placement_required").alias("placement"))
    held = held.filter("inst <> '' AND (total > 0 OR placement)")
    rank = F.when(F.size("tokens") > 0, 0).otherwise(1) + F.when(F.col("pattern") != "", 0).otherwise(1)
    rule = F.struct(rank.alias("rank"), F.lower("key").alias("order"), "key", "tokens", "pattern", "total", "placement")
    return held.groupBy("inst").agg(F.sort_array(F.collect_list(rule)).alias("rules"))


def has_signal() -> Column:
    says = lambda c: ~_low(c).isin(*NO_SIGNAL)
    subject = [Q.has_text_course(s) & says(f"{s}_req") for s in ("english", "math")]
    return T.any_of([*subject, *[says(c) for c in ("min_avg_final", "social_req", "science_req", "elective_qty", "hs_diploma_req")]])


def apply_rulesets(df: DataFrame, rules: DataFrame) -> DataFrame:
    """The first rule set of the row's institution whose scope and pattern fit: it fills the average count, the
    requirement type where the row says something else only, and the flag of placement. A pattern fits a row without
    type that says something; a rule with a scope fits no row without credential."""
    held = df.withColumns({"__kind": _low("requirement_type"), "__cred": _low("credential_type"), "__signal": has_signal(), "__inst": _low("institution")})
    held = held.join(ordered_rules(rules).withColumnRenamed("inst", "__inst"), "__inst", "left")
    scope = lambda r: (F.size(r["tokens"]) == 0) | ((F.col("__cred") != "") & F.exists(r["tokens"], lambda t: F.contains(F.col("__cred"), t)))
    kind = lambda r: (r["pattern"] == "") | F.when(F.col("__kind") != "", F.contains(F.col("__kind"), r["pattern"])).otherwise(F.col("__signal"))
    held = held.withColumn("__rule", F.get(F.filter("rules", lambda r: scope(r) & kind(r)), F.lit(0)))
    step = F.concat(F.lit("ruleset:"), F.col("__rule.key"))
    held = _set(held, {"avg_total": F.when(T.is_blank("avg_total") & (F.col("__rule.total") > 0), F.col("__rule.total").cast("string")).otherwise(F.col("avg_total"))}, step)
    typed = F.col("__kind").isin("", "unknown") & (F.col("__rule.pattern") != "") & F.col("__signal")
    flag = F.col("__rule.placement") & T.is_blankish("math_assessment_flag")
    values = {"requirement_type": F.when(typed, Q.normalise_requirement_type(held, F.col("__rule.pattern"))).otherwise(F.col("requirement_type")), "math_assessment_flag": F.when(flag, "Yes").otherwise(F.col("math_assessment_flag"))}
    return _set(held, values, step).select(*df.columns)


def resolve_overrides(df: DataFrame, overrides: DataFrame) -> DataFrame:
    """row_id, seq, tier of the active override of a row: the only one of its URL; of these the only one of its credential
    or of none; of these the only one of its program; the last one of its full key; the last one of its key without
    credential; the best of its institution by name, from 0.62 on and 0.10 before the next."""
    urls = F.array_distinct(F.array_compact(F.array(*[F.when(T.is_http_url(c), T.url_key(c)) for c in ("source_page_url", "parent_admissions_url")])))
    active = overrides.filter(T.is_active_status("status")).select("seq", _low("institution").alias("i"), T.name_key("program").alias("p"), _low("credential_type").alias("c"), urls.alias("urls"), T.program_tokens("program").alias("tokens"), T.norm_space("program").alias("name"))
    active = active.filter("i <> '' AND p <> ''")
    rows = df.select("row_id", _low("institution").alias("i"), T.name_key("program").alias("p"), _low("credential_type").alias("c"), T.url_key("program_url").alias("u"), T.program_tokens("program").alias("tokens")).filter("i <> ''")

    key = lambda t, *parts: F.struct(F.lit(t).alias("t"), F.concat_ws("\x1f", *parts).alias("k"))
    i, p, c, u, none = F.col("i"), F.col("p"), F.col("c"), F.col("u"), F.lit("")
    by_url = active.select("seq", "i", "p", "c", F.explode("urls").alias("u")).select("seq", F.explode(F.array(key(0, i, u), key(1, i, u, c), key(2, i, u, c, p))).alias("x"))
    last = active.groupBy("i", "p", "c").agg(F.max("seq").alias("seq"))
    by_key = last.select("seq", key(3, i, p, c).alias("x")).unionByName(last.filter("c = ''").select("seq", key(4, i, p).alias("x")))
    held = by_url.unionByName(by_key).select("seq", "x.*").groupBy("t", "k").agg(F.count("*").alias("n"), F.min("seq").alias("seq"))

    of_url = F.when(u != "", F.array(key(0, i, u), key(1, i, u, none), key(1, i, u, c))).otherwise(F.array().cast("array<struct<t:int,k:string>>"))
    of_name = F.array(key(3, i, p, c), key(4, i, p))
    both = F.when((u != "") & (p != ""), F.array(key(2, i, u, none, p), key(2, i, u, c, p))).otherwise(F.array().cast("array<struct<t:int,k:string>>"))
    asks = F.array_distinct(F.concat(of_url, both, F.when(p != "", of_name).otherwise(F.array().cast("array<struct<t:int,k:string>>"))))
    found = rows.select("row_id", F.explode(asks).alias("x")).select("row_id", "x.*").join(held.hint("merge"), ["t", "k"])
    found = found.groupBy("row_id", "t").agg(F.sum("n").alias("n"), F.min("seq").alias("seq")).filter("n = 1").groupBy("row_id").agg(F.min_by(F.struct("seq", "t"), "t").alias("b"))
    found = found.select("row_id", "b.seq", "b.t")

    rest = rows.join(found.hint("merge"), "row_id", "left_anti").filter(F.size("tokens") > 0)
    block = F.concat_ws("\x1f", "i", "asked")
    asked = rest.select("i", F.col("c").alias("asked")).distinct()  # a row for an institution's kind of credential
    fit = active.join(F.broadcast(asked), "i").filter((F.col("asked") == "") | (F.col("c") == "") | (F.col("c") == F.col("asked"))).filter(F.size("tokens") > 0)
    near = best_fuzzy_match(rest.withColumn("asked", F.col("c")).select(F.col("row_id").alias("id"), block.alias("block"), "tokens"), fit.select(F.col("seq").alias("id"), block.alias("block"), "tokens", "name", none.alias("url")), LEAST, GAP)
    named = near.filter("status = 'matched'").select(F.col("left_id").alias("row_id"), F.col("right_id").alias("seq"), F.lit(5).alias("t"))
    tiers = F.array(*map(F.lit, ("url", "url_credential", "url_program", "key", "key_without_credential", "name")))
    return found.unionByName(named).select("row_id", "seq", F.get(tiers, F.col("t")).alias("tier"))


def with_overrides(df: DataFrame, overrides: DataFrame, keyed: DataFrame | None = None) -> DataFrame:
    """df with the override of each row as a struct (null without one), for exclude and apply_overrides."""
    url = lambda c: F.when(T.is_http_url(c), T.norm_space(c))
    held = overrides.select("seq", F.struct(*[T.norm_space(c).alias(f) for f, c in OVERRIDES.items()], F.coalesce(url("parent_admissions_url"), url("source_page_url"), F.lit("")).alias("url"), _low("include_or_exclude").alias("decision")).alias("__override"))
    return df.join(resolve_overrides(df if keyed is None else keyed, overrides).join(held.hint("merge"), "seq").select("row_id", "tier", "__override").withColumn("__override", F.col("__override").withField("tier", F.col("tier"))).drop("tier").hint("merge"), "row_id", "left")


def apply_overrides(df: DataFrame) -> DataFrame:
    """df of with_overrides with the override's four fields where it has them; its URL only where the row has no http URL."""
    values = {f: F.coalesce(F.nullif(F.col(f"__override.{f}"), F.lit("")), F.col(f)) for f in OVERRIDES}
    values["program_url"] = F.when(~T.is_http_url("program_url") & (F.col("__override.url") != ""), F.col("__override.url")).otherwise(F.col("program_url"))
    return _set(df, values, F.concat(F.lit("override:"), F.col("__override.tier"))).drop("__override")


def fill_from_seeds(df: DataFrame, seeds: DataFrame) -> DataFrame:
    """A blank credential takes the class of the seed of the row's name, and a blank status is Active where there is a seed
    (institution, program_name, credential, seq; the last of a name)."""
    last = seeds.groupBy(_low("institution").alias("__i"), T.name_key("program_name").alias("__p")).agg(F.max_by(F.coalesce("credential", F.lit("")), "seq").alias("__c")).filter("__p <> ''")
    held = df.withColumns({"__i": _low("institution"), "__p": T.name_key("program")}).join(last.hint("merge"), ["__i", "__p"], "left")
    kind = F.lower("__c")
    named = F.when(kind.rlike("diploma"), "Diploma").when(kind.rlike("certificate"), "Certificate").when(kind.rlike("degree|bachelor"), "Degree").otherwise("Other")
    fill = lambda c, v: F.when(F.col("__c").isNotNull() & T.is_blank(c), v).otherwise(F.col(c))
    return _set(held, {"credential_type": fill("credential_type", named), "status": fill("status", F.lit("Active"))}, F.lit("seed")).select(*df.columns)


def final_normalise(df: DataFrame) -> DataFrame:
    """Forms again; placement clears the average count; course rows without averages are course_min_only; a regular
    admission by pathway is post_secondary_pathway, which needs no diploma and no assessment; who is shown the row."""
    step = F.lit("final")
    df = _set(subjects(df), {"competitive_final": T.clean_competitive("competitive_final")}, step)
    kind = F.replace(T.norm_space(Q.normalise_requirement_type(df)), F.lit("notes: notes:"), F.lit("notes: "))
    df = _set(df, {"requirement_type": F.when(kind != "", kind).otherwise(F.col("requirement_type"))}, step)
    low = _low("requirement_type")
    df = _set(df, {"avg_total": F.when(F.startswith(low, F.lit("placement_assessment")), "").otherwise(F.col("avg_total"))}, step)
    at = F.locate("; notes:", low)
    notes = F.when(at > 0, F.substring(T.norm_space("requirement_type"), at, F.length("requirement_type"))).otherwise("")
    named = Q.has_text_course("english") | Q.has_text_course("math") | ~T.is_blank("social_req") | ~T.is_blank("science_req")
    only = F.startswith(low, F.lit("alberta_high_school_courses")) & T.is_blank("min_avg_final") & T.is_blank("avg_total") & named
    pathway = F.startswith(low, F.lit("regular_admission")) & F.contains(low, F.lit("post-secondary pathway"))
    df = _set(df, {"requirement_type": F.when(only, F.concat(F.lit("course_min_only"), notes)).when(pathway, F.concat(F.lit("post_secondary_pathway"), notes)).otherwise(F.col("requirement_type"))}, step)
    away = F.startswith(_low("requirement_type"), F.lit("post_secondary_pathway"))
    df = _set(df, {f: F.when(away, "No").otherwise(F.col(f)) for f in ("hs_diploma_req", "math_assessment_flag")}, step)
    return df.withColumn("display_for_high_school", Q.display_flag())


def distinct_rows(df: DataFrame, preserve: tuple[str, ...] = ()) -> DataFrame:
    """The first (by row_id) of rows that are equal whatever their case; all rows of the institutions to preserve."""
    own = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns if c not in ("row_id", "set_by")]
    return C.first_per_key(df, [F.sha2(F.concat_ws("\x1f", *own), 256)], "row_id", _low("institution").isin(*[p.lower() for p in preserve]) if preserve else None)


def build_canonical(raw: DataFrame, found: DataFrame, rules: DataFrame, overrides: DataFrame, preserve: tuple[str, ...] = (), seeds: DataFrame | None = None) -> DataFrame:
    """The canonical table: raw (row_id, institution, program, credential_type, status, program_url, STRUCTURED and more)
    without the rows that an override excludes, under the precedence of this module; set_by lists (field, step) in order."""
    # Both look-ups read the keys of the raw rows: asked of later stages, they would work all stages again.
    df = with_overrides(start(raw), overrides, raw)
    df = df.filter(F.coalesce(F.col("__override.decision") != "exclude", F.lit(True)))
    df = infer(subjects(apply_structured(df, found, raw)))
    df = apply_overrides(apply_rulesets(df, rules))
    if seeds is not None:
        df = fill_from_seeds(df, seeds)
    return distinct_rows(final_normalise(df), preserve)
