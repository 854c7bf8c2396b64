"""Merging runs and rules into the canonical table, and the reports around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators.lookups import tiered_lookup


def _inst(c: str = "institution") -> Column:
    return F.lower(T.norm_space(c))


def _join(*parts: Column) -> Column:
    return F.when(~T.any_of([p == "" for p in parts]), F.concat_ws("||", *parts)).otherwise("")


def enforce_url_map(df: DataFrame, urls: DataFrame) -> DataFrame:
    """institution, row_id, name_key, status, url: rows against a locked map of an institution's names to URLs, both ways."""
    keys = ["institution", "name_key"]
    held = urls.groupBy(_inst().alias("institution"), T.name_key("program_name").alias("name_key")).agg(F.min_by("source_url", "seq").alias("url"), F.count("*").alias("n"))
    both = df.select("row_id", _inst().alias("institution"), T.name_key("program").alias("name_key")).join(held, keys, "full_outer")
    status = F.when(F.col("n").isNull(), "missing_from_map").when(F.col("row_id").isNull(), "unused_map_row").when(F.col("n") > 1, "duplicate_in_map").when(~T.is_http_url("url"), "bad_map_url").otherwise("mapped")
    return both.select("institution", "row_id", "name_key", status.alias("status"), F.when(F.col("n").isNotNull() & F.col("row_id").isNotNull(), F.col("url")).alias("url"))


def resolve_override(df: DataFrame, overrides: DataFrame) -> DataFrame:
    """left_id (df.seq), right_id (overrides.seq), tier: a unique URL, a URL with the program, then the last row of a key.

    An ambiguous URL falls through to the next tier. An override counts under each of its distinct http URLs.
    """
    urls = F.array_distinct(F.array_compact(F.array(*[F.when(T.is_http_url(c), T.url_key(c)) for c in ("source_page_url", "parent_admissions_url")])))
    by_url = overrides.select("seq", _inst().alias("i"), T.name_key("program").alias("p"), F.explode(urls).alias("u"), F.lit("").alias("k"))
    by_key = overrides.filter(T.name_key("program") != "").groupBy(_inst().alias("i"), T.name_key("program").alias("p")).agg(F.max("seq").alias("seq"))
    by_key = by_key.select("seq", F.lit("").alias("i"), F.lit("").alias("p"), F.lit("").alias("u"), _join(F.col("i"), F.col("p")).alias("k"))
    left = df.select("seq", _inst().alias("i"), T.name_key("program_name").alias("p"), T.url_key("source_url").alias("u")).withColumn("k", _join(F.col("i"), F.col("p")))
    url, program = _join(F.col("i"), F.col("u")), _join(F.col("i"), F.col("u"), F.col("p"))
    return tiered_lookup(left, by_url.unionByName(by_key), [("url", url, url), ("url_program", program, program), ("key", F.col("k"), F.col("k"))], "seq", "seq", fall_through=True)


def resolve_structured(df: DataFrame, found: DataFrame) -> DataFrame:
    """left_id (row_id), right_id (cand_id), tier: by URL, full key, key without credential; the last row of a key wins."""
    keys = lambda d: {"url": _join(_inst(), T.url_key("program_url")), "full": _join(_inst(), T.name_key("program"), F.lower(T.norm_space("credential_type"))), "short": _join(_inst(), T.name_key("program"))}
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("tier"), k.alias("key")) for n, k in keys(found).items()])).alias("x")
    last = found.select("cand_id", long).select("cand_id", "x.*").filter("key <> ''").groupBy("tier", "key").agg(F.max("cand_id").alias("cand_id"))
    return tiered_lookup(df, last, [(n, k, F.when(F.col("tier") == n, F.col("key")).otherwise("")) for n, k in keys(df).items()], "row_id", "cand_id")


def proposed_removals(missing: DataFrame, decisions: DataFrame, reasons: list[str]) -> DataFrame:
    held = missing.join(decisions.hint("merge"), "row_id", "left")  # as many as rows, so never broadcast
    return held.filter(F.col("reason_code").isNull() | F.col("reason_code").isin(*reasons)).select("row_id", F.coalesce("reason_code", F.lit("unknown")).alias("reason"))


def note_spikes(df: DataFrame, least: int, share: float) -> DataFrame:
    """Notes that many rows of an institution carry."""
    notes = F.filter(F.transform(F.split(F.regexp_extract("requirement_type", "notes:(.*)$", 1), ";"), lambda x: F.trim(x)), lambda x: x != "")
    counts = df.select("institution", F.explode(notes).alias("note")).groupBy("institution", "note").agg(F.count("*").alias("n"))
    total = df.groupBy("institution").agg(F.count("*").alias("rows"))
    return counts.join(total, "institution").withColumn("share", F.col("n") / F.col("rows")).filter((F.col("n") >= least) & (F.col("share") >= share)).select("institution", "note", "n", "share")


def refers_elsewhere(c: str) -> Column:
    return T.norm_space(c).rlike(r"(?i)\b(see|refer to)\s+(degree|program|faculty)\b")


def reject_unsupported(marks: DataFrame, known: DataFrame, low: float, high: float) -> DataFrame:
    """seq, error of inputs with a mark out of range or a course that is not known."""
    held = marks.join(known.withColumn("known", F.lit(True)), "course", "left")
    error = F.when(~F.col("mark").between(low, high), "mark out of range").when(F.col("known").isNull(), "unsupported course")
    return held.select("seq", error.alias("error")).filter("error IS NOT NULL")


def flatten_fields(long: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One wide row per key: value and confidence of each field; a missing one is '' and none."""
    pick = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c)))
    return long.groupBy(key).agg(*[x for f in fields for x in (F.coalesce(pick(f, "value"), F.lit("")).alias(f"{f}_value"), F.coalesce(pick(f, "confidence"), F.lit("none")).alias(f"{f}_confidence"))])


def plan_ids(selector: Column, today: Column) -> Column:
    """Program code by academic years: the selector's own, then the two that run at a date."""
    s = F.from_json(selector, "map<string,string>")
    code, year = T.norm_space(F.element_at(s, "programCode")), T.norm_space(F.element_at(s, "academicYear"))
    first = F.when(F.month(today) <= 5, F.year(today) - 1).otherwise(F.year(today))
    years = F.array_distinct(F.array_compact(F.array(F.when(year.rlike("^[0-9]+$"), year.try_cast("int")), first, first + 1)))
    return F.when(code == "", F.array().cast("array<string>")).otherwise(F.transform(years, lambda y: F.concat(code, F.lit("-"), y.cast("string"))))


def labelled_text(parts: list[tuple[str, Column]]) -> Column:
    """Non-blank values under their labels, a blank line between them."""
    return F.concat_ws("\n\n", *[F.when(T.norm_space(v) != "", F.concat(F.lit(label), T.norm_space(v))) for label, v in parts])


def trim_document(text: str, starts: list[str], ends: list[str]) -> Column:
    """From the first start marker in the list that is there, to the earliest end marker behind the beginning."""

    def cut(t: Column) -> Column:
        at = F.coalesce(*[F.nullif(F.locate(m, t), F.lit(0)) for m in starts], F.lit(1))
        return F.substring(t, at, F.length(t))

    def stop(t: Column) -> Column:
        found = F.array_min(F.filter(F.array(*[F.locate(m, t) for m in ends]), lambda i: i > 1))
        return T.norm_space(F.when(found.isNotNull(), F.substring(t, F.lit(1), found - 1)).otherwise(t))

    return T.let(T.norm_space(text), lambda t: T.let(cut(t), stop))


def assemble_documents(docs: DataFrame, most: int) -> DataFrame:
    """program_id, url, doc_seq: base pages, then seeded links, then ranked ones; the first of each URL; at most so many."""
    place = F.when(F.col("kind") == "base", 0).when(F.col("kind") == "seeded", 1).otherwise(2)
    once = docs.groupBy("program_id", "url").agg(F.min(place).alias("r"), F.min("doc_seq").alias("o"))
    n = F.row_number().over(Window.partitionBy("program_id").orderBy("r", "o"))
    return once.withColumn("doc_seq", n - 1).filter(F.col("doc_seq") < most).select("program_id", "url", "doc_seq")


def apply_structured(df: DataFrame, found: DataFrame, fields: list[str], low: list[str]) -> DataFrame:
    """Values of medium or high confidence win; of low only for some fields, over a blank; a blank never wins."""
    new = found.select("row_id", "confidence", *[T.norm_or_blank(f).alias(f"new_{f}") for f in fields])
    held = df.join(new, "row_id", "left")

    def pick(f: str) -> Column:
        value, strong = F.col(f"new_{f}"), F.col("confidence").isin("high", "medium")
        weak = (F.col("confidence") == "low") & T.is_blankish(f) if f in low else F.lit(False)
        return F.when((value != "") & (strong | weak), value).otherwise(F.col(f)).alias(f)

    return held.select("row_id", *[pick(f) if f in fields else F.col(f) for f in df.columns if f != "row_id"])


def apply_average_rules(df: DataFrame, rules: DataFrame) -> DataFrame:
    """A blank average count takes that of the rule for the row's credential."""
    held = df.join(rules.withColumnRenamed("scope", "_scope"), F.lower(T.norm_space("credential_type")) == F.col("_scope"), "left")
    total = F.when(T.is_blank("avg_total") & F.col("rule_total").isNotNull(), F.col("rule_total").cast("string")).otherwise(F.col("avg_total"))
    return held.withColumn("avg_total", total).select(*df.columns)


def change_log(df: DataFrame, found: DataFrame, approved: DataFrame, fields: list[str]) -> DataFrame:
    """row_id, field, old_value, new_value, action: what a set of candidates changes."""
    both = df.select("row_id", *fields).join(found.select("row_id", *[F.col(f).alias(f"new_{f}") for f in fields]), "row_id")
    rows = F.array(*[F.struct(F.lit(f).alias("field"), T.norm_or_blank(f).alias("old_value"), T.norm_or_blank(f"new_{f}").alias("new_value")) for f in fields])
    long = both.select("row_id", F.explode(rows).alias("r")).select("row_id", "r.*").filter("new_value <> '' AND new_value <> old_value")
    ok = long.join(approved.distinct().withColumn("ok", F.lit(True)), ["row_id", "field"], "left").filter((F.col("old_value") == "") | F.col("ok"))
    return ok.select("row_id", "field", "old_value", "new_value", F.when(F.col("old_value") == "", "filled").otherwise("overwritten").alias("action"))


def named_row_violations(df: DataFrame, spec: DataFrame, fields: list[str]) -> DataFrame:
    """row_id, broken: named rows that do not have the value expected of a field."""
    long = df.select("row_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), T.norm_space(f).alias("value")) for f in fields])).alias("f")).select("row_id", "f.*")
    return spec.join(long, ["row_id", "field"], "left").filter(~F.col("value").eqNullSafe(F.col("expected"))).select("row_id", F.col("field").alias("broken"))


def student_average(marks: DataFrame, courses: int) -> DataFrame:
    """student_id, used, average, complete: over the best marks; the average divides by the marks used."""
    best = F.slice(F.sort_array(F.collect_list("mark"), asc=False), 1, courses)
    return marks.groupBy("student_id").agg(best.alias("best")).select(
        "student_id", F.size("best").alias("used"), (F.aggregate("best", F.lit(0.0), lambda a, m: a + m) / F.size("best")).alias("average"), (F.size("best") >= courses).alias("complete")
    )


def pinned_comparison(df: DataFrame, pins: DataFrame) -> DataFrame:
    """row_id, place, needs: pinned rows that are still there, ranked by pin. Pins are a person's few."""
    needs = F.concat_ws("; ", *[F.when(T.norm_space(c) != "", T.norm_space(c)) for c in ("english_req", "math_req", "science_req")])
    held = df.join(pins, "row_id").select("row_id", "pin", needs.alias("needs"))
    return held.withColumn("place", F.row_number().over(Window.orderBy("pin"))).select("row_id", "place", "needs")
