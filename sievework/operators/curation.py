"""Index curation: required fields, rule cascades, overrides, seeds, first and last rows, duplicate checks.

Rule and seed tables are small by nature but not by proof, so no join is forced to broadcast: Spark broadcasts what
is below its threshold and shuffles on keys with many values otherwise. Institutions are few and large; nothing is
ever partitioned by institution alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import text as T

DECISION = ("seq", "institution", "program_name", "source_url", "decision", "reason_code", "rule_source", "stage")


@dataclass(frozen=True)
class Rules:
    """Patterns and allow lists of a filter; patterns are Java regular expressions, tokens and keys are lower case."""

    blocked_urls: tuple[str, ...] = ()
    blocked_names: tuple[str, ...] = ()
    evidence_tokens: tuple[str, ...] = ()
    allowed_names: tuple[str, ...] = ()
    allowed_urls: tuple[str, ...] = ()


def require_fields(df: DataFrame, required: list[str]) -> DataFrame:
    """df with decision and reason_code: rows that lack a required field are dropped_missing_required."""
    lacks = T.any_of([T.norm_or_blank(c) == "" for c in required])
    return df.withColumns({"decision": F.when(lacks, "drop").otherwise("keep"), "reason_code": F.when(lacks, "dropped_missing_required").otherwise("")})


def _matches(c: Column, patterns: tuple[str, ...]) -> Column:
    return c.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def override_sets(overrides: DataFrame) -> DataFrame:
    """Active include and exclude overrides as (institution, kind: name or url, key, action), one row per key."""
    action = F.lower(T.norm_space("include_or_exclude"))
    active = overrides.filter(action.isin("include", "exclude") & T.is_active_status("status") & ~T.is_blank("institution"))
    keys = F.array(
        F.struct(F.lit("name").alias("kind"), T.name_key("program").alias("key")),
        *[F.struct(F.lit("url").alias("kind"), T.url_key(c).alias("key")) for c in ("source_page_url", "parent_admissions_url")],
    )
    long = active.select(F.lower(T.norm_space("institution")).alias("institution"), action.alias("action"), F.explode(keys).alias("k"))
    return long.select("institution", "action", "k.kind", "k.key").filter("key <> ''").distinct()


def override_trace(overrides: DataFrame) -> DataFrame:
    action = F.lower(T.norm_space("include_or_exclude"))
    active = overrides.filter(action.isin("include", "exclude") & T.is_active_status("status") & ~T.is_blank("institution"))
    url = F.when(T.norm_space("source_page_url") != "", T.norm_space("source_page_url")).otherwise(T.norm_space("parent_admissions_url"))
    return active.select("seq", F.lower(T.norm_space("institution")).alias("institution"), F.when(action == "include", "keep").otherwise("drop").alias("decision"), F.concat(F.lit("override_"), action).alias("reason_code"), url.alias("source_url"))


def _flag(df: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """df with a boolean column: whether (institution, key) is among keys. keys: i, k."""
    held = keys.select(F.col("i").alias("_i"), F.col("k").alias("_k")).distinct().withColumn(name, F.lit(True))
    on = (F.col("inst_key") == F.col("_i")) & (F.col("name_key" if name.endswith("name") else "url_key") == F.col("_k"))
    return df.join(held, on, "left").drop("_i", "_k").withColumn(name, F.coalesce(name, F.lit(False)))


def classify_rows(df: DataFrame, rules: Rules, seeds: DataFrame, sets: DataFrame, by_url: bool = False) -> DataFrame:
    """df with decision, reason_code and rule_source; the first rule that holds decides. by_url: a seed's URL counts too."""
    keyed = df.withColumns({"inst_key": F.lower(T.norm_space("institution")), "name_key": T.name_key("program_name"), "url_key": T.url_key("source_url")})
    seed = seeds.select(F.lower(T.norm_space("institution")).alias("i"), T.name_key("program_name").alias("n"), T.url_key("source_url").alias("u"))
    keyed = _flag(keyed, seed.select("i", F.col("n").alias("k")), "seed_name")
    keyed = _flag(keyed, seed.select("i", F.col("u").alias("k")), "seed_url") if by_url else keyed.withColumn("seed_url", F.lit(False))
    include = sets.filter("action = 'include'").select(F.col("institution").alias("i"), "kind", F.col("key").alias("k"))
    for kind in ("name", "url"):
        keyed = _flag(keyed, include.filter(F.col("kind") == kind), f"include_{kind}")
    low = F.lower(T.norm_space("notes"))
    evidence = T.any_of([F.lit(False)] + [F.contains(low, F.lit(t)) for t in rules.evidence_tokens])
    allowed = F.col("name_key").isin(*rules.allowed_names) if rules.allowed_names else F.lit(False)
    allowed = allowed | (F.col("url_key").isin(*rules.allowed_urls) if rules.allowed_urls else F.lit(False))
    steps = [
        (evidence, "drop", "dropped_evidence_non_program", "evidence_tokens"),
        (_matches(F.col("source_url"), rules.blocked_urls), "drop", "dropped_blocked_url", "blocked_urls"),
        (_matches(F.col("program_name"), rules.blocked_names), "drop", "dropped_blocked_name", "blocked_names"),
        (allowed, "keep", "kept_allowlist_override", "rules_allowlist"),
        (F.col("include_name"), "keep", "kept_allowlist_override", "override_name"),
        (F.col("include_url"), "keep", "kept_allowlist_override", "override_url"),
        ((F.col("name_key") != "") & F.col("seed_name") | F.col("seed_url"), "keep", "kept_seed_match", "seed"),
    ]
    out = None
    for test, *values in steps:
        made = F.struct(*[F.lit(v).alias(n) for v, n in zip(values, ("decision", "reason_code", "rule_source"), strict=True)])
        out = F.when(test, made) if out is None else out.when(test, made)
    out = out.otherwise(F.struct(F.lit("drop").alias("decision"), F.lit("dropped_not_in_seed").alias("reason_code"), F.lit("seed").alias("rule_source")))
    return keyed.withColumn("_d", out).select(*df.columns, "inst_key", "name_key", "url_key", "_d.*")


def rescue_and_exclude(decided: DataFrame, legacy: DataFrame, sets: DataFrame) -> DataFrame:
    """A legacy name turns dropped_not_in_seed into keep; an active exclude override turns keep into drop."""
    held = _flag(decided, legacy.select(F.col("institution").alias("i"), F.col("name_key").alias("k")), "legacy_name")
    exclude = sets.filter("action = 'exclude'").select(F.col("institution").alias("i"), "kind", F.col("key").alias("k"))
    for kind in ("name", "url"):
        held = _flag(held, exclude.filter(F.col("kind") == kind), f"exclude_{kind}")
    rescued = (F.col("reason_code") == "dropped_not_in_seed") & F.col("legacy_name")
    keep = rescued | (F.col("decision") == "keep")
    out = keep & (F.col("exclude_name") | F.col("exclude_url"))
    return held.withColumns(
        {
            "decision": F.when(out, "drop").when(rescued, "keep").otherwise(F.col("decision")),
            "reason_code": F.when(out, "override_exclude").when(rescued, "kept_legacy_allowlist").otherwise(F.col("reason_code")),
        }
    ).drop("legacy_name", "exclude_name", "exclude_url")


def filter_institutions(df: DataFrame, listed: str, limit: int | None = None, order: str = "seq") -> DataFrame:
    """Rows of the institutions named in a list with commas or blanks; all for an empty list; optionally the first n."""
    names = list(dict.fromkeys(t for t in listed.replace(",", " ").split() if t))
    out = df.filter(F.col("institution").isin(*names)) if names else df
    return out.orderBy(order).limit(limit) if limit else out


def first_per_key(df: DataFrame, keys: list[Column], order: str | Column = "seq", preserve: Column | None = None) -> DataFrame:
    """The first row of each key in input order; rows for which preserve holds are all kept."""
    parts = [k.alias(f"_key{i}") for i, k in enumerate(keys)]
    held = df.select("*", *parts)
    rank = F.row_number().over(Window.partitionBy(*[f"_key{i}" for i in range(len(keys))]).orderBy(order))
    if preserve is None:
        return held.withColumn("_rank", rank).filter("_rank = 1").select(*df.columns)
    return held.filter(~preserve).withColumn("_rank", rank).filter("_rank = 1").select(*df.columns).unionByName(df.filter(preserve))


def last_per_key(df: DataFrame, keys: list[Column], order: str = "seq") -> DataFrame:
    return first_per_key(df, keys, F.col(order).desc())


def seed_backfill(df: DataFrame, seeds: DataFrame) -> DataFrame:
    """df and the seeds whose (institution, name) it lacks, the first seed of each key."""
    keys = lambda d: d.withColumns({"_i": F.lower(T.norm_space("institution")), "_n": T.name_key("program_name")})
    lacking = keys(seeds).join(keys(df).select("_i", "_n").distinct(), ["_i", "_n"], "left_anti")
    first = first_per_key(lacking, [F.col("_i"), F.col("_n")]).drop("_i", "_n")
    own = ["seq", "institution", "program_name", "credential", "source_url"]
    return df.select(*own, F.lit("index").alias("origin")).unionByName(first.select(*own, F.lit("seed").alias("origin")))


def seed_replace(df: DataFrame, seeds: DataFrame, institution: str) -> DataFrame:
    own = ["seq", "institution", "program_name", "credential", "source_url"]
    kept = df.filter(F.col("institution") != institution).select(*own, F.lit("index").alias("origin"))
    return kept.unionByName(seeds.filter(F.col("institution") == institution).select(*own, F.lit("seed").alias("origin")))


def fill_url_from_seed(df: DataFrame, seeds: DataFrame) -> DataFrame:
    """A seed's http URL where the row's own is none; the first seed of a name."""
    seed = first_per_key(seeds.withColumns({"_i": F.lower(T.norm_space("institution")), "_n": T.name_key("program_name")}), [F.col("_i"), F.col("_n")])
    seed = seed.select("_i", "_n", F.col("source_url").alias("_u"))
    keyed = df.withColumns({"_i": F.lower(T.norm_space("institution")), "_n": T.name_key("program_name")})
    url = F.when(~T.is_http_url("source_url") & T.is_http_url("_u"), F.col("_u")).otherwise(F.col("source_url"))
    return keyed.join(seed, ["_i", "_n"], "left").withColumn("filled_url", url).select(*df.columns, "filled_url")


def concat_notes(notes: DataFrame, keys: list[Column], order: str = "seq", sep: str = " | ") -> DataFrame:
    """Non-blank notes of each key in input order; _k0.. name the keys."""
    held = notes.filter(T.norm_space("notes") != "").select(*[k.alias(f"_k{i}") for i, k in enumerate(keys)], order, T.norm_space("notes").alias("notes"))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "notes")))
    return held.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.array_join(F.transform(rows, lambda x: x["notes"]), sep).alias("notes"))


def index_coverage(df: DataFrame, seeds: DataFrame) -> DataFrame:
    """Rows written and expected per institution."""
    written = df.groupBy("institution").agg(F.count("*").alias("rows_written"))
    target = seeds.groupBy("institution").agg(F.count("*").alias("expected"))
    both = written.join(target, "institution", "full_outer").na.fill(0, ["rows_written", "expected"])
    return both.withColumn("complete", F.col("rows_written") >= F.col("expected"))


def legacy_allowlist(legacy: DataFrame, evidence: DataFrame, rules: Rules) -> DataFrame:
    """First name of each key, without names that evidence marks, blocked names, and keys whose evidence URLs are all blocked."""
    first = first_per_key(legacy.withColumn("name_key", T.name_key("program_name")).filter("name_key <> ''"), [F.col("name_key")])
    low = F.lower(T.norm_space("notes"))
    marked = T.any_of([F.lit(False)] + [F.contains(low, F.lit(t)) for t in rules.evidence_tokens])
    seen = evidence.groupBy(T.name_key("program_name").alias("name_key")).agg(F.max(marked).alias("marked"), F.min(_matches(F.col("source_url"), rules.blocked_urls)).alias("all_blocked"))
    held = first.join(seen, "name_key", "left").filter(~F.coalesce("marked", F.lit(False)) & ~F.coalesce("all_blocked", F.lit(False)))
    return held.filter(~_matches(F.col("program_name"), rules.blocked_names)).select("name_key", "program_name")
