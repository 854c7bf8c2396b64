"""Queries of filters (FI), joins (JO), fuzzy matching (MA), aggregates (AG) and ranking (WI)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import curation as C
from sievework.operators.fuzzy import best_fuzzy_match
from sievework.operators.lookups import tiered_lookup
from sievework.plans.keys import BLANKISH, FOLD, HTTP, NB, NK, NS, TOKENS, UK
from sievework.plans.registry import query

#: Rules of the queries: news and apply pages, titles that are no programs, notes that say so, one name that always stays.
RULES = C.Rules(("/(apply|news|events)/",), ("^how to apply", "^tuition"), ("not a program",), ("red ring economy",), ("https://school.example.org/programs/77",))
EVIDENCE, BLOCK_URL, BLOCK_NAME = "not a program", "(?i)/(apply|news|events)/", "(?i)^how to apply|^tuition"

REQUIRED = ["institution", "program_name", "source_url"]
_LACKS = f"({NB('institution')} = '' OR {NB('program_name')} = '' OR {NB('source_url')} = '')"


@query("fi01_require_fields", "v_index", sql=f"SELECT seq, CASE WHEN {_LACKS} THEN 'drop' ELSE 'keep' END AS decision, CASE WHEN {_LACKS} THEN 'dropped_missing_required' ELSE '' END AS reason_code FROM v_index")
def fi01(df: DataFrame) -> DataFrame:
    return C.require_fields(df, REQUIRED).select("seq", "decision", "reason_code")


SETS = f"""sets AS (SELECT DISTINCT lower({NS('institution')}) AS institution, lower({NS('include_or_exclude')}) AS action, kind, key FROM (
    SELECT *, unnest(['name', 'url', 'url']) AS kind, unnest([{NK('program')}, {UK('source_page_url')}, {UK('parent_admissions_url')}]) AS key FROM v_overrides
    WHERE lower({NS('include_or_exclude')}) IN ('include', 'exclude') AND lower({NS('status')}) NOT IN ('inactive', 'disabled', 'archived', 'off', 'no', 'false', '0')) WHERE key <> '')"""
DECIDED = f"""{SETS}, keyed AS (SELECT *, lower({NS('institution')}) AS ik, {NK('program_name')} AS nk, {UK('source_url')} AS uk FROM v_index),
  decided AS (SELECT k.*, CASE WHEN contains(lower({NS('notes')}), '{EVIDENCE}') THEN 'dropped_evidence_non_program' WHEN regexp_matches(source_url, '{BLOCK_URL}') THEN 'dropped_blocked_url'
    WHEN regexp_matches(program_name, '{BLOCK_NAME}') THEN 'dropped_blocked_name'
    WHEN nk = 'red ring economy' OR uk = 'https://school.example.org/programs/77' OR (ik, nk) IN (SELECT (institution, key) FROM sets WHERE action = 'include' AND kind = 'name')
      OR (ik, uk) IN (SELECT (institution, key) FROM sets WHERE action = 'include' AND kind = 'url') THEN 'kept_allowlist_override'
    WHEN nk <> '' AND (ik, nk) IN (SELECT (lower({NS('institution')}), {NK('program_name')}) FROM v_seed) THEN 'kept_seed_match' ELSE 'dropped_not_in_seed' END AS reason_code FROM keyed k)"""


@query("fi02_classify_rows", "v_index", "v_seed", "v_overrides", sql=f"WITH {DECIDED} SELECT seq, split_part(replace(reason_code, 'kept', 'keep'), '_', 1).replace('dropped', 'drop') AS decision, reason_code FROM decided")
def fi02(df: DataFrame, seeds: DataFrame, ov: DataFrame) -> DataFrame:
    return C.classify_rows(df, RULES, seeds, C.override_sets(ov)).select("seq", "decision", "reason_code")


LEGACY = f"legacy AS (SELECT DISTINCT lower({NS('institution')}) AS institution, {NK('program_name')} AS name_key FROM v_index WHERE seq % 6 = 1 AND {NK('program_name')} <> '')"
FINAL = f"""{DECIDED}, {LEGACY}, final AS (SELECT d.*, CASE WHEN reason_code = 'dropped_not_in_seed' AND (ik, nk) IN (SELECT (institution, name_key) FROM legacy) THEN 'kept_legacy_allowlist' ELSE reason_code END AS r FROM decided d),
  excluded AS (SELECT f.*, CASE WHEN r LIKE 'kept%' AND ((ik, nk) IN (SELECT (institution, key) FROM sets WHERE action = 'exclude' AND kind = 'name') OR (ik, uk) IN (SELECT (institution, key) FROM sets WHERE action = 'exclude' AND kind = 'url')) THEN 'override_exclude' ELSE r END AS reason FROM final f)"""


def _legacy(df: DataFrame) -> DataFrame:
    return df.filter("seq % 6 = 1").select(F.lower(T.norm_space("institution")).alias("institution"), T.name_key("program_name").alias("name_key")).filter("name_key <> ''").distinct()


def _final(df: DataFrame, seeds: DataFrame, ov: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """listed: the rows that legacy names are read from, where df is but some of them."""
    sets = C.override_sets(ov)
    return C.rescue_and_exclude(C.classify_rows(df, RULES, seeds, sets), _legacy(df if listed is None else listed), sets)


@query("fi03_rescue_and_exclude", "v_index", "v_seed", "v_overrides", sql=f"WITH {FINAL} SELECT seq, CASE WHEN reason LIKE 'kept%' THEN 'keep' ELSE 'drop' END AS decision, reason AS reason_code FROM excluded")
def fi03(df: DataFrame, seeds: DataFrame, ov: DataFrame) -> DataFrame:
    return _final(df, seeds, ov).select("seq", "decision", "reason_code")


@query("fi04_filter_institutions", "v_index", sql="SELECT seq, institution FROM v_index WHERE institution IN ('North', 'West')")
def fi04(df: DataFrame) -> DataFrame:
    return C.filter_institutions(df, "North, West North").select("seq", "institution")


@query("fi05_override_sets", "v_overrides", sql=f"WITH {SETS} SELECT * FROM sets")
def fi05(ov: DataFrame) -> DataFrame:
    return C.override_sets(ov)


@query(
    "fi05_override_trace", "v_overrides",
    sql=f"""SELECT seq, lower({NS('institution')}) AS institution, CASE WHEN include_or_exclude = 'include' THEN 'keep' ELSE 'drop' END AS decision, concat('override_', include_or_exclude) AS reason_code,
      CASE WHEN {NS('source_page_url')} <> '' THEN {NS('source_page_url')} ELSE {NS('parent_admissions_url')} END AS source_url FROM v_overrides WHERE include_or_exclude IN ('include', 'exclude') AND lower(status) <> 'archived'""",
)
def fi05_trace(ov: DataFrame) -> DataFrame:
    return C.override_trace(ov)


@query("fi07_drop_named", "v_canonical", sql="SELECT row_id FROM v_canonical WHERE lower(credential_type) <> 'other' AND NOT (institution = 'North' AND contains(program_url, '/programs/10'))")
def fi07(df: DataFrame) -> DataFrame:
    """Without one credential class, and without the rows of a drop table (institution, URL part)."""
    kept = df.filter(F.lower(T.norm_space("credential_type")) != "other").alias("d")
    drops = df.sparkSession.createDataFrame([("North", "/programs/10")], "institution string, part string").alias("x")
    return kept.join(drops, F.expr("d.institution = x.institution AND contains(d.program_url, x.part)"), "left_anti").select("row_id")


@query("fi08_visible_active", "v_canonical", sql=f"SELECT row_id FROM v_canonical WHERE lower({NS('display_for_high_school')}) <> 'no' AND lower({NS('status')}) IN ('', 'active') AND {NS('program')} <> ''")
def fi08(df: DataFrame) -> DataFrame:
    return df.filter((F.lower(T.norm_space("display_for_high_school")) != "no") & F.lower(T.norm_space("status")).isin("", "active") & (T.norm_space("program") != "")).select("row_id")


NOTES = f"SELECT {FOLD('institution', 'program_name', 'source_url')} AS k0, string_agg({NS('notes')}, ' | ' ORDER BY seq) AS notes FROM v_index WHERE {NS('notes')} <> '' GROUP BY 1"


@query("ag01_concat_notes", "v_index", sql=NOTES)
def ag01(df: DataFrame) -> DataFrame:
    return C.concat_notes(df, [T.folded_key(*REQUIRED)]).withColumnRenamed("_k0", "k0")


@query("jo01_attach_evidence", "v_index", sql=f"WITH n AS ({NOTES}) SELECT seq, CASE WHEN {NS('v.notes')} <> '' AND n.notes IS NOT NULL THEN concat({NS('v.notes')}, ' | ', n.notes) ELSE coalesce(n.notes, {NS('v.notes')}) END AS evidence FROM v_index v LEFT JOIN n ON n.k0 = {FOLD('institution', 'program_name', 'source_url')}")
def jo01(df: DataFrame) -> DataFrame:
    notes = C.concat_notes(df, [T.folded_key(*REQUIRED)]).withColumnRenamed("notes", "keyed")
    held = df.withColumn("_k0", T.folded_key(*REQUIRED)).join(notes, "_k0", "left")
    own = F.when(T.norm_space("notes") != "", T.norm_space("notes"))
    return held.select("seq", F.concat_ws(" | ", own, "keyed").alias("evidence"))


BACKFILL = f"""back AS (SELECT seq, institution, program_name, credential, source_url, 'index' AS origin FROM v_index UNION ALL
  SELECT seq, institution, program_name, credential, source_url, 'seed' FROM (SELECT *, row_number() OVER (PARTITION BY lower({NS('institution')}), {NK('program_name')} ORDER BY seq) AS n FROM v_seed
    WHERE (lower({NS('institution')}), {NK('program_name')}) NOT IN (SELECT (lower({NS('institution')}), {NK('program_name')}) FROM v_index)) WHERE n = 1)"""


@query("jo02_seed_replace", "v_index", "v_seed", sql="SELECT seq, institution, program_name, credential, source_url, 'index' AS origin FROM v_index WHERE institution <> 'South' UNION ALL SELECT seq, institution, program_name, credential, source_url, 'seed' FROM v_seed WHERE institution = 'South'")
def jo02(df: DataFrame, seeds: DataFrame) -> DataFrame:
    return C.seed_replace(df, seeds, "South")


@query("jo03_seed_backfill", "v_index", "v_seed", sql=f"WITH {BACKFILL} SELECT * FROM back")
def jo03(df: DataFrame, seeds: DataFrame) -> DataFrame:
    return C.seed_backfill(df, seeds)


@query(
    "jo04_fill_url_from_seed", "v_index", "v_seed",
    sql=f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY lower({NS('institution')}), {NK('program_name')} ORDER BY seq) AS n FROM v_seed)
      SELECT v.seq, CASE WHEN NOT {HTTP('v.source_url')} AND {HTTP('s.source_url')} THEN s.source_url ELSE v.source_url END AS filled_url FROM v_index v LEFT JOIN s ON s.n = 1 AND lower({NS('v.institution')}) = lower({NS('s.institution')}) AND {NK('v.program_name')} = {NK('s.program_name')}""",
)
def jo04(df: DataFrame, seeds: DataFrame) -> DataFrame:
    return C.fill_url_from_seed(df, seeds).select("seq", "filled_url")


def _tier(names: list[str]):
    parts = {"institution": lambda d: F.lower(T.norm_space(d["institution"])), "program": lambda d: T.name_key(d["program"]), "credential": lambda d: F.lower(T.norm_space(d["credential_type"])), "url": lambda d: T.url_key(d["program_url"])}

    def key(d):
        own = [parts[n](d) for n in names]
        blank = T.any_of([p == "" for p in own])
        return F.when(~blank, F.concat_ws("||", *own)).otherwise("")

    return key


TIERS = [["institution", "program", "credential", "url"], ["institution", "program", "url"], ["institution", "program", "credential"], ["institution", "program"]]


def match_canonical(can: DataFrame, cand: DataFrame) -> DataFrame:
    tiers = [("row_id", can["row_id"].cast("string"), F.when(F.col("cand_id") % 50 == 0, cand["cand_id"].cast("string")).otherwise(""))]
    tiers += [("_".join(n[1:]), _tier(n)(can), _tier(n)(cand)) for n in TIERS]
    return tiered_lookup(can, cand, tiers, "row_id", "cand_id")


_P = {"institution": lambda a: f"lower({NS(f'{a}.institution')})", "program": lambda a: NK(f"{a}.program"), "credential": lambda a: f"lower({NS(f'{a}.credential_type')})", "url": lambda a: UK(f"{a}.program_url")}
MATCH = (
    "found AS (SELECT c.row_id, 0 AS t, 'row_id' AS tier, x.cand_id FROM v_canonical c JOIN v_candidate x ON x.cand_id % 50 = 0 AND x.cand_id = c.row_id"
    + "".join(
        f" UNION ALL SELECT c.row_id, {i} AS t, '{'_'.join(n[1:])}', x.cand_id FROM v_canonical c JOIN v_candidate x ON "
        + " AND ".join(f"{_P[p]('c')} = {_P[p]('x')} AND {_P[p]('c')} <> ''" for p in n)
        for i, n in enumerate(TIERS, 1)
    )
    + "), top AS (SELECT row_id, min(t) AS t FROM found GROUP BY 1), m AS (SELECT c.row_id, max(f.tier) AS tier, count(f.cand_id) AS n, min(f.cand_id) AS cand FROM v_canonical c LEFT JOIN top USING (row_id) LEFT JOIN found f ON f.row_id = c.row_id AND f.t = top.t GROUP BY 1)"
)


@query("jo08_match_canonical", "v_canonical", "v_candidate", sql=f"WITH {MATCH} SELECT row_id AS left_id, CASE WHEN n = 1 THEN cand END AS right_id, tier, CASE n WHEN 0 THEN 'missing' WHEN 1 THEN 'matched' ELSE 'ambiguous' END AS status FROM m")
def jo08(can: DataFrame, cand: DataFrame) -> DataFrame:
    return match_canonical(can, cand)


FIELDS = ["min_avg_final", "avg_total"]


def diff_runs(base: DataFrame, cand: DataFrame, fields: list[str]) -> DataFrame:
    """Fields that differ between two runs, matched by program key; a row missing on one side differs in its filled fields."""
    key = lambda d: T.override_key(d["institution"], d["program"], d["credential_type"])
    one = lambda d, p, seq: C.first_per_key(d.withColumn("key", key(d)).filter("key <> ''"), [F.col("key")], seq).select("key", *[T.norm_or_blank(f).alias(f"{p}_{f}") for f in fields])
    both = one(base, "base", "row_id").join(one(cand, "cand", "cand_id"), "key", "full_outer")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(f"base_{f}", F.lit("")).alias("base"), F.coalesce(f"cand_{f}", F.lit("")).alias("cand")) for f in fields])
    return both.select("key", F.explode(F.filter(pairs, lambda p: p["base"] != p["cand"])).alias("d")).select("key", "d.*")


_OK = lambda t: f"concat_ws('||', lower({NS('institution')}), {NK('program')}, lower({NS('credential_type')}))"
_ONE = lambda t, i: f"(SELECT * FROM (SELECT {_OK(t)} AS key, *, row_number() OVER (PARTITION BY {_OK(t)} ORDER BY {i}) AS n FROM {t}) WHERE n = 1)"


@query(
    "jo09_diff_runs", "v_canonical", "v_candidate",
    sql=f"""WITH b AS {_ONE('v_canonical', 'row_id')}, c AS {_ONE('v_candidate', 'cand_id')},
      j AS (SELECT coalesce(b.key, c.key) AS key, {', '.join(f"coalesce({NB(f'b.{f}')}, '') AS b_{f}, coalesce({NB(f'c.{f}')}, '') AS c_{f}" for f in FIELDS)} FROM b FULL JOIN c ON b.key = c.key)
      {' UNION ALL '.join(f"SELECT key, '{f}' AS field, b_{f} AS base, c_{f} AS cand FROM j WHERE b_{f} <> c_{f}" for f in FIELDS)}""",
)
def jo09(can: DataFrame, cand: DataFrame) -> DataFrame:
    return diff_runs(can, cand, FIELDS)


@query("jo12_candidate_only", "v_canonical", "v_candidate", sql=f"WITH {MATCH} SELECT cand_id FROM v_candidate WHERE cand_id NOT IN (SELECT cand FROM m WHERE n = 1)")
def jo12(can: DataFrame, cand: DataFrame) -> DataFrame:
    used = match_canonical(can, cand).filter("status = 'matched'").select(F.col("right_id").alias("cand_id"))
    return cand.select("cand_id").join(used.hint("merge"), "cand_id", "left_anti")


@query(
    "jo13_match_ruleset", "v_canonical",
    sql=f"""WITH rules(k, scope, pattern, avg_total) AS (VALUES ('a', 'degree|diploma', 'alberta', 5), ('b', 'any', '', 4), ('c', 'certificate', '', 3)),
      hit AS (SELECT c.row_id, r.*, row_number() OVER (PARTITION BY c.row_id ORDER BY (pattern <> '')::INT + (scope <> 'any')::INT DESC, k) AS n FROM v_canonical c JOIN rules r
        ON (scope = 'any' OR len(list_filter(string_split(scope, '|'), lambda s: contains(lower({NS('credential_type')}), s))) > 0)
        AND (pattern = '' OR contains(lower({NS('requirement_type')}), pattern)))
      SELECT row_id, k AS rule_key, avg_total FROM hit WHERE n = 1""",
)
def jo13(df: DataFrame) -> DataFrame:
    """The most specific rule whose scope and pattern fit a row; equals by key."""
    rules = df.sparkSession.createDataFrame([("a", "degree|diploma", "alberta", 5), ("b", "any", "", 4), ("c", "certificate", "", 3)], "k string, scope string, pattern string, rule_total int")
    cred, kind = F.lower(T.norm_space("credential_type")), F.lower(T.norm_space("requirement_type"))
    fits = (F.col("scope") == "any") | F.exists(F.split("scope", r"[|,;/]"), lambda s: F.contains(cred, s))
    hit = df.join(rules, fits & ((F.col("pattern") == "") | F.contains(kind, F.col("pattern"))))
    special = (F.col("pattern") != "").cast("int") + (F.col("scope") != "any").cast("int")
    best = hit.groupBy("row_id").agg(F.min_by(F.struct("k", "rule_total"), F.struct(-special, "k")).alias("r"))
    return best.select("row_id", F.col("r.k").alias("rule_key"), F.col("r.rule_total").alias("avg_total"))


@query(
    "ma01_best_fuzzy_match", "v_index", "v_seed",
    sql=f"""WITH l AS (SELECT seq AS id, institution AS block, {TOKENS('program_name')} AS tk FROM v_index), r AS (SELECT seq AS id, institution AS block, {TOKENS('program_name')} AS tk, {NK('program_name')} AS name, {UK('source_url')} AS url FROM v_seed),
      s AS (SELECT l.id AS l, r.id AS r, name, url, len(list_intersect(l.tk, r.tk)) / (len(l.tk) + len(r.tk) - len(list_intersect(l.tk, r.tk)))::DOUBLE AS score FROM l JOIN r USING (block) WHERE len(list_intersect(l.tk, r.tk)) > 0),
      b AS (SELECT *, max(score) OVER (PARTITION BY l) AS best FROM s), near AS (SELECT * FROM b WHERE best >= 0.62 AND best - score < 0.1),
      g AS (SELECT l, max(best) AS score, count(*) AS n, count(DISTINCT name) AS names, arg_max(r, (score, -r)) AS r FROM near GROUP BY l)
      SELECT l.id AS left_id, CASE WHEN names = 1 THEN g.r END AS right_id, g.score, CASE WHEN g.l IS NULL THEN 'none' WHEN names = 1 THEN 'matched' ELSE 'ambiguous' END AS status FROM l LEFT JOIN g ON g.l = l.id""",
)
def ma01(df: DataFrame, seeds: DataFrame) -> DataFrame:
    tokens = T.program_tokens("program_name")
    left = df.select(F.col("seq").alias("id"), F.col("institution").alias("block"), tokens.alias("tokens"))
    right = seeds.select(F.col("seq").alias("id"), F.col("institution").alias("block"), tokens.alias("tokens"), T.name_key("program_name").alias("name"), T.url_key("source_url").alias("url"))
    return best_fuzzy_match(left, right, 0.62, 0.10, "distinct_name")


_COVER = f"""WITH {FINAL}, kept AS (SELECT * FROM excluded WHERE reason LIKE 'kept%' AND NOT {_LACKS}),
  dedup AS (SELECT institution FROM (SELECT *, row_number() OVER (PARTITION BY lower({NS('institution')}), lower({NB('program_name')}), lower({NB('source_url')}) ORDER BY seq) AS n FROM kept) WHERE n = 1),
  w AS (SELECT institution, count(*) AS rows_written FROM dedup GROUP BY 1), s AS (SELECT institution, count(*) AS expected FROM v_seed GROUP BY 1)
  SELECT institution, coalesce(rows_written, 0) AS rows_written, coalesce(expected, 0) AS expected, coalesce(rows_written, 0) >= coalesce(expected, 0) AS complete FROM w FULL JOIN s USING (institution)"""


@query("ag02_index_coverage", "v_index", "v_seed", "v_overrides", sql=_COVER)
def ag02(df: DataFrame, seeds: DataFrame, ov: DataFrame) -> DataFrame:
    """Required fields, the rule cascade, overrides, first rows, then rows against targets: the whole index stage."""
    kept = _final(C.require_fields(df, REQUIRED).filter("decision = 'keep'").select(*df.columns), seeds, ov, df).filter("decision = 'keep'")
    first = C.first_per_key(kept, [F.lower(T.norm_or_blank(c)) for c in REQUIRED])
    return C.index_coverage(first, seeds)


@query("ag02_reason_counts", "v_index", "v_seed", "v_overrides", sql=f"WITH {FINAL} SELECT institution, reason AS reason_code, count(*) AS n FROM excluded GROUP BY ALL")
def ag02_reasons(df: DataFrame, seeds: DataFrame, ov: DataFrame) -> DataFrame:
    return _final(df, seeds, ov).groupBy("institution", "reason_code").agg(F.count("*").alias("n"))


_FILLED = ["min_avg_final", "avg_total", "english_req", "math_req", "science_req", "elective_qty"]


@query("ag03_field_coverage", "v_canonical", sql=" UNION ALL ".join(f"SELECT '{f}' AS field, count(*) FILTER (WHERE {NB(f)} <> '') AS filled FROM v_canonical" for f in _FILLED))
def ag03(df: DataFrame) -> DataFrame:
    one = df.agg(*[F.count_if(T.norm_or_blank(f) != "").alias(f) for f in _FILLED])
    return one.unpivot([], _FILLED, "field", "filled")


@query("ag04_coverage_delta", "v_canonical", "v_candidate", sql=" UNION ALL ".join(f"SELECT '{f}' AS field, (SELECT count(*) FROM v_canonical WHERE {NB(f)} <> '') AS base, (SELECT count(*) FROM v_candidate WHERE {NB(f)} <> '') AS cand, (SELECT count(*) FROM v_candidate WHERE {NB(f)} <> '') - (SELECT count(*) FROM v_canonical WHERE {NB(f)} <> '') AS delta" for f in FIELDS))
def ag04(base: DataFrame, cand: DataFrame) -> DataFrame:
    long = lambda d, n: d.agg(*[F.count_if(T.norm_or_blank(f) != "").alias(f) for f in FIELDS]).unpivot([], FIELDS, "field", n)
    return long(base, "base").join(long(cand, "cand"), "field").withColumn("delta", F.col("cand") - F.col("base"))


_SIG = ["institution", "program", "credential_type", "status", "program_url"]


@query("ag05_exact_duplicates", "v_canonical", sql=f"SELECT {FOLD(*_SIG)} AS signature, count(*) AS n FROM v_canonical GROUP BY 1 HAVING count(*) > 1")
def ag05(df: DataFrame) -> DataFrame:
    return df.groupBy(T.folded_key(*_SIG).alias("signature")).agg(F.count("*").alias("n")).filter("n > 1")


@query("ag06_key_collisions", "v_canonical", sql=f"SELECT {FOLD('institution', 'program', 'credential_type')} AS key, count(DISTINCT {FOLD('min_avg_final', 'english_req', 'math_req')}) AS payloads FROM v_canonical GROUP BY 1 HAVING count(DISTINCT {FOLD('min_avg_final', 'english_req', 'math_req')}) > 1")
def ag06(df: DataFrame) -> DataFrame:
    return df.groupBy(T.folded_key("institution", "program", "credential_type").alias("key")).agg(F.count_distinct(T.folded_key("min_avg_final", "english_req", "math_req")).alias("payloads")).filter("payloads > 1")


@query("ag07_visible_duplicates", "v_canonical", sql=f"SELECT {FOLD('institution', 'program', 'credential_type', 'status')} AS key, count(*) AS n FROM v_canonical WHERE {NS('display_for_high_school')} = 'Yes' GROUP BY 1 HAVING count(*) > 1")
def ag07(df: DataFrame) -> DataFrame:
    return df.filter(T.norm_space("display_for_high_school") == "Yes").groupBy(T.folded_key("institution", "program", "credential_type", "status").alias("key")).agg(F.count("*").alias("n")).filter("n > 1")


_RATES = ["english_req", "math_req", "min_avg_final", "requirement_type"]


@query("ag08_blank_rates", "v_canonical", sql="SELECT * FROM (" + " UNION ALL ".join(f"SELECT institution, '{f}' AS field, avg(({BLANKISH(f)})::INT) AS rate FROM v_canonical GROUP BY 1 HAVING count(*) >= 10" for f in _RATES) + ") WHERE rate >= 0.3")
def ag08(df: DataFrame, warn: float = 0.3, least: int = 10) -> DataFrame:
    wide = df.groupBy("institution").agg(F.count("*").alias("n"), *[F.avg(T.is_blankish(f).cast("int")).alias(f) for f in _RATES]).filter(F.col("n") >= least)
    return wide.unpivot(["institution"], _RATES, "field", "rate").filter(F.col("rate") >= warn)


@query("ag10_row_drop_gate", "v_canonical", "v_candidate", sql="SELECT b AS base_rows, c AS cand_rows, (b - c) / b::DOUBLE AS drop_share, (b - c) / b::DOUBLE > 0.35 AS failed FROM (SELECT (SELECT count(*) FROM v_canonical) AS b, (SELECT count(*) FROM v_candidate) AS c)")
def ag10(base: DataFrame, cand: DataFrame) -> DataFrame:
    b, c = base.agg(F.count("*").alias("base_rows")), cand.agg(F.count("*").alias("cand_rows"))
    share = (F.col("base_rows") - F.col("cand_rows")) / F.col("base_rows")
    return b.join(c).withColumns({"drop_share": share, "failed": share > 0.35})  # one row each


@query(
    "ag11_legacy_allowlist", "v_seed", "v_index",
    sql=f"""WITH f AS (SELECT {NK('program_name')} AS name_key, arg_min(program_name, seq) AS program_name FROM v_seed WHERE {NK('program_name')} <> '' GROUP BY 1),
      e AS (SELECT {NK('program_name')} AS name_key, bool_or(contains(lower({NS('notes')}), '{EVIDENCE}')) AS marked, bool_and(regexp_matches(source_url, '{BLOCK_URL}')) AS blocked FROM v_index GROUP BY 1)
      SELECT name_key, program_name FROM f LEFT JOIN e USING (name_key) WHERE NOT coalesce(marked, false) AND NOT coalesce(blocked, false) AND NOT regexp_matches(program_name, '{BLOCK_NAME}')""",
)
def ag11(legacy: DataFrame, evidence: DataFrame) -> DataFrame:
    return C.legacy_allowlist(legacy, evidence, RULES)


@query("ag12_ruleset_seed_pack", "v_canonical", sql="SELECT lower(institution) AS institution, lower(credential_type) AS credential, count(*) AS n, array_to_string(list_sort(list(DISTINCT program))[:5], ' | ') AS examples FROM v_canonical GROUP BY 1, 2")
def ag12(df: DataFrame) -> DataFrame:
    """A placeholder rule per institution and credential with its first five programs by name."""
    keyed = df.select(F.lower("institution").alias("institution"), F.lower("credential_type").alias("credential"), "program")
    counts = keyed.groupBy("institution", "credential").agg(F.count("*").alias("n"))
    names = keyed.distinct().withColumn("at", F.row_number().over(Window.partitionBy("institution", "credential").orderBy("program"))).filter("at <= 5")
    five = names.groupBy("institution", "credential").agg(F.array_join(F.array_sort(F.collect_list("program")), " | ").alias("examples"))
    return counts.join(five, ["institution", "credential"])


@query("ag14_unique_candidate_value", "v_candidate", sql=f"SELECT {FOLD('institution', 'program')} AS key, min(avg_total) AS value FROM v_candidate WHERE {NS('avg_total')} <> '' GROUP BY 1 HAVING count(DISTINCT {NS('avg_total')}) = 1")
def ag14(df: DataFrame) -> DataFrame:
    held = df.filter(T.norm_space("avg_total") != "").groupBy(T.folded_key("institution", "program").alias("key"))
    return held.agg(F.min("avg_total").alias("value"), F.count_distinct(T.norm_space("avg_total")).alias("n")).filter("n = 1").drop("n")


@query("ag15_institution_counts", "v_index", sql="WITH r(institution) AS (VALUES ('North'), ('South'), ('East'), ('West'), ('Central'), ('Coast')) SELECT r.institution, count(v.seq) AS n, count(v.seq) = 0 AS missing FROM r LEFT JOIN v_index v USING (institution) GROUP BY 1")
def ag15(df: DataFrame) -> DataFrame:
    need = df.sparkSession.createDataFrame([(x,) for x in ("North", "South", "East", "West", "Central", "Coast")], "institution string")
    counts = df.groupBy("institution").agg(F.count("*").alias("n"))
    return need.join(counts, "institution", "left").select("institution", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("missing"))


@query("wi01_dedupe_first", "v_index", sql=f"SELECT seq FROM v_index WHERE institution = 'East' UNION ALL SELECT seq FROM (SELECT seq, row_number() OVER (PARTITION BY lower({NB('institution')}), lower({NB('program_name')}), lower({NB('source_url')}) ORDER BY seq) AS n FROM v_index WHERE institution <> 'East') WHERE n = 1")
def wi01(df: DataFrame) -> DataFrame:
    return C.first_per_key(df, [F.lower(T.norm_or_blank(c)) for c in REQUIRED], preserve=F.col("institution") == "East").select("seq")


@query("wi02_last_write_wins", "v_marks", sql="SELECT student_id, course, arg_max(mark, (taken, seq)) AS mark FROM v_marks GROUP BY ALL")
def wi02(marks: DataFrame) -> DataFrame:
    """As an aggregate: no sort, and a partial result per task before the shuffle."""
    return marks.groupBy("student_id", "course").agg(F.max_by("mark", F.struct("taken", "seq")).alias("mark"))


@query("wi03_row_ids", "v_canonical", sql="SELECT row_id, concat('canonical_', lpad((row_id + 1)::VARCHAR, 6, '0')) AS canonical_id FROM v_canonical")
def wi03(df: DataFrame) -> DataFrame:
    """From the stored input position, so that no global sort is needed."""
    return df.select("row_id", F.concat(F.lit("canonical_"), F.lpad((F.col("row_id") + 1).cast("string"), 6, "0")).alias("canonical_id"))


@query("wi08_keep_last_n", "v_requests", sql="SELECT seq FROM v_requests ORDER BY ts DESC, seq DESC LIMIT 2000")
def wi08(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("ts"), F.desc("seq")).limit(2000).select("seq")


@query("wi10_distinct_preserving", "v_canonical", sql=f"SELECT institution, program, credential_type FROM v_canonical WHERE institution = 'East' UNION ALL (SELECT DISTINCT institution, program, credential_type FROM v_canonical WHERE institution <> 'East')")
def wi10(df: DataFrame) -> DataFrame:
    own = df.select("institution", "program", "credential_type")
    return own.filter("institution = 'East'").unionByName(own.filter("institution <> 'East'").distinct())


@query("wi11_set_operations", "v_canonical", "v_candidate", sql=f"SELECT key, bool_or(a) AS in_base, bool_or(NOT a) AS in_cand FROM (SELECT {FOLD('institution', 'program')} AS key, true AS a FROM v_canonical UNION SELECT {FOLD('institution', 'program')}, false FROM v_candidate) GROUP BY 1")
def wi11(base: DataFrame, cand: DataFrame) -> DataFrame:
    side = lambda d, a: d.select(T.folded_key("institution", "program").alias("key"), F.lit(a).alias("a"))
    return side(base, True).unionByName(side(cand, False)).groupBy("key").agg(F.max("a").alias("in_base"), F.max(~F.col("a")).alias("in_cand"))
