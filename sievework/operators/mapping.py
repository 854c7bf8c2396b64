"""Rows onto rows: override sheets, plans, URLs, links, course counts, seed checks, rule suggestions, post-passes.

Lookups are equi-joins on keys that were counted first; what must be unique is checked by the least and the greatest
value of a key. Only the fuzzy step joins on tokens, between distinct token sets of an institution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import extract as X
from sievework.operators.fuzzy import similar_sets
from sievework.operators.merge import resolve_override

# Bonus of equal and malus of different credential classes in a fuzzy score.
SAME_CLASS, OTHER_CLASS = 0.05, -0.04
# Points of a suggested rule.
RULE_POINTS = (("Group B", 100), ("Group D", 60), ("Each subject must be", 30))


def _dashed(c: Column | str) -> Column:
    base = F.regexp_replace(F.regexp_replace(F.lower(T.norm_space(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(base == "", "item").otherwise(base)


def tidy_number(c: Column | str) -> Column:
    """A number with at most two digits of fraction, without trailing zeros; '' for anything else."""
    n = T.norm_space(c).try_cast("double")
    cut = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", n), "0+$", ""), r"\.$", "")
    return F.coalesce(F.when(n == F.floor(n), n.cast("long").cast("string")).otherwise(F.when(n.isNotNull(), cut)), F.lit(""))


def http_or_blank(c: Column | str) -> Column:
    return F.when(T.is_http_url(c), T.norm_space(c)).otherwise("")


def import_overrides(sheet: DataFrame) -> DataFrame:
    """A review sheet (seq: its row number) as override rows: defaults, tidy numbers, http URLs, joined notes, flags."""
    kind = F.lower(T.norm_space("signal_type"))
    told = F.lower(T.norm_space("include_or_exclude"))
    decided = F.when(told.isin("include", "exclude"), told).otherwise("include")
    parent = http_or_blank("parent_admissions_url")
    lacks = F.contains(kind, F.lit("inheritance")) & (decided == "include") & (parent == "")
    notes = F.array_join(F.filter(F.array(T.norm_space("notes"), T.norm_space("why")), lambda x: x != ""), " | ")
    return sheet.select(
        F.concat(_dashed("institution"), F.lit("-"), _dashed("program"), F.lit("-"), F.format_string("%02d", "seq")).alias("override_key"), T.norm_space("institution").alias("institution"), T.norm_space("program").alias("program"),
        T.norm_space("credential").alias("credential_type"), T.norm_space("status").alias("status"), http_or_blank("page_url").alias("source_page_url"), decided.alias("include_or_exclude"), kind.alias("signal_type"),
        T.norm_space("requirement_type").alias("requirement_type_override"), tidy_number("min_avg").alias("min_avg_override"), T.norm_space("elective_qty").alias("elective_qty_override"),
        F.regexp_extract(F.lower(T.norm_space("avg_total")), r"\b([1-9]|10)\b", 1).alias("avg_total_override"), parent.alias("parent_admissions_url"), T.norm_space("requirements_selector").alias("requirements_selector"),
        T.norm_space("links_selector").alias("admissions_links_selector"), T.norm_space("proof_text").alias("proof_text"), notes.alias("notes"), F.when(lacks, "yes").otherwise("no").alias("needs_parent_source"),
        F.when(F.contains(kind, F.lit("manual")), "yes").otherwise("no").alias("manual_review_flag"),
    )


def name_tokens(c: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(T.name_key(c), " "), lambda x: x != ""))


def select_plan(programs: DataFrame, plans: DataFrame) -> DataFrame:
    """program_id, plan_seq: the plan of each program (program_id, name, plan_code, subplan_code) among its plans
    (program_id, plan_seq, plan_code, subplan_codes, name).

    Plans with the code, else all; of these, those with the sub-plan's code, else all; then the best share of common name
    tokens, then the first.
    """
    up = lambda c: F.upper(T.norm_space(c))
    want = programs.select("program_id", up("plan_code").alias("code"), up("subplan_code").alias("sub"), name_tokens("name").alias("tokens"))
    have = plans.select("program_id", "plan_seq", up("plan_code").alias("own"), F.transform("subplan_codes", lambda x: F.upper(F.trim(x))).alias("subs"), name_tokens("name").alias("names"))
    held = want.join(have, "program_id").withColumns({"a": (F.col("code") != "") & (F.col("own") == F.col("code")), "b": (F.col("sub") != "") & F.array_contains("subs", F.col("sub"))})
    some = held.groupBy("program_id").agg(F.max("a").alias("any_a"))
    held = held.join(some, "program_id").filter(F.col("a") | ~F.col("any_a"))
    some = held.groupBy("program_id").agg(F.max("b").alias("any_b"))
    held = held.join(some, "program_id").filter(F.col("b") | ~F.col("any_b"))
    both = F.size(F.array_intersect("tokens", "names"))
    score = F.when(both > 0, both / F.size(F.array_union("tokens", "names"))).otherwise(0.0)
    return held.groupBy("program_id").agg(F.max_by("plan_seq", F.struct(score, -F.col("plan_seq"))).alias("plan_seq"))


def class_of(credential: Column | str) -> Column:
    t = F.lower(T.norm_space(credential))
    return F.when(t.rlike("bachelor|degree"), "degree").when(t.rlike("diploma"), "diploma").when(t.rlike("certificate"), "certificate").when(t.rlike("minor"), "minor").otherwise("other")


def map_program_urls(rows: DataFrame, index: DataFrame, min_score: float = 0.5, gap: float = 0.08) -> DataFrame:
    """row_id, status, method, final_url of rows (row_id, institution, program, credential_type, program_url).

    A URL that is there is kept. Else the one http URL of the same name and class, of the same name, or of the best
    fuzzy match of the institution, if all matches within the gap have one name or one URL.
    """
    inst, url = F.lower(T.norm_space("institution")), T.norm_space("source_url")
    left = rows.select("row_id", inst.alias("inst"), T.name_key("program").alias("name"), class_of("credential_type").alias("cls"), T.norm_space("program_url").alias("old"), F.array_distinct(T.program_tokens("program")).alias("tokens"))
    right = index.select("seq", inst.alias("inst"), T.name_key("program_name").alias("name"), class_of("credential").alias("cls"), url.alias("url"), T.is_http_url("source_url").alias("http"), F.array_distinct(T.program_tokens("program_name")).alias("tokens"))
    one = lambda keys, name: right.filter("http").groupBy(*keys).agg(F.min("url").alias("lo"), F.max("url").alias("hi")).filter("lo = hi").select(*keys, F.col("lo").alias(name))
    held = left.join(one(["inst", "name", "cls"], "full"), ["inst", "name", "cls"], "left").join(one(["inst", "name"], "short"), ["inst", "name"], "left")
    blank = (F.col("inst") == "") | (F.col("name") == "")
    open_ = held.filter(~blank & (F.col("old") == "") & F.col("full").isNull() & F.col("short").isNull())
    ls = open_.select("inst", "tokens", "cls").distinct().withColumn("ls", F.xxhash64("inst", "tokens", "cls"))
    rs = right.select("inst", "tokens", "cls").distinct().withColumn("rs", F.xxhash64("inst", "tokens", "cls"))
    # What a bonus can add and the gap can take decides how alike two names must be at least.
    named = lambda df, side: df.select(F.col("inst").alias("block"), "tokens", side)
    pairs = similar_sets(named(ls, "ls"), named(rs, "rs"), max(min_score - gap - SAME_CLASS, 1e-6) - 1e-9).withColumnsRenamed({"ls_size": "ln", "rs_size": "rn"}).filter("both > 0")
    pairs = pairs.join(ls.select("ls", F.col("cls").alias("lc")), "ls").join(rs.select("rs", F.col("cls").alias("rc")), "rs")
    base = F.col("both") / (F.col("ln") + F.col("rn") - F.col("both"))
    bonus = F.when((F.col("lc") == "other") | (F.col("rc") == "other"), 0.0).when(F.col("lc") == F.col("rc"), SAME_CLASS).otherwise(OTHER_CLASS)
    pairs = pairs.select("ls", "rs", base.alias("base"), (base + bonus).alias("score"))
    best = pairs.groupBy("ls").agg(F.max("score").alias("best"))
    near = pairs.join(best, "ls").filter((F.col("best") >= min_score) & (F.col("best") - F.col("score") < gap))
    near = near.join(right.select(F.xxhash64("inst", "tokens", "cls").alias("rs"), "seq", "name", "url"), "rs").groupBy("ls").agg(
        F.count_distinct("name").alias("names"), F.count_distinct("url").alias("urls"), F.max_by("url", F.struct("score", "base", -F.col("seq"))).alias("found")
    )
    near = near.withColumn("fuzzy", F.when(F.col("names") == 1, "fuzzy_unique_name").when(F.col("urls") == 1, "fuzzy_unique_url").otherwise("ambiguous"))
    held = held.withColumn("ls", F.xxhash64("inst", "tokens", "cls")).join(near, "ls", "left")
    method = F.when(F.col("full").isNotNull(), "exact_full").when(F.col("short").isNotNull(), "exact_program").otherwise(F.col("fuzzy"))
    made = F.coalesce("full", "short", F.when(F.col("fuzzy") != "ambiguous", F.col("found")))
    ok = made.rlike("^(?i:https?)://")
    status = F.when(blank, "skipped_blank_key").when(F.col("old") != "", "kept_existing").when(method == "ambiguous", "ambiguous").when(F.coalesce(ok, F.lit(False)), "mapped").otherwise("no_match")
    return held.withColumns({"status": status}).select("row_id", "status", F.when(F.col("status") == "mapped", method).when(F.col("status") == "kept_existing", "existing").otherwise("").alias("method"), F.when(F.col("status") == "mapped", made).otherwise(F.col("old")).alias("final_url"))


def requirement_links(seeds: DataFrame, pages: DataFrame, token: str, below: str) -> DataFrame:
    """seed_id, requirements_url of seeds (seed_id, url): the first link with the token on the seed's page, else on the page
    of its root: what stands before ``below`` in its URL."""
    links = X.html_links(pages).filter(F.contains(F.lower("url"), F.lit(token))).groupBy("base").agg(F.min_by("url", "position").alias("link"))
    links = links.select(F.col("base").alias("page"), F.regexp_replace("link", "#.*$", "").alias("link"))
    root = F.regexp_extract("url", rf"(?i)^(.+?){below}.+$", 1)
    held = seeds.select("seed_id", "url", root.alias("root"))
    own, up = links.select(F.col("page").alias("url"), F.col("link").alias("own")), links.select(F.col("page").alias("root"), F.col("link").alias("up"))
    return held.join(own, "url", "left").join(up, "root", "left").select("seed_id", F.coalesce("own", "up", F.lit("")).alias("requirements_url"))


def canonical_filter(rows: DataFrame, overrides: DataFrame, notes: DataFrame, seeds: DataFrame, legacy: DataFrame, curated: list[str], tokens: tuple[str, ...], urls: str, names: str) -> DataFrame:
    """seq, reason of rows (seq, institution, program_name, source_url): who stays (override_include, seed_match,
    legacy_allowlist, not_curated) and who goes (override_exclude, evidence, blocked_url, blocked_name, not_in_seed).

    Overrides that exclude come first, of any institution; the rest holds for curated ones. Evidence is by name only; the
    legacy list counts only for an institution without seeds.
    """
    found = resolve_override(rows, overrides).filter("right_id IS NOT NULL").select(F.col("left_id").alias("seq"), F.col("right_id").alias("o"))
    told = overrides.select(F.col("seq").alias("o"), F.lower(T.norm_space("include_or_exclude")).alias("told"))
    inst, key = F.lower(T.norm_space("institution")), T.name_key("program_name")
    flat = lambda d, flag: d.select(inst.alias("i"), key.alias("k")).filter("k <> ''").distinct().withColumn(flag, F.lit(True))
    said = notes.select(key.alias("k"), F.lower(T.norm_space("notes")).alias("n")).filter(T.any_of([F.contains("n", F.lit(t)) for t in tokens])).select("k").distinct().withColumn("evidence", F.lit(True))
    seeded = seeds.select(inst.alias("i")).distinct().withColumn("has_seeds", F.lit(True))
    df = rows.select("seq", "institution", inst.alias("i"), key.alias("k"), T.norm_space("source_url").alias("u"), T.norm_space("program_name").alias("p")).join(found, "seq", "left").join(told, "o", "left")
    df = df.join(said, "k", "left").join(flat(seeds, "seed"), ["i", "k"], "left").join(flat(legacy, "old"), ["i", "k"], "left").join(seeded, "i", "left")
    reason = (
        F.when(F.col("told") == "exclude", "override_exclude").when(~F.trim("institution").isin(*curated), "not_curated").when(F.col("told") == "include", "override_include").when(F.col("evidence"), "evidence")
        .when(F.col("u").rlike(urls), "blocked_url").when(F.col("p").rlike(names), "blocked_name").when(F.col("old") & F.col("has_seeds").isNull(), "legacy_allowlist").when(F.col("seed"), "seed_match").otherwise("not_in_seed")
    )
    return df.select("seq", reason.alias("reason"))


def project_canonical(raw: DataFrame, columns: list[str]) -> DataFrame:
    """The canonical columns of a raw table: English columns under either name, the first http URL of its URL columns, a
    clean competitive text, an empty display flag; columns that raw lacks are empty."""
    have = set(raw.columns)
    text = lambda c: T.norm_space(c) if c in have else F.lit("")
    first = lambda *cs: F.coalesce(*[F.when(~T.is_blank(c), F.col(c)) for c in cs if c in have], F.lit(""))
    urls = F.coalesce(*[F.when(T.is_http_url(c), T.norm_space(c)) for c in ("program_url", "source_url", "url") if c in have], F.lit(""))
    own = {"english_req": first("english_req", "eng_req"), "english_min": first("english_min", "eng_min"), "program_url": urls, "competitive_final": T.clean_competitive("competitive_final"), "display_for_high_school": F.lit("")}
    return raw.select("row_id", *[own.get(c, text(c)).alias(c) for c in columns])


def apply_average_totals(rows: DataFrame, found: DataFrame, allowed: tuple[str, ...] = ("high", "medium"), overwrite: bool = False) -> DataFrame:
    """One row per candidate key: key, status, row_id, previous, new. Candidates (institution, program, credential_type,
    avg_total, confidence) of a key must agree and have one target: by full key, else by a program of that name that is
    the only one; a candidate without credential takes the program's only row."""
    whole = lambda c: F.when(T.norm_space(c).rlike("^[0-9]+$"), T.norm_space(c).cast("int"))
    inst, prog, cred = (F.lower(T.norm_space(c)) for c in ("institution", "program", "credential_type"))
    full, short = F.concat_ws("||", inst, prog, cred), F.concat_ws("||", inst, prog)
    named = (inst != "") & (prog != "")
    some = found.filter(named & F.lower(T.norm_space("confidence")).isin(*allowed) & (whole("avg_total") > 0))
    keys = some.groupBy(full.alias("key"), short.alias("short"), (cred == "").alias("bare")).agg(F.min(whole("avg_total")).alias("lo"), F.max(whole("avg_total")).alias("hi"))
    held = rows.filter(named)
    count = lambda k, n: held.groupBy(k.alias(n)).agg(F.count("*").alias(f"{n}_n"), F.min("row_id").alias(f"{n}_id"))
    df = keys.join(count(full, "key"), "key", "left").join(count(short, "short"), "short", "left")
    full_n, short_n = F.coalesce("key_n", F.lit(0)), F.coalesce("short_n", F.lit(0))
    hits = F.when(F.col("bare"), short_n).when(full_n > 0, full_n).when(short_n == 1, 1).otherwise(0)
    target = F.when(hits == 1, F.when(~F.col("bare") & (full_n == 1), F.col("key_id")).otherwise(F.col("short_id")))
    df = df.select("key", "lo", "hi", hits.alias("hits"), target.alias("row_id")).join(held.select("row_id", whole("avg_total").alias("own")), "row_id", "left")
    own = F.when(F.col("own") > 0, F.col("own"))
    status = F.when(F.col("lo") != F.col("hi"), "conflict").when(F.col("hits") == 0, "no_match").when(F.col("hits") > 1, "ambiguous").when(own.isNull(), "fill").when(own == F.col("lo"), "same").otherwise("overwrite" if overwrite else "kept_other")
    df = df.withColumn("status", status)
    applied = F.col("status").isin("fill", "overwrite")
    return df.select("key", "status", F.when(F.col("status").isin("fill", "overwrite", "same", "kept_other"), F.col("row_id")).alias("row_id"), F.when(applied, own).alias("previous"), F.when(applied, F.col("lo")).alias("new"))


def seed_checks(rows: DataFrame, seeds: DataFrame, overrides: DataFrame) -> DataFrame:
    """Per institution: rows, rows outside the seed, seed names that no row has, expected names, bad URLs, URLs that differ
    from the seed's only one, placement types without a sign of placement, and whether all is well."""
    inst = F.lower(T.norm_space("institution"))
    gone = overrides.filter((F.lower(T.norm_space("include_or_exclude")) == "exclude") & T.is_active_status("status")).select(inst.alias("i"), T.name_key("program").alias("k")).distinct()
    want = seeds.select(inst.alias("i"), T.name_key("program_name").alias("k"), T.url_key("source_url").alias("u")).filter("k <> ''").groupBy("i", "k").agg(F.min("u").alias("lo"), F.max("u").alias("hi")).join(gone, ["i", "k"], "left_anti")
    kind = F.lower(T.norm_space("requirement_type"))
    sign = T.truthy("math_assessment_flag") | T.any_of([F.lower(T.norm_space(c)).rlike("placement|assessment|accuplacer|test") for c in ("english_req", "math_req")])
    have = rows.select(inst.alias("i"), T.name_key("program").alias("k"), T.url_key("program_url").alias("u"), T.is_http_url("program_url").alias("http"), (F.startswith(kind, F.lit("placement_assessment")) & ~sign).alias("placeholder"))
    held = have.join(want, ["i", "k"], "left")
    own = held.groupBy("i").agg(
        F.count("*").alias("rows"), F.count_if(F.col("lo").isNull()).alias("outside_seed"), F.count_if(~F.col("http")).alias("bad_url"), F.count_if((F.col("lo") == F.col("hi")) & (F.col("u") != F.col("lo"))).alias("other_url"), F.count_if("placeholder").alias("placeholders")
    )
    lost = want.join(have.select("i", "k").distinct(), ["i", "k"], "left_anti").groupBy("i").agg(F.count("*").alias("not_in_rows"))
    expected = want.groupBy("i").agg(F.count("*").alias("expected"))
    df = own.join(expected, "i", "full").join(lost, "i", "left").fillna(0)
    return df.withColumn("passed", (F.col("outside_seed") + F.col("bad_url") + F.col("other_url") + F.col("placeholders") + F.col("not_in_rows") == 0) & (F.col("rows") == F.col("expected")))


def rule_priority(rule: Column, quantity: Column, preferred: Column) -> Column:
    points = sum((F.when(F.contains(rule, F.lit(w)), n).otherwise(0) for w, n in RULE_POINTS), F.lit(0))
    return points + F.when(preferred, 20).otherwise(0) + F.when(F.lower(F.trim(quantity)) == "four", 10).otherwise(0)


def priority_rules(rules: DataFrame, n: int = 25) -> DataFrame:
    """The first n suggestions (institution, program, rule, priority), each once: priority, institution, program, rule."""
    once = rules.groupBy("institution", "program", "rule").agg(F.max("priority").alias("priority"))
    return once.orderBy(F.desc("priority"), "institution", "program", "rule").limit(n)


def seed_cards(pages: DataFrame, base: str, marked: str = "program-card-title") -> DataFrame:
    """program_name, program_url: the cards of pages (html), each once: anchors of the class, or with a link-title block."""
    anchors = pages.select(F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*>.*?</a\s*>"), F.lit(0))).alias("a"))
    open_ = F.regexp_extract("a", r"(?is)^<a\b[^>]*>", 0)
    href = T.norm_space(F.regexp_extract(open_, r"""(?is)\bhref\s*=\s*["']([^"']*)["']""", 1))
    classes = F.regexp_extract(open_, r"""(?is)\bclass\s*=\s*["']([^"']*)["']""", 1)
    title = F.regexp_extract("a", r"""(?is)<div[^>]*class\s*=\s*["'][^"']*\blink-title\b[^"']*["'][^>]*>(.*?)</div>""", 1)
    inner = F.when(F.contains(classes, F.lit(marked)), F.regexp_extract("a", r"(?is)^<a\b[^>]*>(.*?)</a\s*>$", 1)).otherwise(title)
    cards = anchors.select(X.html_text(inner).alias("program_name"), href.alias("h")).filter("program_name <> '' AND h <> ''")
    return cards.select("program_name", T.resolve_url(F.lit(base), "h").alias("program_url")).distinct()


def fragment_links(fragments: DataFrame) -> DataFrame:
    """row_id, links of fragments (row_id, base, html): the URLs of a fragment's anchors that are worth a visit, each once."""
    links = X.html_links(fragments.select(F.col("row_id").alias("page_id"), F.col("base").alias("url"), "html"))
    held = links.groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "url"))), lambda x: x["url"]).alias("links"))
    return held.select(F.col("page_id").alias("row_id"), "links")


def _subjects() -> Column:
    course = lambda s: (T.requirement_mode(s, f"{s}_req", f"{s}_requirement_mode") == "course") & (T.norm_space(f"{s}_req") != "")
    return course("english") | course("math") | (T.norm_space("social_req") != "") | (T.norm_space("science_req") != "")


def field_defaults(df: DataFrame, text: Column) -> DataFrame:
    """row_id, math_assessment_flag, hs_diploma_req and their confidence: blanks are 'No' where math is a course, 'Yes' where
    a subject is asked for, 'No' where the text tells of a post-secondary pathway."""
    math = (T.requirement_mode("math", "math_req", "math_requirement_mode") == "course") & (T.norm_space("math_req") != "")
    flag, diploma = T.norm_space("math_assessment_flag"), T.norm_space("hs_diploma_req")
    pathway = X.found(T.norm_space(text), X.PATHWAY) | F.contains(F.lower(text), F.lit("post_secondary_pathway"))
    return df.select(
        "row_id", F.when((flag == "") & math, "No").otherwise(flag).alias("math_assessment_flag"), F.when((flag == "") & math, "low").otherwise("").alias("math_confidence"),
        F.when(diploma != "", diploma).when(_subjects(), "Yes").when(pathway, "No").otherwise("").alias("hs_diploma_req"), F.when(diploma != "", "").when(_subjects(), "low").when(pathway, "medium").otherwise("").alias("hs_confidence"),
    )


def post_passes(df: DataFrame, overrides: DataFrame) -> DataFrame:
    """row_id, min_avg_final, avg_total, requirement_type, hs_diploma_req, math_assessment_flag and the passes that changed
    a row: overrides win, a pathway clears diploma and assessment, an assessment alone is a placement."""
    fields = ("min_avg_final", "avg_total", "elective_qty", "requirement_type")
    held = df.join(overrides.select("row_id", *[T.norm_space(f).alias(f"o_{f}") for f in fields]), "row_id", "left")
    took = {f: F.coalesce(F.col(f"o_{f}"), F.lit("")) != "" for f in fields}
    passes = F.transform(F.array_compact(F.array(*[F.when(took[f], f) for f in fields])), lambda f: F.concat(F.lit("override:"), f))
    held = held.withColumn("passes", passes).withColumns({f: F.when(took[f], F.col(f"o_{f}")).otherwise(T.norm_space(f)) for f in fields})
    low = F.lower("requirement_type")
    path = F.startswith(low, F.lit("regular_admission")) & F.contains(low, F.lit("post-secondary pathway"))
    held = held.withColumns({"hs_diploma_req": F.when(path, "No").otherwise(T.norm_space("hs_diploma_req")), "math_assessment_flag": F.when(path, "No").otherwise(T.norm_space("math_assessment_flag")), "path": path})
    alone = (F.lower("math_assessment_flag") == "yes") & ~_subjects() & (F.col("min_avg_final") == "") & (F.col("avg_total") == "") & ~F.startswith(low, F.lit("placement_assessment"))
    notes = F.regexp_extract("requirement_type", r"(?i)(; notes:.*)$", 1)
    held = held.withColumn("alone", alone).withColumn("requirement_type", F.when(F.col("alone"), F.concat(F.lit("placement_assessment"), notes)).otherwise(F.col("requirement_type")))
    passes = F.concat("passes", F.array_compact(F.array(F.when(F.col("path"), "pathway:hs_diploma_req"), F.when(F.col("path"), "pathway:math_assessment_flag"), F.when(F.col("alone"), "assessment:requirement_type"))))
    return held.select("row_id", "min_avg_final", "avg_total", "requirement_type", "hs_diploma_req", "math_assessment_flag", F.array_join(passes, "; ").alias("passes"))


def baseline_profile(docs: DataFrame) -> DataFrame:
    """program_id, value, rule_id: the average count of the first page of a program that has one."""
    found = docs.select("program_id", "doc_seq", X.average_count(T.norm_space("text")).alias("a")).filter("a.value IS NOT NULL")
    return found.groupBy("program_id").agg(F.min_by("a", "doc_seq").alias("a")).select("program_id", F.col("a.value").alias("value"), F.col("a.rule_id").alias("rule_id"))


def match_summary(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """institution, canonical, matched, missing, ambiguous of matches (left_id, status) of rows (row_id, institution)."""
    held = rows.select(F.col("row_id").alias("left_id"), "institution").join(matches.select("left_id", "status").hint("merge"), "left_id", "left")
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return held.groupBy("institution").agg(F.count("*").alias("canonical"), count("matched"), F.count_if(F.col("status").isNull() | (F.col("status") == "missing")).alias("missing"), count("ambiguous"))


def extract_outputs(docs: DataFrame, folder: str) -> None:
    """The four tables of an extraction run, written under a folder: structured (a row per program), evidence, errors and the
    average counts alone. Candidates are computed once."""
    spark = docs.sparkSession
    X.candidates(docs).write.mode("overwrite").parquet(f"{folder}/candidates")
    found = spark.read.parquet(f"{folder}/candidates")
    final = X.resolve_fields(found)
    final.write.mode("overwrite").parquet(f"{folder}/structured")
    X.accepted_evidence(found).write.mode("overwrite").parquet(f"{folder}/evidence")
    empty = docs.groupBy("program_id").agg(F.max(T.norm_space("text") != "").alias("any")).filter("NOT any")
    empty.select("program_id", F.lit("no text").alias("error")).write.mode("overwrite").parquet(f"{folder}/errors")
    baseline_profile(docs).write.mode("overwrite").parquet(f"{folder}/average_counts")


def ranked_first(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each value of ``by`` in an order."""
    return df.withColumn("__place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__place = 1").drop("__place")
