"""Normalisers, keys and small parsers as column expressions. None of them needs Python on the executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens and words that carry meaning in the data.
NOTHING = ("nan", "none", "null")
INACTIVE = ("inactive", "disabled", "archived", "off", "no", "false", "0")
TRUE_WORDS = ("yes", "y", "true", "1", "required")
FALSE_WORDS = ("no", "n", "false", "0", "not_required")
MODES = ("course", "placement_assessment", "elp", "other_gate")
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
SKIPPED_SCHEMES = "^(mailto:|tel:|javascript:)"
SKIPPED_FILES = r"\.(pdf|jpg|jpeg|png|gif|svg|zip|docx?|xlsx?)$"
BOILERPLATE = ("to be considered for admission to the program", "international students must qualify for admission")
BOILERPLATE_STARTS = ("nimum grades you need to achieve", "entrance requirements:")
COMPETITIVE_PHRASE = "Competitive varies by year"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """use(value) with value computed once a row, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def norm_space(c: Column | str) -> Column:
    """White space (Unicode's too) collapsed and trimmed; null is ''."""
    return F.trim(F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), r"(?U)\s+", " "))


def norm_or_blank(c: Column | str) -> Column:
    """norm_space, and words for nothing are ''."""
    t = norm_space(c)
    return F.when(F.lower(t).isin(*NOTHING), F.lit("")).otherwise(t)


def is_blank(c: Column | str) -> Column:
    return norm_space(c) == ""


def is_blankish(c: Column | str) -> Column:
    """Blank, a word for nothing, or unknown."""
    return F.lower(norm_space(c)).isin("", *NOTHING, "unknown")


def name_key(c: Column | str) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.lower(norm_space(c)), "&amp;", " and "), "&", " and ")
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def url_key(c: Column | str, strip_fragment: bool = True, slashes: str = "one") -> Column:
    """Lower case; without fragment if asked; without one or all slashes at the end."""
    t = F.lower(norm_space(c))
    if strip_fragment:
        t = F.regexp_replace(t, "#.*$", "")
    return F.regexp_replace(t, "/$" if slashes == "one" else "/+$", "")


def program_text(c: Column | str) -> Column:
    t = F.regexp_replace(F.lower(norm_space(c)), r"\(.*?\)", " ")
    return norm_space(F.regexp_replace(F.regexp_replace(t, "[‐-―]", " "), "[^a-z0-9 ]", " "))


def program_tokens(c: Column | str) -> Column:
    """Distinct words of a name, sorted; none for a blank name."""
    t = program_text(c)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.split(t, " "))))


def folded_key(*cs: Column | str, sep: str = "||") -> Column:
    return F.concat_ws(sep, *[F.lower(norm_space(c)) for c in cs])


def override_key(institution, program, credential) -> Column:
    inst, prog = F.lower(norm_space(institution)), name_key(program)
    return F.when((inst == "") | (prog == ""), F.lit("")).otherwise(F.concat_ws("||", inst, prog, F.lower(norm_space(credential))))


def slug(c: Column, sep: str, most: int = 60) -> Column:
    edge = f"^{sep}+|{sep}+$"
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", sep), edge, ""), 1, most)


def program_id(row_id, institution, name, url) -> Column:
    digest = F.substring(F.sha1(F.concat_ws("::", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in (row_id, institution, name, url)])), 1, 12)
    safe = F.regexp_replace(slug(F.concat_ws("-", col(institution), col(name)), "-"), "-+$", "")
    return F.concat_ws("-", safe, digest)


def program_key_base(institution, program, credential, columns: list[str]) -> Column:
    """Slugs and the start of a digest over the whole row; rows that share it are told apart by a counter (WI)."""
    parts = F.filter(F.array(*[slug(F.coalesce(col(c), F.lit("")), "_") for c in (institution, program, credential)]), lambda x: x != "")
    base = F.when(F.size(parts) == 0, F.lit("program")).otherwise(F.array_join(parts, "__"))
    row = F.concat_ws("|", *[F.trim(F.coalesce(col(c).cast("string"), F.lit(""))) for c in columns])
    print_ = F.concat_ws("||", *[F.coalesce(col(c), F.lit("")) for c in (institution, program, credential)], row)
    digest = F.lower(F.rtrim(F.translate(F.base64(F.unhex(F.sha2(print_, 256))), "+/=", "-_")))
    return F.concat_ws("_", base, F.substring(digest, 1, 12))


def is_http_url(c: Column | str) -> Column:
    return norm_space(c).rlike("^(?i:https?)://")


def url_host(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(norm_space(c), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def root_domain(host: Column | str) -> Column:
    parts = F.filter(F.split(F.lower(F.trim(col(host))), r"\."), lambda x: x != "")
    return F.array_join(F.when(F.size(parts) > 2, F.slice(parts, -2, 2)).otherwise(parts), ".")


def is_same_site(a: Column | str, b: Column | str) -> Column:
    a, b = F.lower(F.trim(col(a))), F.lower(F.trim(col(b)))
    return (a != "") & (b != "") & ((a == b) | F.endswith(b, F.concat(F.lit("."), a)) | F.endswith(a, F.concat(F.lit("."), b)) | (root_domain(a) == root_domain(b)))


def resolve_url(base: Column | str, href: Column | str) -> Column:
    """An absolute URL of a link: absolute, protocol-relative, from the root, a query, a fragment, or next to the page."""
    b, h = norm_space(base), norm_space(href)
    site = F.regexp_extract(b, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_replace(b, "[?#].*$", "")
    folder = F.when(page.rlike("^[a-z]+://[^/]*$"), F.concat(page, F.lit("/"))).otherwise(F.regexp_replace(page, "[^/]*$", ""))
    return (
        F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(h == "", b)
        .when(F.startswith(h, F.lit("//")), F.concat(F.regexp_extract(b, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), h))
        .when(F.startswith(h, F.lit("/")), F.concat(site, h))
        .when(F.startswith(h, F.lit("?")), F.concat(page, h))
        .when(F.startswith(h, F.lit("#")), F.concat(F.regexp_replace(b, "#.*$", ""), h))
        .otherwise(F.concat(folder, h))
    )


def should_skip_url(c: Column | str) -> Column:
    t = F.lower(norm_space(c))
    return (t == "") | t.rlike(SKIPPED_SCHEMES) | t.rlike(SKIPPED_FILES)


def _word_number(t: Column) -> Column:
    out = F.when(t == NUMBER_WORDS[0], 1)
    for i, w in enumerate(NUMBER_WORDS[1:], 2):
        out = out.when(t == w, i)
    return out


def count_strict(c: Column | str) -> Column:
    """A number word or digits as 1..10, else null."""
    t = F.lower(norm_space(c))
    n = F.coalesce(_word_number(t), F.when(t.rlike("^[0-9]{1,9}$"), t.try_cast("int")))
    return F.when(n.between(1, 10), n)


def count_within(c: Column | str) -> Column:
    """The first number word or digits in a text as 1..10, else null."""
    return count_strict(F.regexp_extract(norm_space(c), r"(?i)\b(one|two|three|four|five|six|seven|eight|nine|ten|[0-9]+)\b", 1))


def count_any(c: Column | str) -> Column:
    """Digits anywhere, else a text that is a number word, else 0; not bounded."""
    t = F.lower(norm_space(c))
    return F.coalesce(F.regexp_extract(t, r"\b([0-9]+)\b", 1).try_cast("int"), _word_number(t), F.lit(0))


def elective_quantity(c: Column | str) -> Column:
    """A number word or a number, null for text that refers elsewhere."""
    t = F.trim(F.coalesce(col(c), F.lit("")))
    return F.coalesce(_word_number(F.lower(t)).cast("double"), to_number(t))


def to_number(c: Column | str) -> Column:
    """A finite number or null; a text with anything else in it is null."""
    t = F.trim(F.coalesce(col(c).cast("string"), F.lit("")))
    return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))


def clamp_mark(c: Column | str) -> Column:
    return F.when(to_number(c).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), to_number(c))))


def to_ymd(c: Column | str) -> Column:
    """yyyy-mm-dd from an ISO date, a text that starts with one, or m/d/yyyy; else ''."""
    t = F.trim(F.coalesce(col(c).cast("string"), F.lit("")))
    iso = F.regexp_extract(t, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})([T\s]|$)", 1)
    part = lambda i: F.regexp_extract(t, r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$", i)
    held = lambda i, most: F.lpad(F.greatest(F.lit(1), F.least(F.lit(most), part(i).try_cast("int"))).cast("string"), 2, "0")
    return F.when(iso != "", iso).when(part(3) != "", F.concat_ws("-", part(3), held(1, 12), held(2, 31))).otherwise(F.lit(""))


def age_days(ymd: Column, today: Column) -> Column:
    return F.greatest(F.lit(0), F.datediff(today, F.try_to_date(ymd, "yyyy-MM-dd")))


def is_active_status(c: Column | str) -> Column:
    return ~F.lower(norm_space(c)).isin(*INACTIVE)


def truthy(c: Column | str, default: bool = False) -> Column:
    t = F.lower(norm_space(c))
    return F.when(t.isin(*TRUE_WORDS), True).when(t.isin(*FALSE_WORDS), False).otherwise(default)


def credential_class(name, url=None, variant: str = "index") -> Column:
    t = F.lower(norm_or_blank(name))
    if variant == "index":
        return (
            F.when(F.contains(F.lower(norm_or_blank(url)), F.lit("/apprenticeship/")) | F.contains(t, F.lit("apprentice")), "Apprenticeship")
            .when(F.contains(t, F.lit("bachelor")), "Degree")
            .when(F.contains(t, F.lit("diploma")), "Diploma")
            .when(F.contains(t, F.lit("certificate")), "Certificate")
            .when(F.contains(t, F.lit("upgrading")), "Course credits")
            .otherwise("Other")
        )
    degree = "degree|bachelor|major|honours" if variant == "seed" else "degree|bachelor"
    return F.when(t.rlike("diploma"), "Diploma").when(t.rlike("certificate"), "Certificate").when(t.rlike(degree), "Degree").otherwise("Other")


def course_key(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(F.coalesce(col(c), F.lit("")))), r"\.", ""), r"(?U)\s+", " ")


_COURSE = {
    "english": r"(?i)\b(english(\s+language\s+arts)?|ela)\s*(20|30)-[12]\b|^(20|30)-[12](\s+or\s+(20|30)-[12])?$",
    "math": r"(?i)\b(math|mathematics)\s*(20|30)-[12]\b|\b(math|mathematics)\s*31\b|^((20|30)-[12]|31)(\s+or\s+((20|30)-[12]|31))?$",
}


def is_course_like(subject: str, c: Column | str) -> Column:
    return norm_space(c).rlike(_COURSE[subject])


def requirement_mode(subject: str, text: Column | str, explicit: Column | str) -> Column:
    """The explicit mode if it is one, else inferred from the text."""
    e, t = F.lower(norm_space(explicit)), norm_space(text)
    low = F.lower(t)
    out = F.when(e.isin(*MODES), e).when(t == "", "").when(low.rlike("placement|assessment|accuplacer"), "placement_assessment")
    if subject == "english":
        out = out.when(low.rlike("language proficiency|ielts|toefl|duolingo|cael|pearson|pte"), "elp")
    return out.when(is_course_like(subject, t), "course").otherwise("other_gate")


def display_requirement(subject: str, text: Column | str, mode: Column) -> Column:
    """Shorthand codes written out, names unified, and the text of a gate by its mode."""
    prefix, code = ("English", r"((?:20|30)-[12]|31)") if subject == "english" else ("Math", r"((?:20|30)-[12]|31)")
    t = norm_space(text)
    names = [(r"(?i)\bEnglish Language Arts\b", "English"), (r"(?i)\bELA\b", "English")] if subject == "english" else [(r"(?i)\bMathematics\b", "Math")]
    for pattern, name in names:
        t = F.regexp_replace(t, pattern, name)
    t = norm_space(F.regexp_replace(t, r"\s*/\s*", " or "))
    t = F.regexp_replace(t, f"^{code}$", f"{prefix} $1")
    t = F.regexp_replace(t, rf"(?i)^(?:{prefix}\s+)?{code}\s+or\s+{code}$", f"{prefix} $1 or {prefix} $2")
    gate = F.when(mode == "placement_assessment", "Placement assessment")
    if subject == "english":
        gate = gate.when(mode == "elp", "English language proficiency")
    return gate.when(mode == "course", t).otherwise(norm_space(text))


def clean_competitive(c: Column | str) -> Column:
    t = norm_space(c)
    low = F.lower(t)
    bad = any_of([F.contains(low, F.lit(x)) for x in BOILERPLATE] + [F.startswith(low, F.lit(x)) for x in BOILERPLATE_STARTS])
    return F.when(bad, COMPETITIVE_PHRASE).otherwise(t)


def is_competitive_polluted(c: Column | str) -> Column:
    t = norm_space(c)
    bad = any_of([F.contains(F.lower(t), F.lit(x)) for x in BOILERPLATE])
    return (t != "") & (F.lower(t) != COMPETITIVE_PHRASE.lower()) & (bad | ((F.size(F.split(t, " ")) > 24) & t.rlike("[:.]")))


def excerpt(text: Column, start: Column, end: Column, radius: int = 100) -> Column:
    """The text around [start, end), counted from 0, white space collapsed."""
    a = F.greatest(F.lit(0), start - radius)
    return norm_space(F.substring(text, a + 1, F.least(F.length(text), end + radius) - a))


def shorten(c: Column | str, n: int) -> Column:
    t = norm_space(c)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, n - 3)), F.lit("...")))


def shown(x: Column) -> Column:
    """A number as people write it: without a fraction that is zero."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))
