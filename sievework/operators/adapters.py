"""What institutions do their own way on their pages: rules for the number of courses in an average, a default, trimming.

Rules are data: an ordered list for each adapter, tried before the general ones over all pages of a program. Pages are
read once, each for itself; what crosses pages (the first rule in order, a text that goes on over pages, whether any
page is left after trimming) is settled by aggregates and a window over narrow rows, after the texts are gone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import extract as X
from sievework.operators.merge import trim_document


@dataclass(frozen=True)
class Adapter:
    institutions: tuple[str, ...]
    rules: tuple[tuple[str, int, str, str], ...]  # pattern, value, confidence, rule id
    default: str | None = None  # rule id of the five courses that are taken where an admission average is named
    spread: str | None = None  # rule id of five subjects named anywhere behind an admission average, over pages
    starts: tuple[str, ...] = ()
    ends: tuple[str, ...] = ()


# Names of institutions, their rules in order, where the text of a program's page starts and ends.
ADAPTERS = {
    "nait": Adapter(
        ("NAIT",), ((r"\bfive 30-level subjects?\b", 5, "high", "five_30_level_subjects"), (r"\baverage calculated on five\b", 5, "high", "average_calculated_on_five")), "nait_default_five", None,
        ("Minimum entrance requirements", "High School Course Pathway", "About the program", "About the Program", "Academic requirements"),
        (
            "Not ready to apply yet?", "Stay connected Sign up to receive updates on NAIT programs, services, and events.", "Work at NAIT Emergency", "Contact us View Frequently Asked Questions",
            "Privacy Policy Terms of Use",
        ),
    ),
    "macewan": Adapter(("MACEWAN", "MACEWAN UNIVERSITY"), ((r"\bfive required Grade 12 subjects?\b", 5, "high", "five_required_grade12"), (r"\bfive acceptable Grade 12 subjects?\b", 5, "high", "five_acceptable_grade12"))),
    "norquest": Adapter(("NORQUEST", "NORQUEST COLLEGE"), ((r"\baverage of the best five\b", 5, "high", "best_five_average"), (r"\bfive Grade 12 subjects?\b", 5, "medium", "five_grade12_subjects"))),
    "ualberta": Adapter(("UALBERTA", "UNIVERSITY OF ALBERTA"), ((r"\bfive required Grade 12 subjects?\b", 5, "high", "five_required_grade12"),), "ualberta_default_five", "admission_average_five_subjects"),
}
LOADING = "Content is loading..."
ADMISSION_AVERAGE = r"\badmission average\b"

_GENERIC = 100  # the place of the first general rule


def adapter_of(institution: Column | str) -> Column:
    """The adapter of an institution's name; null for others."""
    name = F.upper(F.trim(T.col(institution)))
    return F.coalesce(*[F.when(name.isin(*a.institutions), key) for key, a in ADAPTERS.items()])


def program_text(text: Column | str, adapter: Column) -> Column:
    """What is left of a page after trimming, for adapters that trim; '' for a shell that never loaded."""
    t = T.norm_space(text)
    cut = t
    for key, a in ADAPTERS.items():
        if a.starts:
            shell = F.contains(t, F.lit(LOADING)) & ~T.any_of([F.contains(t, F.lit(m)) for m in a.starts])
            cut = F.when(adapter == key, F.when(shell, "").otherwise(trim_document(text, list(a.starts), list(a.ends)))).otherwise(cut)
    return cut


def adapted(docs: DataFrame) -> DataFrame:
    """docs (text and others, with or without institution) with adapter, text as the adapter trims it, and trimmed_away: true
    where nothing is left of a page; its text then stays, for a program of which nothing is left at all (see settled)."""
    name = adapter_of("institution") if "institution" in docs.columns else F.lit(None).cast("string")
    held = docs.withColumn("adapter", name).withColumn("__left", program_text("text", F.col("adapter")))
    own = F.col("adapter").isin(*[k for k, a in ADAPTERS.items() if a.starts]) & (F.col("__left") == "")
    return held.withColumn("trimmed_away", F.coalesce(own, F.lit(False))).withColumn("text", F.when(F.col("__left") != "", F.col("__left")).otherwise(T.norm_space("text"))).drop("__left")


def settled(facts: DataFrame) -> DataFrame:
    """Facts of pages (program_id, trimmed_away) without the pages that trimming emptied, unless it emptied all of a program."""
    rest = F.min("trimmed_away").over(Window.partitionBy("program_id"))
    return facts.withColumn("__none", rest).filter(~F.col("trimmed_away") | F.col("__none")).drop("__none")


def average_facts(text: Column, adapter: Column) -> dict[str, Column]:
    """Of one page: avg, the first rule in order as a struct with its place; average_said, where an admission average is
    named; goes_on and five_said, where a text over pages can begin that names one and then five subjects, and where it can end."""
    low = F.lower(text)
    own = []
    for key, a in ADAPTERS.items():
        made = [F.when(X.found(text, p), F.struct(F.lit(v).alias("value"), F.lit(c).alias("confidence"), F.lit(r).alias("rule_id"), X.snippet(text, p).alias("snippet"), F.lit(i).alias("place"))) for i, (p, v, c, r) in enumerate(a.rules)]
        own.append(F.when((adapter == key) & F.contains(low, F.lit("five")), F.coalesce(*made)))
    order = F.array(*[F.lit(r) for *_, r in X.AVERAGE_COUNTS])
    general = lambda g: F.when(g.isNotNull(), F.struct(g["value"].alias("value"), g["confidence"].alias("confidence"), g["rule_id"].alias("rule_id"), g["snippet"].alias("snippet"), (F.array_position(order, g["rule_id"]) + _GENERIC).cast("int").alias("place")))
    read = F.when(X.holds(low, "average of", "admission subject", "based on"), X.average_count(text))
    asks = adapter.isin(*[k for k, a in ADAPTERS.items() if a.default])
    return {
        "avg": F.coalesce(*own, T.let(read, general)), "average_said": F.when(asks & F.contains(low, F.lit("admission average")) & X.found(text, ADMISSION_AVERAGE), X.snippet(text, ADMISSION_AVERAGE)),
        "goes_on": asks & F.contains(low, F.lit("admission average")) & X.found(text, r"\badmission average(?: |$)"),
        "five_said": asks & F.contains(low, F.lit("five subject")) & X.found(text, r"(?:^| )five subjects?\b"), "spread_said": asks & X.found(text, r"\badmission average .* five subjects?\b"),
    }


def average_aggregates(seq: Column) -> list[Column]:
    """What a program's pages say together, as aggregates over average_facts and adapter."""
    said = F.when(F.col("average_said").isNotNull(), seq)
    return [
        F.min_by("avg", F.when(F.col("avg").isNotNull(), F.struct(F.col("avg.place"), seq))).alias("avg"), F.min_by("average_said", said).alias("average_said"), F.min(F.when(F.col("goes_on"), seq)).alias("said_at"),
        F.max(F.when(F.col("five_said"), seq)).alias("five_at"), F.max("spread_said").alias("spread_said"), F.max("adapter").alias("adapter"),
    ]


def average_total() -> Column:
    """struct(value, confidence, rule_id, snippet) out of average_aggregates: an own rule, five subjects behind an admission
    average, a general rule, the default."""
    made = lambda c, r: F.struct(F.lit(5).alias("value"), F.lit(c).alias("confidence"), F.lit(r).alias("rule_id"), F.col("average_said").alias("snippet"))
    plain = F.struct("avg.value", "avg.confidence", "avg.rule_id", "avg.snippet")
    over = F.coalesce(F.col("spread_said") | (F.col("said_at") < F.col("five_at")), F.lit(False))
    spread = F.coalesce(*[F.when((F.col("adapter") == k) & over, made("high", a.spread)) for k, a in ADAPTERS.items() if a.spread])
    default = F.coalesce(*[F.when((F.col("adapter") == k) & F.col("average_said").isNotNull(), made("low", a.default)) for k, a in ADAPTERS.items() if a.default])
    return F.coalesce(F.when(F.col("avg.place") < _GENERIC, plain), spread, F.when(F.col("avg").isNotNull(), plain), default)


def average_totals(docs: DataFrame) -> DataFrame:
    """program_id, value, confidence, rule_id, snippet of docs (program_id, doc_seq, institution, text); no row without a count."""
    pages = adapted(docs).filter("text <> ''")
    facts = average_facts(F.col("text"), F.col("adapter"))
    read = settled(pages.select("program_id", "doc_seq", "adapter", "trimmed_away", *[c.alias(n) for n, c in facts.items()]))
    held = read.groupBy("program_id").agg(*average_aggregates(F.col("doc_seq"))).withColumn("a", average_total())
    return held.filter("a IS NOT NULL").select("program_id", "a.*")
