"""Line dedup by site-relative frequency.

A page's lines are its text between block-level tags, white space collapsed. Per host, the pages that hold a line
are divided by the pages of the host; lines on at least ``min_pages`` pages whose ratio exceeds ``ratio`` are
boilerplate of that host and are dropped from its pages. Lines are counted by 64-bit hash, at most once a page,
with a partial sum before the shuffle, so a line that a third of all pages share is a few rows. A host's
boilerplate is gathered in one array: as ratios of a host's lines sum to its mean lines a page, it holds at most
(mean lines a page) / ratio hashes however many pages the host has. A page's lines are intersected with it by hash sets,
and what is shared is marked by sorting, so the work on a page grows with its lines and not with their square.

Lines are cut once: pages with their lines are written to the shared folder, counted and then read again. Hidden
elements end at their own closing tag or with the text; every pattern passes over a text once, however long it is.

A null html has no lines and its kept_text is empty; a url without a host belongs to the host '' ; repeated rows
are pages of their own; an empty table gives no rows. Columns named as the added ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from sievework.llm.common import cut, maybe_broadcast, table, without, written

#: A line on more than this share of a host's pages, and on at least so many pages, is boilerplate.
RATIO, MIN_PAGES = 0.2, 3
ADDED = ("host", "n_lines", "n_dropped", "kept_text")

HIDDEN = "(?is)" + "|".join(rf"<{t}\b[^<>]*>.*?(?:</{t}\s*>|\z)" for t in ("script", "style", "noscript", "template")) + r"|<!--.*?(?:-->|\z)"
BLOCK = r"(?i)</?(p|div|li|ul|ol|h[1-6]|tr|td|th|table|br|hr|nav|article|section|header|footer|aside|main|title|head|body|html|blockquote|pre|form|option)\b[^<>]*>"
TAG = r"<[^<>]*>"
HOST = r"(?i)^[a-z][a-z0-9+.-]*://([^/?#:]*)"


def page_lines(html: Column) -> Column:
    """The non-blank lines of a page in order."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " ")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "), BLOCK, "\n"), TAG, "")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, " +", " "))), lambda x: x != "")


@F.pandas_udf(ArrayType(BooleanType()))
def _among(lines: pd.Series, shared: pd.Series) -> pd.Series:
    """Which lines of a page are among those that it shares, by hash: both are sorted once, however many they are."""
    return pd.Series([np.isin(a, b) for a, b in zip(lines, shared, strict=True)], dtype=object)


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, keep: list[str] | None = None) -> DataFrame:
    """pages (url, html and others) with host, n_lines, n_dropped and kept_text; keep: which of their columns to return."""
    pages = without(pages, *ADDED)
    own = pages.columns if keep is None else keep
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    lined = written(pages.select(*[F.col(f"`{c}`") for c in own], host.alias("host"), page_lines(F.col("html")).alias("page_lines")), "page-lines")
    hashes = F.array_distinct(F.transform("page_lines", lambda x: F.xxhash64(x)))
    # The null hash stands for the page itself: host totals come from the same pass.
    seen = lined.select("host", F.explode(F.concat(hashes, F.array(F.lit(None).cast("long")))).alias("line"))
    counts = cut(seen.groupBy("host", "line").count().filter((F.col("count") >= min_pages) | F.col("line").isNull()))
    totals = counts.filter("line IS NULL").select("host", F.col("count").alias("host_pages"))
    common = counts.filter("line IS NOT NULL").join(totals, "host").filter(F.col("count") > ratio * F.col("host_pages"))
    common = cut(common.groupBy("host").agg(F.collect_list("line").alias("boilerplate")))
    rows = common.agg(F.coalesce(F.sum(F.size("boilerplate")), F.lit(0))).first()[0]
    held = lined.join(maybe_broadcast(common, rows), "host", "left")
    every = F.transform("page_lines", lambda x: F.xxhash64(x))
    shared = F.array_intersect(every, F.coalesce("boilerplate", F.array().cast("array<bigint>")))
    held = held.withColumn("page_drop", _among(every, shared)).withColumn("page_kept", F.filter("page_lines", lambda x, i: ~F.get("page_drop", i)))
    n = F.size("page_lines")
    return held.select(
        *[F.col(f"`{c}`") for c in own], "host", n.alias("n_lines"), (n - F.size("page_kept")).alias("n_dropped"), F.array_join("page_kept", "\n").alias("kept_text")
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id"])


_sql = lambda r: r.replace("'", "''")
ORACLE = rf"""
WITH text AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '{_sql(HOST)}', 1)) AS host,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{_sql(HIDDEN)}', ' ', 'g'),
      '[\x20\x09-\x0D]+', ' ', 'g'), '{_sql(BLOCK)}', chr(10), 'g'), '{_sql(TAG)}', '', 'g') AS body FROM pages
), lined AS (
  SELECT row_number() OVER () AS row_id, page_id, host, list_filter(list_transform(string_split(body, chr(10)),
    lambda x: trim(regexp_replace(x, ' +', ' ', 'g'))), lambda x: x <> '') AS lines FROM text
), totals AS (SELECT host, count(*) AS host_pages FROM lined GROUP BY host
), counts AS (
  SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM lined) GROUP BY ALL
), common AS (
  SELECT host, list(line) AS boilerplate FROM counts JOIN totals USING (host)
  WHERE n >= {MIN_PAGES} AND n > {RATIO}::DOUBLE * host_pages GROUP BY host
), kept AS (
  SELECT page_id, host, lines, list_filter(lines, lambda x: NOT coalesce(list_contains(boilerplate, x), false)) AS keep
  FROM lined LEFT JOIN common USING (host)
)
SELECT page_id, host, len(lines)::INTEGER AS n_lines, (len(lines) - len(keep))::INTEGER AS n_dropped,
       coalesce(array_to_string(keep, chr(10)), '') AS kept_text FROM kept
"""
