"""Queries of streams (ST) and of sources and sinks (IO) that have a table form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.plans.registry import query
from sievework.sources import tables
from sievework.streaming import requests as R

_FOLD = """WITH RECURSIVE r AS (SELECT identity, seq, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY identity ORDER BY ts, seq) AS n FROM v_requests),
  s AS (SELECT identity, n, seq, ms AS last, ms AS begin_, 1 AS c, 'passed' AS verdict FROM r WHERE n = 1 UNION ALL
    SELECT r.identity, r.n, r.seq, CASE WHEN r.ms - s.last < {gap} THEN s.last ELSE r.ms END, CASE WHEN r.ms - s.last < {gap} THEN s.begin_ WHEN r.ms - s.begin_ >= {window} THEN r.ms ELSE s.begin_ END,
      CASE WHEN r.ms - s.last < {gap} THEN s.c WHEN r.ms - s.begin_ >= {window} THEN 1 ELSE s.c + 1 END,
      CASE WHEN r.ms - s.last < {gap} THEN 'too_soon' WHEN (CASE WHEN r.ms - s.begin_ >= {window} THEN 1 ELSE s.c + 1 END) > {most} THEN 'too_many' ELSE 'passed' END
    FROM s JOIN r ON r.identity = s.identity AND r.n = s.n + 1)
  SELECT identity, seq, verdict FROM s"""
#: The events of the test tables are minutes apart, so the query's limits are hours.
GAP, WINDOW, MOST, TTL = 1_800_000, 86_400_000, 5, 6_000_000


@query("st01_throttle", "v_requests", sql=_FOLD.format(gap=GAP, window=WINDOW, most=MOST))
def st01(requests: DataFrame) -> DataFrame:
    return R.throttle_batch(requests, GAP, WINDOW, MOST)


@query("st02_cache_hits", "v_requests")
def st02(requests: DataFrame) -> DataFrame:
    return R.cache_hits(requests.withColumn("payload", F.col("event_type")), 86_400_000)


@query("st04_audit", "v_requests")
def st04(requests: DataFrame) -> DataFrame:
    return R.audit_rows(requests.withColumn("payload", F.col("event_type")))


@query("io05_flatten_listing", "v_seed", sql="SELECT program_name AS title, source_url AS url, credential, 'English; Français' AS languages FROM (SELECT *, row_number() OVER (PARTITION BY lower(source_url) ORDER BY seq) AS n FROM v_seed) WHERE n = 1")
def io05(seeds: DataFrame) -> DataFrame:
    one = F.struct(F.concat("program_name", F.lit(" | School")).alias("title"), F.regexp_replace("source_url", "^https://school.example.org", "").alias("url"), "credential", F.array(F.lit("English"), F.lit("english"), F.lit(" Français ")).alias("languages"))
    pages = seeds.select("seq", F.to_json(F.struct(F.array(one).alias("results"))).alias("json"))
    return tables.flatten_listing(pages, "https://school.example.org/list")
