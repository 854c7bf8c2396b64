"""Queries of the composed stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import compose as P
from sievework.operators import evaluate as E
from sievework.operators import extract as X
from sievework.operators import merge as M
from sievework.plans.evaluation import _MARKS
from sievework.plans.keys import HTTP, NB, NK, NS, TOKENS, UK
from sievework.plans.registry import query


@query("mg06_apply_overrides", "v_canonical", sql=f"SELECT row_id, CASE WHEN row_id % 25 = 3 THEN '77' ELSE min_avg_final END AS min_avg_final, CASE WHEN NOT {HTTP('program_url')} AND row_id % 5 = 3 THEN 'https://fixed.example.org/x' ELSE program_url END AS program_url FROM v_canonical")
def mg06(can: DataFrame) -> DataFrame:
    ov = can.filter("row_id % 5 = 3").select("row_id", F.when(F.col("row_id") % 25 == 3, "77").otherwise(" nan ").alias("min_avg_final"), F.lit("https://fixed.example.org/x").alias("program_url"))
    return P.apply_overrides(can, ov, ["min_avg_final"]).select("row_id", "min_avg_final", "program_url")


@query(
    "ma02_rebuild_from_seed", "v_seed", "v_canonical",
    sql=f"""WITH l AS (SELECT seq AS id, institution AS block, {TOKENS('program_name')} AS tk FROM v_seed), r AS (SELECT row_id AS id, institution AS block, {TOKENS('program')} AS tk, {NK('program')} AS name FROM v_canonical),
      s AS (SELECT l.id AS l, r.id AS r, name, len(list_intersect(l.tk, r.tk)) / (len(l.tk) + len(r.tk) - len(list_intersect(l.tk, r.tk)))::DOUBLE AS score FROM l JOIN r USING (block) WHERE len(list_intersect(l.tk, r.tk)) > 0),
      b AS (SELECT *, max(score) OVER (PARTITION BY l) AS best FROM s), g AS (SELECT l, count(DISTINCT name) AS names FROM b WHERE best >= 0.55 AND best - score < 0.08 GROUP BY l),
      o AS (SELECT l, r FROM b WHERE best >= 0.55 AND best - score < 0.08 QUALIFY row_number() OVER (PARTITION BY l ORDER BY score DESC, r) = 1)
      SELECT l.id AS seq, CASE WHEN g.l IS NULL THEN 'none' WHEN names = 1 THEN 'matched' ELSE 'ambiguous' END AS status, coalesce(v.requirement_type, '') AS requirement_type, coalesce(v.min_avg_final, '') AS min_avg_final
      FROM l LEFT JOIN g ON g.l = l.id LEFT JOIN o ON o.l = l.id AND names = 1 LEFT JOIN v_canonical v ON v.row_id = o.r""",
)
def ma02(seeds: DataFrame, can: DataFrame) -> DataFrame:
    return P.rebuild_from_seed(seeds, can).select("seq", "status", "requirement_type", "min_avg_final")


@query("e14_average_messages", "v_marks", sql=f"WITH {_MARKS}, r AS (SELECT student_id, mark, row_number() OVER (PARTITION BY student_id ORDER BY mark DESC, course_key) AS n FROM marks), a AS (SELECT student_id, count(*) AS used, sum(mark) / count(*) AS average FROM r WHERE n <= 5 GROUP BY 1) SELECT student_id, CASE WHEN used < 5 THEN concat('Average incomplete (need 5 marks; have ', used, ')') WHEN average < 80 THEN concat('Admission average too low (', printf('%.1f', average), ' < 80)') ELSE '' END AS reasons FROM a")
def e14(marks: DataFrame) -> DataFrame:
    held = M.student_average(E.course_marks(marks), 5).withColumn("minimum", F.lit(80.0))
    return P.average_messages(held, 5).select("student_id", "reasons")


@query("e17_snapshot_result", "v_canonical", sql="SELECT row_id, CASE WHEN row_id % 5 = 0 THEN 'Uncheckable' WHEN row_id % 3 > 0 THEN 'Likely ineligible' ELSE 'Likely eligible' END AS result FROM v_canonical")
def e17(can: DataFrame) -> DataFrame:
    return can.select("row_id", P.snapshot_result(F.col("row_id") % 3, F.when(F.col("row_id") % 5 == 0, "Uncheckable").otherwise("High")).alias("result"))


@query("x14_x15_gates", "v_docs")
def gates(docs: DataFrame) -> DataFrame:
    return P.gates(docs)


@query("x17_signals", "v_docs", sql=f"WITH t AS (SELECT doc_id, {NS('text')} AS t FROM v_docs) SELECT doc_id, regexp_matches(t, '(?i){X.PATHWAY}') AS pathway, regexp_matches(t, '(?i){X.BROAD_CONTEXT}') AS requirement_context FROM t")
def x17(docs: DataFrame) -> DataFrame:
    t = T.norm_space("text")
    return docs.select("doc_id", X.found(t, X.PATHWAY).alias("pathway"), X.found(t, X.BROAD_CONTEXT).alias("requirement_context"))


@query("jo18_docs_for_links", "v_docs", "v_index", sql=f"SELECT v.seq, d.doc_id FROM v_index v JOIN v_docs d ON {UK('v.source_url')} = {UK('d.url')} WHERE {UK('v.source_url')} <> ''")
def jo18(docs: DataFrame, index: DataFrame) -> DataFrame:
    """The captured page of each link, by URL key."""
    return index.select("seq", T.url_key("source_url").alias("k")).filter("k <> ''").join(docs.select("doc_id", T.url_key("url").alias("k")), "k").select("seq", "doc_id")
