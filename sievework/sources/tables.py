"""Sources and sinks: header tables with aliases, listings, documents, versioned publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import text as T


def read_table(spark: SparkSession, path: str, aliases: dict[str, tuple[str, ...]], required: tuple[str, ...] = ()) -> DataFrame:
    """A header CSV as strings. Each logical column takes the first non-blank value of its candidate names (any case)."""
    raw = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    have: dict[str, str] = {}
    for c in raw.columns:  # the first of equal names counts; a byte-order mark is no part of a name
        have.setdefault(c.lstrip("﻿").strip().lower(), c)
    columns = []
    for name, candidates in aliases.items():
        held = [T.norm_or_blank(F.col(f"`{have[c.lower()]}`")) for c in candidates if c.lower() in have]
        if not held and name in required:
            raise ValueError(f"no column for {name}: one of {', '.join(candidates)} is needed")
        columns.append(F.coalesce(*[F.when(h != "", h) for h in held], F.lit("")).alias(name))
    return raw.select(*columns)


def write_table(df: DataFrame, path: str, columns: list[str]) -> None:
    """The columns in order as a header CSV; words for nothing are blank."""
    df.select(*[T.norm_or_blank(c).alias(c) for c in columns]).write.mode("overwrite").option("header", True).csv(path)


def read_rules(spark: SparkSession, path: str, fields: tuple[str, ...]) -> dict[str, tuple[str, ...]]:
    """Lists of patterns or tokens of a rules JSON, lowered; a missing list is empty. One small file."""
    schema = ", ".join(f"{f} array<string>" for f in fields)
    row = spark.read.schema(schema).option("multiLine", True).json(path).first()
    return {f: tuple(x.strip().lower() for x in (row[f] if row and row[f] else []) if x and x.strip()) for f in fields}


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Captured pages as (program_id, doc_seq, url, text): one file a page, its folder the program, its first line 'URL: x'."""
    raw = spark.read.text(f"{folder}/*/*.txt", wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    url = F.trim(F.regexp_extract("value", r"^URL:[ \t]*([^\r\n]*)", 1))
    body = F.regexp_replace("value", r"^URL:[^\r\n]*\r?\n", "")
    parts = F.split("path", "/")
    rows = raw.select(F.element_at(parts, -2).alias("program_id"), F.element_at(parts, -1).alias("file"), url.alias("url"), body.alias("text"))
    from pyspark.sql import Window

    return rows.withColumn("doc_seq", F.row_number().over(Window.partitionBy("program_id").orderBy("file")) - 1).drop("file")


def read_marks(spark: SparkSession, path: str) -> DataFrame:
    """student marks from JSON lines {student_id, courses: {course: mark}} as student_id, course, mark."""
    raw = spark.read.schema("student_id long, courses map<string,double>").json(path)
    return raw.select("student_id", F.explode("courses").alias("course", "mark"))


def flatten_listing(payload: DataFrame, base: str) -> DataFrame:
    """API pages (seq, json) as (title, url, credential, languages): incomplete rows dropped, the first of each URL."""
    schema = "struct<results:array<struct<title:string,url:string,credential:string,languages:array<string>>>>"
    long = payload.select("seq", F.posexplode(F.from_json("json", schema)["results"]).alias("at", "r"))
    once = F.aggregate(
        F.transform(F.coalesce("r.languages", F.array().cast("array<string>")), lambda x: T.norm_space(x)), F.array().cast("array<string>"),
        lambda acc, x: F.when((x == "") | F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))),
    )
    title = T.norm_space(F.regexp_replace(F.coalesce("r.title", F.lit("")), r"\s+[|–-]\s+[^|]*$", ""))
    rows = long.select("seq", "at", title.alias("title"), T.resolve_url(F.lit(base), F.coalesce("r.url", F.lit(""))).alias("url"), T.norm_or_blank("r.credential").alias("credential"), F.array_join(once, "; ").alias("languages"))
    rows = rows.filter((F.col("title") != "") & T.is_http_url("url"))
    first = F.min_by(F.struct("title", "url", "credential", "languages"), F.struct("seq", "at"))
    return rows.groupBy(F.lower("url").alias("k")).agg(first.alias("f")).select("f.*")


def content_stamp(df: DataFrame) -> DataFrame:
    """One row (rows, stamp): a digest that does not depend on order or partitioning."""
    row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(df.columns)])
    sums = df.select(row.alias("h")).agg(F.count("*").alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).alias("a"), F.bit_xor("h").alias("b"))
    return sums.select("rows", F.sha2(F.concat_ws("|", "rows", "a", "b"), 256).alias("stamp"))


def publish_snapshot(df: DataFrame, folder: str, required: list[str], least_rows: int = 1) -> int:
    """Writes df as the next version under folder after its checks; older versions stay. Returns the version.

    A version counts once its row is in the manifest table, which is written last: readers of latest_version never see
    a half-written one, and a failed job leaves the last good one current.
    """
    spark = df.sparkSession
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    version = (latest_version(spark, folder) or 0) + 1
    df.write.mode("overwrite").parquet(f"{folder}/version={version}")
    stamp = content_stamp(spark.read.parquet(f"{folder}/version={version}")).first()
    if stamp["rows"] < least_rows:
        raise ValueError(f"{stamp['rows']} rows; at least {least_rows} are needed")
    spark.createDataFrame([(version, stamp["rows"], stamp["stamp"])], "version int, rows long, stamp string").coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return version


def latest_version(spark: SparkSession, folder: str) -> int | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema("version int, rows long, stamp string").parquet(f"{folder}/manifest").agg(F.max("version")).first()[0]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def read_latest(spark: SparkSession, folder: str) -> DataFrame:
    version = latest_version(spark, folder)
    if version is None:
        raise FileNotFoundError(f"no published version in {folder}")
    return spark.read.parquet(f"{folder}/version={version}")
