"""What the corpus operators share: word rules, the shared folder, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words in a shingle and the share of shingles that makes two texts near copies.
SHINGLE = 5
SIMILARITY = 0.8

#: A side of a join is broadcast only below this many rows of a few dozen bytes each.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where that is unset (tests)."""
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir"):
        return found
    if not (held := sc._jsc.sc().getCheckpointDir()).isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is needed on a cluster")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        held = sc._jsc.sc().getCheckpointDir()
    return held.get()


def new_folder(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows with the lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, what: str) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read back: nothing of the old plan stays, not even
    the constraints that a checkpoint keeps."""
    folder = new_folder(df.sparkSession, what)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint where the counted rows are few; else Spark joins by shuffle and splits skewed keys."""
    return F.broadcast(df) if rows <= limit else df


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns that the operator is about to add, whatever their case."""
    own = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in own])


def let(value: Column, use) -> Column:
    """use(value) with value computed once a row, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column | str, lower: bool = True) -> Column:
    """The words of a text as an array; a null or blank text has none."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    if lower:
        text = F.translate(text, UPPER, LOWER)
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def lowest(df: DataFrame, by: str, key: str, k: int) -> DataFrame:
    """The k rows of each value of ``by`` with the smallest hash of key, and their place as ``at``.

    Rows are counted first, and of a frequent value only hashes below twice the share that is needed are ranked: about
    2 * k rows of a value meet in a task, however many it has. Repeated keys can leave a value with fewer than k.
    """
    counted = df.groupBy(by).count().select(F.col(by).alias("__by"), F.col("count").alias("__n"))
    share = (F.xxhash64(key).bitwiseAND(F.lit((1 << 40) - 1).cast("long"))) * F.col("__n") <= F.lit(float(2 * k)) * float(1 << 40)
    few = df.join(counted, F.expr(f"`{by}` = __by")).filter(share).drop("__by", "__n")
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.xxhash64(key).bitwiseAND(F.lit((1 << 40) - 1).cast("long")), key))
    return few.withColumn("at", place).filter(F.col("at") <= k)


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """df with its columns of those names (whatever their case) renamed, and the columns that restore df."""
    own = {n.lower() for n in names}
    held = {c: f"__own_{i}" if c.lower() in own else c for i, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in held.items()]), [F.col(f"`{n}`").alias(c) for c, n in held.items()]


def extended(df: DataFrame, **added: str) -> StructType:
    """The schema of df and columns after it."""
    return StructType([*df.schema.fields, *(StructType().add(n, t).fields[0] for n, t in added.items())])


def word_count(text: Column | str) -> Column:
    """The number of words of a text; 0 if it is null."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def doc_key(name: str = "doc_id") -> Column:
    """The id as text; null is the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
