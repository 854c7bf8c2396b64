"""Nightly refresh and live evaluation as streams of files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sievework.operators import evaluate as E
from sievework.sources.tables import publish_snapshot


def incremental_refresh(tables: DataFrame, folder: str, checkpoint: str, required: list[str], least_rows: int = 1):
    """Publishes each batch of a stream of full tables as a version after its checks; takes what is there, then stops."""

    def publish(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            publish_snapshot(batch, folder, required, least_rows)

    return tables.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What a student's state holds, and what comes out of it: all marks of the students that a batch has marks of.
HELD = "courses array<string>, marks array<double>, seqs array<bigint>"
ALL_MARKS = "student_id long, course_key string, mark double, seq long"


def _all_marks(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Takes new marks of a student into the state, the last (by seq) of each course, and returns them all."""
    held = {c: (m, s) for c, m, s in zip(*state.get, strict=True)} if state.exists else {}
    for batch in batches:
        for course, mark, seq in zip(batch["course_key"], batch["mark"], batch["seq"], strict=True):
            if course not in held or seq >= held[course][1]:
                held[course] = (float(mark), int(seq))
    courses = sorted(held)
    state.update((courses, [held[c][0] for c in courses], [held[c][1] for c in courses]))
    yield pd.DataFrame({"student_id": [key[0]] * len(courses), "course_key": courses, "mark": [held[c][0] for c in courses], "seq": [held[c][1] for c in courses]})


def marks_so_far(marks: DataFrame) -> DataFrame:
    """student_id, course_key, mark, seq of a stream of marks (student_id, course, mark, seq): in each batch, all marks of
    every student with a new one. A student's marks are state of the stream, so what a batch costs grows with its
    students and not with the history; null and NaN marks, courses and students count for nothing."""
    sound = marks.select(F.col("student_id").cast("long").alias("student_id"), E.canonical_course("course").alias("course_key"), "mark", F.col("seq").cast("long").alias("seq"))
    sound = sound.filter("student_id IS NOT NULL AND course_key <> '' AND mark IS NOT NULL AND NOT isnan(mark) AND seq IS NOT NULL")
    return sound.groupBy("student_id").applyInPandasWithState(_all_marks, ALL_MARKS, HELD, "update", GroupStateTimeout.NoTimeout)


def live_evaluation(marks: DataFrame, programs: DataFrame, path: str, checkpoint: str):
    """Evaluates the students of each batch of new marks, on all their marks so far, against the programs; one folder per
    batch, so a retried batch overwrites its own. live_results() has what holds now."""

    def run(batch: DataFrame, number: int) -> None:
        E.evaluate(programs, batch.select("student_id", "course_key", "mark")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return marks_so_far(marks).writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_results(results: DataFrame) -> DataFrame:
    """What holds of the rows that live_evaluation wrote (read with their batch): each student's of the last batch with that student."""
    last = results.groupBy("student_id").agg(F.max("batch").alias("batch"))
    return results.join(last, ["student_id", "batch"]).drop("batch")
