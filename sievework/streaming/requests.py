"""Request streams: throttling, cache hits, audit rows. Each has a batch twin that gives the same rows.

The windows are anchored: a window starts at the first request after the last one ended, so they are neither tumbling
nor sessions, and the state of an identity is (window start, count, last passed). The batch twin sorts requests by key
and time (the sort spills) and folds them as they pass: a task holds one batch and the state of one key, however many
requests a key has. The requests of one identity are still one task's, in linear time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MIN_GAP_MS, WINDOW_MS, MOST, TTL_MS = 2_000, 60_000, 30, 180_000
VERDICT = "identity long, seq long, ms long, verdict string"
PLAIN = {"string": pa.string(), "boolean": pa.bool_()}


def _millis(ts: Column | str) -> Column:
    """Milliseconds of a time; one without a zone is taken in the session's, which should be UTC."""
    return F.unix_millis(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def fold(requests: DataFrame, keys: list[str], name: str, kind: str, step) -> DataFrame:
    """keys, seq and name of requests (keys, seq, ms): step(state, ms) -> (state, value) in order of time within a key.
    The state begins as None."""
    held = requests.select(*keys, "seq", "ms").repartition(*keys).sortWithinPartitions(*keys, "ms", "seq")
    out = held.drop("ms").withColumn(name, F.lit(None).cast(kind)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = state = None
        for b in batches:
            values = []
            for key, ms in zip(zip(*(b.column(k).to_pylist() for k in keys), strict=True), b.column("ms").to_pylist(), strict=True):
                if key != now:
                    now, state = key, None
                state, value = step(state, ms)
                values.append(value)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in [*keys, "seq"]), pa.array(values, PLAIN[kind])], names=[*keys, "seq", name])

    return held.mapInArrow(run, out)


def throttle_batch(requests: DataFrame, min_gap: int = MIN_GAP_MS, window: int = WINDOW_MS, most: int = MOST) -> DataFrame:
    """identity, seq, verdict of requests (identity, seq, ts): passed, too_soon or too_many."""

    def step(state: tuple | None, ms: int | None) -> tuple[tuple, str]:
        last, begin, n = state or (None, None, 0)
        if last is not None and ms is not None and ms - last < min_gap:
            return state, "too_soon"
        if begin is None or (ms is not None and ms - begin >= window):
            begin, n = ms, 0
        return (ms, begin, n + 1), "too_many" if n + 1 > most else "passed"

    return fold(requests.select("identity", "seq", _millis("ts").alias("ms")), ["identity"], "verdict", "string", step)


def throttle_stream(requests: DataFrame, min_gap: int = MIN_GAP_MS, window: int = WINDOW_MS, most: int = MOST) -> DataFrame:
    """The same as a stream: state per identity. Requests of one micro-batch are taken in order of time."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, begin, n = state.get if state.exists else (None, None, 0)
        rows = pd.concat(list(frames)).sort_values(["ms", "seq"])
        verdicts = []
        for ms in rows["ms"].tolist():
            if last is not None and ms - last < min_gap:
                verdicts.append("too_soon")
                continue
            last = ms
            if begin is None or ms - begin >= window:
                begin, n = ms, 0
            n += 1
            verdicts.append("too_many" if n > most else "passed")
        state.update((last, begin, n))
        yield pd.DataFrame({"identity": key[0], "seq": rows["seq"], "ms": rows["ms"], "verdict": verdicts})

    held = requests.select("identity", "seq", _millis("ts").alias("ms"))
    return held.groupBy("identity").applyInPandasWithState(run, VERDICT, "last long, begin long, n int", "append", GroupStateTimeout.NoTimeout)


def cache_hits(requests: DataFrame, ttl: int = TTL_MS) -> DataFrame:
    """identity, payload, seq, hit of requests (identity, seq, ts, payload): within ttl of the last miss of the same payload."""

    def step(miss: int | None, ms: int | None) -> tuple[int | None, bool]:
        hit = miss is not None and ms is not None and ms - miss <= ttl
        return (miss if hit else ms), hit

    return fold(requests.select("identity", "payload", "seq", _millis("ts").alias("ms")), ["identity", "payload"], "hit", "boolean", step)


def audit_rows(requests: DataFrame) -> DataFrame:
    """seq, identity as a digest, hit: what is kept of each request."""
    return cache_hits(requests).select("seq", F.sha2(F.col("identity").cast("string"), 256).alias("identity_key"), "hit")


def audit_stream(requests: DataFrame, path: str, checkpoint: str):
    """Appends (seq, ts, identity_key, event_type) of a stream to a Parquet table; everything that is there, then stops."""
    kept = requests.select("seq", "ts", F.sha2(F.col("identity").cast("string"), 256).alias("identity_key"), "event_type")
    return kept.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
