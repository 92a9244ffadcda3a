"""Sliding-window limiter and circuit breaker: one state machine each, for batches and for streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def admit(times: list[float], held: list[float], limit: int, window: float) -> tuple[list[bool], list[float]]:
    """Which of the times (ascending) are accepted, given those held before; denied ones are not held."""
    out, kept = [], list(held)
    for t in times:
        kept = [k for k in kept if t - k < window]
        ok = len(kept) < limit
        if ok:
            kept.append(t)
        out.append(ok)
    return out, kept


def break_calls(calls: list[tuple[float, bool]], failures: int, until: float, most: int, pause: float) -> tuple[list[bool], int, float]:
    """Which calls pass; after `most` failures in a row all are held back for `pause`, and one more failure opens again."""
    out = []
    for t, failed in calls:
        ok = t >= until
        if ok:
            failures = failures + 1 if failed else 0
            if failures >= most:
                until = t + pause
        out.append(ok)
    return out, failures, until


def _by_key(rows: DataFrame, flags: list[str], decide: Callable[[], Callable[..., bool]], out: str) -> DataFrame:
    """(event_id, key, out) of rows (event_id, key, ts, flags): each key's rows in order of ts, event_id, given to a fresh decide().

    Keys are dealt out and sorted; a task walks over its rows and holds the state of one key only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, step = object(), None
        for b in batches:
            found = []
            for k, t, *more in zip(*[b.column(i).to_pylist() for i in range(1, b.num_columns)], strict=True):
                if k != key:
                    key, step = k, decide()
                found.append(step(t / 1e6, *more))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.bool_())], names=["event_id", "key", out])

    given = rows.where(F.col("ts").isNotNull()).select(F.col("event_id").cast("long").alias("event_id"), F.col("key").cast("string").alias("key"), F.unix_micros("ts").alias("t"), *flags)
    dealt = given.repartition("key").sortWithinPartitions("key", "t", F.col("event_id").asc_nulls_last())
    return dealt.mapInArrow(run, f"event_id long, key string, {out} boolean")


def limit_requests(requests: DataFrame, limit: int, window: float) -> DataFrame:
    """(event_id, key, accepted) of requests (event_id, key, ts); a key's requests in order of ts, event_id."""

    def decide() -> Callable[[float], bool]:
        kept: deque[float] = deque()  # ascending, so the old ones leave at its head

        def step(t: float) -> bool:
            while kept and t - kept[0] >= window:
                kept.popleft()
            if len(kept) >= limit:
                return False
            kept.append(t)
            return True

        return step

    return _by_key(requests, [], decide, "accepted")


def break_circuits(calls: DataFrame, most: int, pause: float) -> DataFrame:
    """(event_id, key, passed) of calls (event_id, key, ts, failed)."""

    def decide() -> Callable[[float, bool], bool]:
        failures, until = 0, float("-inf")

        def step(t: float, failed: bool | None) -> bool:
            nonlocal failures, until
            (ok,), failures, until = break_calls([(t, bool(failed))], failures, until, most, pause)
            return ok

        return step

    return _by_key(calls, ["failed"], decide, "passed")


def limit_stream(requests: DataFrame, limit: int, window: float) -> DataFrame:
    """The limiter on a stream, append mode; the accepted times of a key are its state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        held = list(state.get[0]) if state.exists else []
        ok, held = admit([t.timestamp() for t in pdf.ts], held, limit, window)
        state.update((held,))
        yield pd.DataFrame({"event_id": pdf.event_id, "key": key[0], "accepted": ok})

    return requests.groupBy("key").applyInPandasWithState(run, "event_id long, key string, accepted boolean", "held array<double>", "append", GroupStateTimeout.NoTimeout)


def windowed_stream(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts, errors and mean by window with a watermark; ts may be a timestamp without zone."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.avg("value"), 4).alias("avg_value")).select(F.col("w.start").alias("hour"), "n", "errors", "avg_value")
