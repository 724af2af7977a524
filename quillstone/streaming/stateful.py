"""Login throttle and model cooldowns: with state on a stream, and the same on a table."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Attempts that are let through in a stretch of seconds.
ATTEMPTS, SECONDS = 8, 60.0
#: Seconds that a model is set aside: allowance spent, too many requests, other errors.
ASIDE = {"credit": 3600.0, "rate": 45.0, "error": 30.0}


def throttle(recent: list[float], at: float, success: bool, attempts: int = ATTEMPTS, seconds: float = SECONDS) -> tuple[list[float], bool]:
    """The recorded attempts after one more, and whether it is let through. What is rejected isn't recorded; a success clears all."""
    recent = [t for t in recent if at - t < seconds]
    if len(recent) >= attempts:
        return recent, False
    return [] if success else [*recent, at], True


def throttle_stream(attempts: DataFrame, late: str = "1 minute") -> DataFrame:
    """user_id, at, allowed of a stream of attempts (user_id long, ts timestamp, success boolean). A user's state goes when event time has passed it by."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        rows = []
        for r in pd.concat(batches).sort_values(["at", "success"]).itertuples(index=False):
            recent, allowed = throttle(recent, r.at, r.success)
            rows.append((key[0], r.at, allowed))
        state.update((recent,))
        state.setTimeoutTimestamp(int(max(1000 * (rows[-1][1] + SECONDS), state.getCurrentWatermarkMs() + 1)))
        yield pd.DataFrame(rows, columns=["user_id", "at", "allowed"])

    timed = attempts.withWatermark("ts", late).withColumn("at", F.unix_micros("ts") / 1e6)
    return timed.groupBy("user_id").applyInPandasWithState(run, "user_id long, at double, allowed boolean", "recent array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def _throttled(n: int, seconds: float):
    schema = pa.schema([("user_id", pa.int64()), ("attempt_id", pa.int64()), ("at", pa.float64()), ("allowed", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, recent = None, deque()
        for data in batches:
            users, times = data.column("user_id").to_pylist(), data.column("at").to_pylist()
            allowed = []
            for who, at, success in zip(users, times, data.column("success").to_pylist(), strict=True):
                if who != user:
                    user, recent = who, deque()
                while recent and at - recent[0] >= seconds:
                    recent.popleft()
                allowed.append(len(recent) < n)
                if allowed[-1]:
                    recent.clear() if success else recent.append(at)
            yield pa.RecordBatch.from_arrays([data.column("user_id"), data.column("attempt_id"), data.column("at"), pa.array(allowed, pa.bool_())], schema=schema)

    return run


def throttle_table(attempts: DataFrame, n: int = ATTEMPTS, seconds: float = SECONDS) -> DataFrame:
    """The same of a table (attempt_id, user_id, at, success): user_id, attempt_id, at, allowed.

    Attempts are sorted by user and time within partitions and pass by once; what is kept is one user's last few.
    """
    rows = attempts.select(F.col("user_id").cast("long").alias("user_id"), F.col("attempt_id").cast("long").alias("attempt_id"), F.col("at").cast("double").alias("at"), "success")
    ordered = rows.repartition("user_id").sortWithinPartitions("user_id", "at", "success", "attempt_id")
    return ordered.mapInArrow(_throttled(n, seconds), "user_id long, attempt_id long, at double, allowed boolean")


def cooldown_until(kind: Column, at: Column) -> Column:
    return at + F.when(kind == "credit", ASIDE["credit"]).when(kind == "rate", ASIDE["rate"]).otherwise(ASIDE["error"])


def cooldown_stream(errors: DataFrame) -> DataFrame:
    """model, until, credit of a stream of errors (model, kind, at double): the latest one decides. For outputMode("update")."""
    latest = F.max_by(F.struct(cooldown_until(F.col("kind"), F.col("at")).alias("until"), (F.col("kind") == "credit").alias("credit")), "at")
    return errors.groupBy("model").agg(latest.alias("s")).select("model", "s.until", "s.credit")


def availability(errors: DataFrame, now: float) -> DataFrame:
    """model, ready at a time, of a table of errors."""
    return cooldown_stream(errors.where(F.col("at") <= now)).select("model", (F.col("until") <= now).alias("ready"))


def event_counts(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by window of event time and type, with a watermark: an addition for streams, the batch result is the same."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n")
