"""Stage events as a stream: ordered state per document and stage, windows and sessions.

An event counts only if its sequence number is higher than any seen for its
document and stage, so late and repeated events change nothing. State is dropped
by the watermark. The batch queries below give the same results over a whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paperloom.sources.tables import read_table

#: States that end a stage (fixed values).
TERMINAL = ("completed", "warning", "failed", "skipped")
OUT = "doc_id string, stage string, state string, seq bigint, applied bigint, dropped bigint"
STATE = "seq bigint, state string, applied bigint, dropped bigint"


def _apply(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seq, current, applied, dropped = state.get if state.exists else (-1, "pending", 0, 0)
    if state.hasTimedOut:
        state.remove()
        if current not in TERMINAL:
            # A stream that ended leaves running stages failed.
            yield pd.DataFrame([(*key, "failed", seq, applied, dropped)], columns=[c.split()[0] for c in OUT.split(", ")])
        return
    behind = None if state.exists else pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
    for frame in frames:
        if behind is not None:
            # What was removed by the watermark is not begun anew by a late event.
            frame = frame[frame["ts"] >= behind]
        for n, name in frame.sort_values("seq", kind="stable")[["seq", "state"]].itertuples(index=False):
            if n > seq:
                seq, current, applied = int(n), name, applied + 1
            else:
                dropped += 1
    if seq < 0:
        return
    state.update((seq, current, applied, dropped))
    state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + 3_600_000)
    yield pd.DataFrame([(*key, current, seq, applied, dropped)], columns=[c.split()[0] for c in OUT.split(", ")])


def stage_states(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Streaming state of each document and stage from ``doc_id, stage, state, seq, ts``."""
    marked = events.withWatermark("ts", delay)
    return marked.groupBy("doc_id", "stage").applyInPandasWithState(_apply, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def deduplicated(events: DataFrame, key: str, delay: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Events of each name by window of event time."""
    w = F.window("ts", width, slide or width)
    return events.withWatermark("ts", delay).groupBy(w, "event_name").agg(F.count(F.lit(1)).alias("events"))


def sessions(events: DataFrame, user: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(user, F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("events"))


def _events(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "audit", "audit_id", "ts", "event_name", "ref_id", "workspace_id").distinct()
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_stages(spark: SparkSession, folder: str) -> DataFrame:
    """Last applied event of each document and event name, and how many came out of order (by receipt)."""
    rows = read_table(spark, folder, "audit", "audit_id", "ts", "received_at", "event_name", "ref_id").distinct()
    from pyspark.sql import Window

    arrival = Window.partitionBy("ref_id", "event_name").orderBy("received_at", "audit_id")
    seen = F.max("audit_id").over(arrival.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("late", F.coalesce(F.col("audit_id") <= seen, F.lit(False)))
    return marked.groupBy("ref_id", "event_name").agg(F.max("audit_id").alias("seq"), F.count_if(~F.col("late")).alias("applied"), F.count_if("late").alias("dropped"))


def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events of each name and day."""
    rows = _events(spark, folder).groupBy(F.window("ts", "1 day").alias("w"), "event_name").agg(F.count(F.lit(1)).alias("events"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_name", "events")


def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of the events table: a user's events apart by less than thirty minutes."""
    rows = read_table(spark, folder, "events", "event_id", "ts", "user_id", "value").withColumn("ts", F.col("ts").cast("timestamp"))
    out = rows.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("value"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "events", "value")


def stream_event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Sliding windows over the events table (no counterpart in the system this engine follows)."""
    rows = read_table(spark, folder, "events", "ts", "event_type", "value").withColumn("ts", F.col("ts").cast("timestamp"))
    out = rows.groupBy(F.window("ts", "2 hours", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("value"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "events", "value")


QUERIES = {f.__name__: f for f in (stream_stages, stream_windows, stream_sessions, stream_event_windows)}
ORACLE = {
    "stream_stages": """
        WITH a AS (SELECT DISTINCT audit_id, ts, received_at, event_name, ref_id FROM audit),
        m AS (SELECT *, coalesce(audit_id <= max(audit_id) OVER (PARTITION BY ref_id, event_name ORDER BY received_at, audit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM a)
        SELECT ref_id, event_name, max(audit_id) AS seq, count(*) FILTER (NOT late) AS applied, count(*) FILTER (late) AS dropped FROM m GROUP BY ALL""",
    "stream_windows": """SELECT date_trunc('day', ts) AS day, event_name, count(*) AS events FROM (SELECT DISTINCT audit_id, ts, event_name, ref_id, workspace_id FROM audit) GROUP BY ALL""",
    "stream_sessions": """
        WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, min(ts) AS start, count(*) AS events, round(sum(value), 4) AS value FROM s GROUP BY user_id, k""",
    "stream_event_windows": """
        WITH e AS (SELECT ts, event_type, value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events)
        SELECT start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM e GROUP BY ALL""",
}
