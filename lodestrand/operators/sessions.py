"""Sessions and the state of an index, as DataFrames; `now` is always given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hours_idle(last_active: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(last_active)) / 3.6e9


def list_sessions(sessions: DataFrame, project: str | None = None, expired: bool = False, limit: int = 50) -> DataFrame:
    """The `limit` sessions (session_id, project_id, last_active, is_expired) active last, of one project or all."""
    rows = sessions.filter(F.col("project_id") == project) if project else sessions
    rows = rows if expired else rows.filter(~F.coalesce("is_expired", F.lit(False)))
    return rows.orderBy(F.desc_nulls_last("last_active"), "session_id").limit(limit)


def expired_sessions(sessions: DataFrame, now: Column, hours: float) -> DataFrame:
    """Sessions in force that were active more than so many hours ago, with inactive_hours; ones without a time stay in force."""
    idle = hours_idle(F.col("last_active"), now)
    return sessions.filter(~F.coalesce("is_expired", F.lit(False)) & (idle > hours)).withColumn("inactive_hours", idle)


def expire(sessions: DataFrame, now: Column, hours: float) -> DataFrame:
    """All sessions, those idle for so long marked as expired."""
    gone = F.coalesce(hours_idle(F.col("last_active"), now) > hours, F.lit(False))
    return sessions.withColumn("is_expired", F.coalesce("is_expired", F.lit(False)) | gone)


def index_state(operations: DataFrame, counts: DataFrame, now: Column, sparse: int = 50, stale_seconds: float = 300.0) -> DataFrame:
    """project_id, state: INDEXING while an operation is open, STALE once that has not got on for `stale_seconds`, else READY, or
    SPARSE below `sparse` chunks.

    operations: project_id, status (started, progress, completed, failed), last_at; counts: project_id, chunks. A project in
    either has a row; without chunks it has none."""
    live = operations.filter(F.col("status").isin("started", "progress")).groupBy("project_id").agg(F.max("last_at").alias("last_at"))
    rows = counts.select("project_id", "chunks").join(live, "project_id", "full")
    quiet = (F.unix_micros(now) - F.unix_micros("last_at")) > stale_seconds * 1e6
    state = F.when(F.col("last_at").isNotNull() & quiet, "STALE").when(F.col("last_at").isNotNull(), "INDEXING").when(F.coalesce("chunks", F.lit(0)) < sparse, "SPARSE").otherwise("READY")
    return rows.select("project_id", state.alias("state"))
