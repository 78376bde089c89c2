"""Event analytics: operations, progress, latencies, limits on rates, debouncing. Batch forms; the streams use the same rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def select_events(events: DataFrame, kind: str | None = None, since: str | None = None, until: str | None = None, status: str | None = None, newest: bool = True, limit: int | None = None) -> DataFrame:
    """Events after `since` (exclusive) up to `until` (inclusive), sorted by time."""
    rows = events
    for value, test in ((kind, F.col("event_type") == kind), (status, F.col("status") == status), (since, F.col("ts") > F.lit(since).cast("timestamp")), (until, F.col("ts") <= F.lit(until).cast("timestamp"))):
        rows = rows.filter(test) if value is not None else rows
    rows = rows.orderBy(F.desc("ts") if newest else F.asc("ts"), "event_id")
    return rows.limit(limit) if limit is not None else rows


def operations(events: DataFrame) -> DataFrame:
    """One row per operation: first and last time, events, failures, last type and status, share finished."""
    last = F.max_by(F.struct("event_type", "status"), F.struct("ts", "event_id"))
    sums = events.groupBy("operation_id").agg(F.min("ts").alias("started"), F.max("ts").alias("last"), F.count("*").alias("events"), F.count_if(F.col("status") == "failed").alias("failed"), last.alias("l"))
    return sums.select("operation_id", "started", "last", "events", "failed", F.col("l.event_type").alias("last_type"), F.col("l.status").alias("last_status"))


def open_operations(events: DataFrame) -> DataFrame:
    """Operations started and neither completed nor failed since, with their events of progress."""
    done = events.filter(F.col("status").isin("completed", "failed")).groupBy("operation_id").agg(F.max("ts").alias("ended"))
    begun = events.filter("status = 'started'").groupBy("operation_id").agg(F.max("ts").alias("begun"))
    steps = events.filter("status = 'progress'").groupBy("operation_id").agg(F.count("*").alias("progress"), F.max("ts").alias("seen"))
    rows = begun.join(done, "operation_id", "left").filter("ended is null or ended < begun").join(steps, "operation_id", "left")
    return rows.select("operation_id", "begun", F.coalesce("progress", F.lit(0)).cast("long").alias("progress"), "seen")


def progress(events: DataFrame, kinds: list[str]) -> DataFrame:
    """Counts of the given event types, a column for each, by operation."""
    return events.groupBy("operation_id").agg(*(F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in kinds))


def latency(events: DataFrame, key: str, value: str, last: int = 100) -> DataFrame:
    """p50, p95, p99 of the last 100 values of a key: element floor(n p) of the sorted values, no interpolation."""
    recent = events.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id")))).filter(F.col("n") <= last)
    lists = recent.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("v"))  # `last` values at most
    at = lambda p: F.element_at("v", F.least(F.floor(F.size("v") * p).cast("int") + 1, F.size("v")))
    return lists.select(key, F.size("v").alias("samples"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def health(latencies: DataFrame) -> DataFrame:
    """Status by key from p95: critical from 2 s, degraded from 1 s; p95 in seconds."""
    return latencies.withColumn("health", F.when(F.col("p95") >= 2, "critical").when(F.col("p95") >= 1, "degraded").otherwise("healthy"))


def worst(status: Column) -> Column:
    rank = F.max(F.when(status == "critical", 2).when(status == "degraded", 1).otherwise(0))
    return F.when(rank == 2, "critical").when(rank == 1, "degraded").otherwise("healthy")


def errors(events: DataFrame, by: list[str], limit: int = 10) -> DataFrame:
    """The most frequent errors by the given columns."""
    return events.filter("status = 'failed'").groupBy(*by).agg(F.count("*").alias("errors")).orderBy(F.desc("errors"), *by).limit(limit)


def slow(events: DataFrame, value: str, least: float, limit: int = 20) -> DataFrame:
    return events.filter(F.col(value) >= least).orderBy(F.desc(value), "event_id").limit(limit)


def sampled(events: DataFrame, every: int = 10) -> DataFrame:
    """One progress event in `every` of an operation, and all others."""
    order = Window.partitionBy("operation_id", F.col("status") == "progress").orderBy("ts", "event_id")
    return events.withColumn("n", F.row_number().over(order)).filter((F.col("status") != "progress") | (F.col("n") % every == 0)).drop("n")


def calls_in_window(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """Events with the number of events of their key in the seconds up to and including them."""
    window = Window.partitionBy(key).orderBy(F.unix_micros("ts")).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("calls", F.count("*").over(window))


_STATE = "struct<last:array<bigint>,kept:array<bigint>>"


def _admitted(times: Column, most: int, span: int) -> Column:
    """Times that a sliding limit lets through: refused ones don't count against later ones."""
    begin = F.struct(F.array().cast("array<bigint>").alias("window"), F.array().cast("array<struct<t:bigint,e:bigint>>").alias("kept"))

    def step(state: Column, x: Column) -> Column:
        window = F.filter(state["window"], lambda t: t > x["t"] - span)
        fits = F.size(window) < most
        return F.struct(F.when(fits, F.concat(window, F.array(x["t"]))).otherwise(window).alias("window"), F.when(fits, F.concat(state["kept"], F.array(x))).otherwise(state["kept"]).alias("kept"))

    return F.aggregate(times, begin, step, lambda s: s["kept"])


def _folded(events: DataFrame, key: str, fold) -> DataFrame:
    """event_id of the events a fold over each key's time order keeps."""
    item = F.struct(F.unix_micros("ts").alias("t"), F.col("event_id").alias("e"))
    lists = events.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("x"))
    return lists.select(key, F.explode(fold(F.col("x"))).alias("x")).select(key, F.col("x.e").alias("event_id"))


def rate_limited(events: DataFrame, key: str, most: int, seconds: int) -> DataFrame:
    """key, event_id of the events that a limit of `most` in any `seconds` admits. The order within a key decides, so a
    key is folded by one task; keys of one user or session are small."""
    return _folded(events, key, lambda x: _admitted(x, most, seconds * 1_000_000))


def debounced(events: DataFrame, key: str, seconds: float) -> DataFrame:
    """key, event_id of the events kept by a leading-edge debounce: none within `seconds` of the last one kept."""
    return _folded(events, key, lambda x: _admitted(x, 1, int(seconds * 1_000_000)))


def settled(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """Trailing-edge debounce: bursts of a key with gaps below `seconds`, each with its last event: key, began, events, event_id."""
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order))
    rows = events.withColumn("new", F.when(gap < seconds * 1_000_000, 0).otherwise(1)).withColumn("burst", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "burst").agg(F.min("ts").alias("began"), F.count("*").alias("events"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id")).drop("burst")


def retained(events: DataFrame, cutoff: Column) -> DataFrame:
    return events.filter(F.col("ts") >= cutoff)


def eta(done: Column, total: Column, elapsed_seconds: Column) -> Column:
    """Seconds left at the speed so far; null before anything is done."""
    return F.when(done > 0, elapsed_seconds / done * F.greatest(total - done, F.lit(0)))


def strategy(percent: Column) -> Column:
    """Search strategy by the share of the index that is ready."""
    return F.when(percent < 10, "scan").when(percent < 50, "text").when(percent < 80, "mixed").otherwise("hybrid")
