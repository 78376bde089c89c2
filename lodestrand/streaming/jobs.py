"""Structured Streaming forms of the event and file operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from lodestrand.sources.sinks import SnapshotTable


def event_stream(spark: SparkSession, folder: str, schema: StructType, per_trigger: int = 16) -> DataFrame:
    """Events from files of a folder, a bounded number of files a trigger; each event once within the watermark."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events by event_id once; state is dropped with the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def counts_by_window(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events by window and type."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n")


def bursts(events: DataFrame, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Trailing-edge debounce: bursts of a key with gaps below `gap`, each with its last event, when it is over."""
    rows = events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w"))
    return rows.agg(F.count("*").alias("events"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id")).select(key, F.col("w.start").alias("began"), "events", "event_id")


def limited(events: DataFrame, key: str, most: int, seconds: float, late: str = "1 hour") -> DataFrame:
    """key, event_id of the events that a limit of `most` in any `seconds` admits (1: leading-edge debounce).

    State by key is the times admitted last, `most` at most; it goes when the watermark has passed them. Within a trigger
    events are taken in order of time; an event older than what was admitted counts by its own time."""
    span = int(seconds * 1_000_000)

    def admit(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["t", "event_id"])
        kept = []
        for t, e in zip(rows["t"].tolist(), rows["event_id"].tolist()):
            held = [x for x in held if x > t - span]
            if len(held) < most:
                held.append(t)
                kept.append(e)
        state.update((held,))
        if held:
            state.setTimeoutTimestamp(max(max(held) // 1000 + int(seconds * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [name[0]] * len(kept), "event_id": kept})

    kind = events.schema[key].dataType.simpleString()
    rows = events.withWatermark("ts", late).select(key, "event_id", "ts", F.unix_micros("ts").alias("t"))
    return rows.groupBy(key).applyInPandasWithState(admit, f"{key} {kind}, event_id long", "held array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def tracked_operations(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """operation_id, status, events of each operation that ends, or times out a day after its last event."""

    def track(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            seen = state.get[0]
            state.remove()
            yield pd.DataFrame({"operation_id": [name[0]], "status": ["abandoned"], "events": [seen]})
            return
        seen = state.get[0] if state.exists else 0
        out = []
        rows = pd.concat(list(batches)).sort_values(["t", "event_id"])
        for status in rows["status"]:
            seen += 1
            if status in ("completed", "failed"):
                out.append((name[0], status, seen))
                seen = 0
        if seen:
            state.update((seen,))
            state.setTimeoutTimestamp(max(int(rows["t"].max() // 1000) + 86_400_000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["operation_id", "status", "events"])

    kind = events.schema["operation_id"].dataType.simpleString()
    rows = events.withWatermark("ts", late).select("operation_id", "event_id", "status", "ts", F.unix_micros("ts").alias("t"))
    return rows.groupBy("operation_id").applyInPandasWithState(track, f"operation_id {kind}, status string, events long", "seen long", "append", GroupStateTimeout.EventTimeTimeout)


def into_table(stream: DataFrame, table: SnapshotTable, checkpoint: str, order: str | None = None, every: str = "1 second"):
    """Upsert each micro-batch into a snapshot table."""

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            table.upsert(batch, order)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(write).start()


def fan_out(stream: DataFrame, handlers: dict[str, Callable[[DataFrame], None]], checkpoint: str):
    """Give each handler the events of its exact type, a micro-batch at a time."""

    def publish(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for kind, handler in handlers.items():
                handler(batch.filter(F.col("event_type") == kind))
        finally:
            batch.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(publish).start()


def new_files(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """Files as they are added to a folder, with their bytes."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true").load(folder)
