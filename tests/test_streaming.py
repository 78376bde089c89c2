import pytest

from lodestrand.operators import events as E
from lodestrand.plans.event_queries import events
from lodestrand.sources.sinks import SnapshotTable
from lodestrand.streaming import jobs as J

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture()
def stream(spark, tmp_path):
    """The events as one file for each span of time, oldest first, and the batch they come from."""
    rows = events(spark, FOLDER)
    source = f"{tmp_path}/in"
    ordered = rows.orderBy("ts").collect()
    third = len(ordered) // 3 + 1
    for i in range(0, len(ordered), third):
        spark.createDataFrame(ordered[i : i + third], rows.schema).coalesce(1).write.mode("append").parquet(source)
    return J.event_stream(spark, source, rows.schema, 1), rows


def drain(df, tmp_path, name, mode="append"):
    out = f"{tmp_path}/{name}"
    got = []
    query = df.writeStream.outputMode(mode).option("checkpointLocation", out).foreachBatch(lambda b, n: got.extend(b.collect())).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return got


def test_events_once(spark, stream, tmp_path):
    source, rows = stream
    assert len(drain(J.once(source.union(source), "100 days"), tmp_path, "once")) == rows.count()


def test_limits_match_the_batch_form(spark, stream, tmp_path):
    source, rows = stream
    got = {r.event_id for r in drain(J.limited(source, "operation_id", 2, 43200, "100 days"), tmp_path, "limit")}
    assert got == {r.event_id for r in E.rate_limited(rows, "operation_id", 2, 43200).collect()}
    got = {r.event_id for r in drain(J.limited(source, "operation_id", 1, 21600, "100 days"), tmp_path, "debounce")}
    assert got == {r.event_id for r in E.debounced(rows, "operation_id", 21600).collect()}


def test_bursts_that_are_over_match_the_batch_form(spark, stream, tmp_path):
    source, rows = stream
    got = {(r.operation_id, r.events, r.event_id) for r in drain(J.bursts(source, "operation_id", "6 hours", "1 second"), tmp_path, "bursts")}
    assert got and got <= {(r.operation_id, r.events, r.event_id) for r in E.settled(rows, "operation_id", 21600).collect()}


def test_windows_and_operations(spark, stream, tmp_path):
    source, rows = stream
    assert drain(J.counts_by_window(source, "1 day", "1 second"), tmp_path, "windows")
    ended = drain(J.tracked_operations(source, "100 days"), tmp_path, "operations")
    assert len(ended) == rows.filter("status in ('completed', 'failed')").count()


def test_table_and_handlers(spark, stream, tmp_path):
    source, rows = stream
    table = SnapshotTable(spark, f"file://{tmp_path}/table", ["event_id"])
    query = J.into_table(source, table, f"{tmp_path}/c1", every="0 seconds")
    query.processAllAvailable()
    query.stop()
    assert table.read().count() == rows.count()
    seen = []
    query = J.fan_out(source, {"click": lambda b: seen.append(b.count())}, f"{tmp_path}/c2")
    query.processAllAvailable()
    query.stop()
    assert sum(seen) == rows.filter("event_type = 'click'").count()


def test_new_files(spark, tmp_path):
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.txt").write_text("one")
    assert [bytes(r.content) for r in drain(J.new_files(spark, f"{tmp_path}/files"), tmp_path, "seen")] == [b"one"]
