from datetime import datetime

from quire.operators.versions import next_status
from quire.streaming import windows


def drain(df, spark, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def test_usage_windows(spark, tmp_path):
    rows = [(datetime(2024, 1, d, 5), "click", float(d)) for d in (1, 1, 2, 5)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    events = windows.read_files(spark, str(tmp_path / "in"), "ts timestamp, event_type string, value double")
    got = {(r.starts.day, r.n, r.value) for r in drain(windows.usage_windows(events), spark, "usage_w", "complete").collect()}
    assert got == {(1, 2, 2.0), (2, 1, 2.0), (5, 1, 5.0)}


def test_page_states_end_after_cap(spark, tmp_path):
    rows = [("p", False), ("p", False), ("p", True), ("q", True), ("q", False)]
    spark.createDataFrame(rows, "page_id string, ok boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    pages = windows.read_files(spark, str(tmp_path / "in"), "page_id string, ok boolean")
    got = {(r.page_id, r.status, r.attempts) for r in drain(windows.page_states(pages), spark, "pages_s", "update").collect()}
    assert got == {("p", "exhausted", 2), ("q", "success", 1)}


def test_keep_latest_is_repeatable(spark, tmp_path):
    fold = windows.keep_latest(str(tmp_path), "id", "n")
    first = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, n int")
    second = spark.createDataFrame([(1, "c", 2)], "id int, v string, n int")
    fold(first, 0)
    fold(second, 1)
    fold(second, 1)
    assert {tuple(r) for r in windows.latest_rows(spark, str(tmp_path)).collect()} == {(1, "c", 2), (2, "b", 1)}


def test_next_status(spark):
    rows = [("a", "processing", 0), ("b", "failed", 2), ("c", "failed", 1), ("d", "success", 1)]
    got = {r.page_id: r.state for r in next_status(spark.createDataFrame(rows, "page_id string, status string, attempts int")).collect()}
    assert got == {"a": "retry", "b": "exhausted", "c": "retry", "d": "settled"}
