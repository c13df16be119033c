"""Incremental forms of the batch operators with Structured Streaming.

Late rows within the watermark are counted; state is bounded by the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def usage_windows(events: DataFrame, delay: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Events and value per window and kind."""
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("starts"), "event_type", "n", "value")


def first_deliveries(rows: DataFrame, key: str, at: str = "received_at", delay: str = "7 days") -> DataFrame:
    """STREAM-04: the first delivery of each key within the watermark."""
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def page_states(pages: DataFrame, cap: int = 2) -> DataFrame:
    """STREAM-03: state of each page from its attempts (page_id, ok): success stays, ``cap`` failures end it."""
    schema = "page_id string, status string, attempts int"

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, attempts = state.get if state.exists else ("pending", 0)
        for pdf in batches:
            for ok in pdf["ok"]:
                if status in ("success", "exhausted"):
                    continue  # a late result after the end is ignored
                attempts += 1
                status = "success" if ok else "exhausted" if attempts >= cap else "failed"
        state.update((status, attempts))
        yield pd.DataFrame([(key[0], status, attempts)], columns=["page_id", "status", "attempts"])

    return pages.groupBy("page_id").applyInPandasWithState(step, schema, "status string, attempts int", "update", "NoTimeout")


def _generations(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """Generations of each bucket that were written whole; none where the folder doesn't exist yet."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out: dict[int, list[int]] = {}
    if not fs.exists(root):
        return out
    for b in fs.listStatus(root):
        name = b.getPath().getName()
        if name.startswith("bucket="):
            for g in fs.listStatus(b.getPath()):
                if fs.exists(jvm.org.apache.hadoop.fs.Path(g.getPath(), "_SUCCESS")):
                    out.setdefault(int(name[7:]), []).append(int(g.getPath().getName()[11:]))
    return out


def latest_rows(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``keep_latest`` has written: the last generation of each bucket."""
    return spark.read.parquet(*(f"{path}/bucket={b}/generation={max(g)}" for b, g in sorted(_generations(spark, path).items())))


def keep_latest(path: str, key: str, order: str, buckets: int = 64):
    """STREAM-02: a ``foreachBatch`` sink that folds deliveries into the latest row of each key.

    Keys lie in buckets by their hash. A batch writes a new generation of the buckets it touches
    beside the last, so a batch that is run again after a failure gives the same table, and buckets
    without new rows aren't rewritten. Errors of reading the last generation aren't swallowed.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        from quire.operators.versions import upsert

        spark = batch.sparkSession
        rows = batch.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).persist()
        known = _generations(spark, path)
        try:
            # at most ``buckets`` numbers
            for b in sorted(r[0] for r in rows.select("_bucket").distinct().collect()):
                new, before = rows.where(F.col("_bucket") == b).drop("_bucket"), [g for g in known.get(b, []) if g < batch_id]
                if before:
                    new = spark.read.parquet(f"{path}/bucket={b}/generation={max(before)}").unionByName(new)
                upsert(new, new.limit(0), key, order).write.mode("overwrite").parquet(f"{path}/bucket={b}/generation={batch_id}")
        finally:
            rows.unpersist()

    return fold
