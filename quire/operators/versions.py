"""Versions, upserts and removals over plain tables.

Parquet has no MERGE: an upsert is a union with a latest-wins aggregate, a removal an anti-join; the
result is written as a new table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def ranked(versions: DataFrame, doc: str = "document_id", at: str = "created_at", version: str = "version_id") -> DataFrame:
    """WIN-05, SRC-08: versions in order of time, their index, and whether they are latest or previous."""
    w = W.partitionBy(doc).orderBy(F.coalesce(at, F.lit("")), version)
    n = F.count("*").over(W.partitionBy(doc))
    i = F.row_number().over(w)
    return versions.withColumn("idx", i - 1).withColumn("is_latest", i == n).withColumn("is_previous", (i == n - 1) | (n == 1))


def select_version(versions: DataFrame, prefix: str, version: str = "version_id") -> DataFrame:
    """WIN-06: the version with a unique id prefix; an ambiguous prefix gives no row."""
    hit = versions.where(F.col(version).startswith(prefix))
    return hit.withColumn("_n", F.count("*").over(W.partitionBy())).where("_n = 1").drop("_n")


def upsert(table: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """SNK-01/02: the row with the highest ``order`` of each key."""
    cols = [c for c in table.columns if c != key]
    return table.unionByName(rows).groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("r")).select(key, "r.*")


def remove(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """SNK-03/04"""
    return table.join(ids.select(key).distinct(), key, "left_anti")


def archive(table: DataFrame, key: str, ids: list, target: str) -> DataFrame:
    """SNK-16"""
    return table.withColumn("merged_into", F.when(F.col(key).isin(ids), F.lit(target)).otherwise(F.col("merged_into")))


def restore(table: DataFrame, key: str, ids: list) -> DataFrame:
    """SNK-17"""
    return table.withColumn("merged_into", F.when(F.col(key).isin(ids), F.lit(None).cast("string")).otherwise(F.col("merged_into")))


def three_way(desired: DataFrame, disk: DataFrame, previous: DataFrame) -> DataFrame:
    """SET-07, SNK-09: what an export does with each (path, hash)."""
    j = desired.withColumnRenamed("hash", "want").join(disk.withColumnRenamed("hash", "have"), "path", "full_outer").join(previous.withColumnRenamed("hash", "was"), "path", "full_outer")
    action = (
        F.when(F.col("want").isNotNull() & F.col("have").isNull(), "added")
        .when(F.col("want").isNotNull() & (F.col("want") == F.col("have")), "unchanged")
        .when(F.col("want").isNotNull() & (F.col("have") == F.col("was")), "updated")
        .when(F.col("want").isNotNull(), "conflict")
        .when(F.col("have").isNotNull() & (F.col("have") == F.col("was")), "deleted")
        .when(F.col("have").isNotNull(), "kept_user")
        .otherwise("gone")
    )
    return j.select("path", action.alias("action"))


def evict(table: DataFrame, key: str, updated: str, keep: int, spare: str | None = None) -> DataFrame:
    """SNK-29, STREAM-08: the ``keep`` rows updated last, ``spare`` among them."""
    order = [F.desc_nulls_last(updated), F.col(key)]
    if spare is not None:
        order.insert(0, F.when(F.col(key) == spare, 1).otherwise(0).desc())
    return table.orderBy(*order).limit(keep)


def next_status(pages: DataFrame, cap: int = 2) -> DataFrame:
    """PRJ-25/26, STREAM-03/07: pages to try again, exhausted ones, and interrupted work as pending."""
    status = F.when(F.col("status") == "processing", "pending").otherwise(F.col("status"))
    state = F.when(status.isin("pending", "failed") & (F.col("attempts") < cap), "retry").when((status == "failed") & (F.col("attempts") >= cap), "exhausted").otherwise("settled")
    return pages.withColumn("status", status).withColumn("state", state)
