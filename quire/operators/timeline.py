"""Timeline, calendar windows, digests and usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.functions import text as T
from quire.functions import values as V


def dated(docs: DataFrame, fallback: str | None = None) -> DataFrame:
    """DATE-01/02/06: (document_id, field, value, source, day, week, topics), day null where none."""
    e = docs.select("document_id", T.text("title").alias("title"), V.effective_time(fallback).alias("e"), V.ordered_distinct("topics").alias("topics"), V.ordered_distinct("tags").alias("tags"))
    day = V.day_of("e.value")
    return e.select("document_id", "title", "e.field", "e.value", "e.source", day.alias("day"), V.iso_week(day).alias("week"), "topics", "tags")


def day_groups(items: DataFrame) -> DataFrame:
    """WIN-02, WIN-04: documents per day, and the empty days before it."""
    g = items.where("day is not null").groupBy("day").agg(F.count("*").alias("n_documents"), F.min("document_id").alias("first_id"))
    gap = F.greatest(F.lit(0), F.datediff("day", F.lag("day").over(W.orderBy("day"))) - 1)
    return g.withColumn("gap_days", gap)


def week_groups(items: DataFrame) -> DataFrame:
    """WIN-03: documents per ISO week."""
    start = V.week_start("day")
    return items.where("day is not null").groupBy("week").agg(F.min(start).alias("starts"), F.max(F.date_add(start, 6)).alias("ends"), F.count("*").alias("n_documents"))


def monthly_density(items: DataFrame) -> DataFrame:
    """AGG-20: documents per month, and each month's share of the largest."""
    m = items.where("day is not null").groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.count("*").alias("n_documents"), F.min("day").alias("first_day"))
    return m.withColumn("density", F.round(F.col("n_documents") / F.max("n_documents").over(W.partitionBy()), 6))


def topic_runs(items: DataFrame) -> DataFrame:
    """WIN-01: runs of neighbouring documents of a week that share a topic."""
    w = W.partitionBy("week").orderBy("day", "value", "document_id")
    rows = items.where("day is not null").withColumn("i", F.row_number().over(w)).select("week", "document_id", "i", F.explode("topics").alias("topic"))
    n = F.row_number().over(W.partitionBy("week", "topic").orderBy("i"))
    runs = rows.withColumn("island", F.col("i") - n).groupBy("week", "topic", "island").agg(F.min("i").alias("first_index"), F.count("*").alias("length"), F.min_by("document_id", "i").alias("first_id"))
    return runs.where("length > 1").select("week", "topic", F.col("first_index").cast("int").alias("first_index"), "length", "first_id")


def topic_aggregates(items: DataFrame) -> DataFrame:
    """AGG-19: documents per week and topic."""
    return items.where("day is not null").select("week", "document_id", F.explode("topics").alias("topic")).groupBy("week", "topic").agg(F.countDistinct("document_id").alias("n_documents"))


def in_range(items: DataFrame, first: str, last: str) -> DataFrame:
    """DATE-05: documents of an inclusive range of days."""
    return items.where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def budget(items: DataFrame, max_docs: int = 60, floor: int = 2) -> DataFrame:
    """WIN-09: the newest ``max_docs`` documents, with the newest ``floor`` of each label guaranteed.

    Guaranteed documents take the places of the oldest others. All ranks are windows over labels or
    top-k selections, so only ``max_docs`` rows and the guaranteed ones meet in one place.
    """
    rows = items.where("day is not null").select("document_id", "day", F.array_sort(F.array_union("topics", "tags")).alias("labels"))
    newest = rows.orderBy(F.desc("day"), F.desc("document_id")).limit(max_docs)
    by_label = rows.select("document_id", "day", F.explode("labels").alias("label"))
    w = W.partitionBy("label").orderBy(F.desc("day"), F.desc("document_id"))
    promised = by_label.withColumn("n", F.row_number().over(w)).where(F.col("n") <= floor).select("document_id", "day").distinct()
    promised = promised.orderBy(F.desc("day"), F.desc("document_id")).limit(max_docs).withColumn("promised", F.lit(True))
    both = newest.select("document_id", "day").join(promised.select("document_id", "promised"), "document_id", "left").unionByName(promised.select("document_id", "day", "promised")).groupBy("document_id", "day").agg(F.max("promised").alias("promised"))
    ranked = both.orderBy(F.desc_nulls_last("promised"), F.desc("day"), F.desc("document_id")).limit(max_docs)
    return ranked.select("document_id", "day", F.coalesce("promised", F.lit(False)).alias("guaranteed"))


def usage_events(events: DataFrame) -> DataFrame:
    """AGG-07: telemetry rows from events: model, cached flag, tokens and cost.

    Prompt tokens come from the properties, output tokens from the value; negatives count as null.
    """
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events.select(
        "event_id", "ts", "user_id", F.col("event_type").alias("model"), (F.col("event_id") % 10 == 0).alias("cached"),
        F.when(k >= 0, k).alias("prompt_tokens"), F.when(F.col("value") >= 0, F.floor("value")).cast("bigint").alias("output_tokens"),
    )


def usage_by(events: DataFrame, bucket: str) -> DataFrame:
    """AGG-04..06: null-aware sums by day or month and model; cached events bring no usage."""
    fmt = {"day": "yyyy-MM-dd", "month": "yyyy-MM"}[bucket]
    own = F.when(~F.col("cached"), F.lit(1))
    return events.groupBy(F.date_format("ts", fmt).alias("bucket"), "model").agg(
        F.count("*").alias("n_events"), F.count_if("cached").alias("n_cached"),
        F.sum(own * F.col("prompt_tokens")).alias("prompt_tokens"), F.sum(own * F.col("output_tokens")).alias("output_tokens"),
    )


def costs(events: DataFrame, prices: DataFrame) -> DataFrame:
    """AGG-05: cost per model at prices per million, and why it is missing."""
    e = events.join(prices, "model", "left")
    cost = (F.col("prompt_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price")) / 1_000_000
    status = F.when(F.col("cached"), "cached").when(F.col("input_price").isNull(), "no_price_config").when(F.col("prompt_tokens").isNull() | F.col("output_tokens").isNull(), "usage_unavailable").otherwise("priced")
    rows = e.select("model", status.alias("cost_status"), F.when(status == "priced", cost).when(status == "cached", F.lit(0.0)).alias("cost"))
    return rows.groupBy("model", "cost_status").agg(F.count("*").alias("n_events"), F.round(F.sum("cost"), 4).alias("cost"))


def sessions(events: DataFrame, keep: int = 20) -> DataFrame:
    """AGG-23, WIN-11/12: per user the last ``keep`` events: number, tokens, last model."""
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    last = events.withColumn("n", F.row_number().over(w)).where(F.col("n") <= keep)
    return last.groupBy("user_id").agg(F.count("*").alias("n_turns"), F.sum("output_tokens").alias("output_tokens"), F.min_by("model", "n").alias("last_model"))
