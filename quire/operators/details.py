"""Smaller views with their own semantics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.functions import text as T
from quire.functions import values as V

# Words by which a snippet addresses the model that reads it.
ORDERS = (
    r"(?i)ignore\s+(?:all\s+|the\s+)?(?:previous|above|prior)\s+instructions|disregard\s+(?:all\s+|the\s+)?(?:previous|above|prior)|忽略(?:以上|前面|上述|之前).{0,8}(?:指令|提示|要求)"
    r"|你现在是|你现在扮演|new\s+instructions\s*:|(?:^|\n)\s*(?:system|assistant|developer)\s*:"
)


def pending_material(docs: DataFrame) -> DataFrame:
    """PRJ-09, PRJ-10: documents with text that wait for topics or tags."""
    bare = (F.size(V.ordered_distinct("topics")) == 0) & (F.size(V.ordered_distinct("tags")) == 0)
    untagged = F.size(V.ordered_distinct("tags")) == 0
    has_text = T.stripped(T.text("current_markdown")) != ""
    return docs.select("document_id", bare.alias("pending"), (untagged & has_text).alias("to_tag"), (T.visible_chars("current_markdown") >= 60).alias("text_page")).where("pending or to_tag")


def injections(rows: DataFrame, key: str, body: str) -> DataFrame:
    """PRJ-16: keys of texts that give orders to a reading model."""
    return rows.where(T.text(body).rlike(ORDERS)).select(key)


def heading_like(lines: DataFrame, c: str) -> DataFrame:
    """PRJ-21: lines of at most 120 characters that aren't sentences."""
    t = T.stripped(c)
    return lines.where((F.length(t) > 0) & (F.length(t) <= 120) & ~t.rlike(r"[.!?;。！？；]$"))


def missing_targets(docs: DataFrame, files: DataFrame) -> DataFrame:
    """JOIN-26, JOIN-27: relative targets of links without a file (path)."""
    t = docs.select("document_id", F.explode(T.reference_targets("current_markdown")).alias("path")).where(~F.col("path").rlike(r"^(?:[a-z]+:|#|/)"))
    return t.distinct().join(files.select("path").distinct(), "path", "left_anti").select("document_id", "path")


def within_hash(hashes: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """JOIN-11, JOIN-12: (query, key, distance, similarity) of hashes within a distance of each query's; exact.

    The distances are too wide for equal segments, so every query meets every row; Spark broadcasts
    the queries where they are small.
    """
    q = queries.select(F.col("key").alias("query"), F.col("hi").alias("qh"), F.col("lo").alias("ql"))
    d = V.hamming(F.col("hi"), F.col("lo"), F.col("qh"), F.col("ql"))
    rows = hashes.crossJoin(q).where(F.col("key") != F.col("query")).select("query", "key", d.alias("distance"))
    return rows.where(F.col("distance") <= most).select("query", "key", "distance", F.round(V.hash_similarity("distance"), 4).alias("similarity"))


def evidence(pairs: DataFrame) -> DataFrame:
    """AGG-21: for each document the sorted labels of its pairs (a, b, label)."""
    return pairs.select(F.explode(F.array("a", "b")).alias("document_id"), "label").groupBy("document_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def repeated_pages(docs: DataFrame) -> DataFrame:
    """AGG-33: page numbers that occur more than once in a file."""
    return docs.where("page_number is not null and length(pdf_id) > 0").groupBy("pdf_id", "page_number").agg(F.count("*").alias("n_documents")).where("n_documents > 1")


def effective_collections(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """ARR-04: collections by hand, then known automatic ones, then those of the topics."""
    rows = docs.select("document_id", V.ordered_distinct("manual_collections").alias("m"), V.ordered_distinct("auto_collections").alias("a"), V.ordered_distinct("topics").alias("t"))
    ids, topics = registry.select(F.col("collection_id").alias("c")), registry.where("topic is not null").select("topic", F.col("collection_id").alias("c"))
    manual = rows.select("document_id", F.lit(0).alias("k"), F.posexplode("m").alias("i", "c"))
    auto = rows.select("document_id", F.lit(1).alias("k"), F.posexplode("a").alias("i", "c")).join(ids, "c", "left_semi").select("document_id", "k", "i", "c")
    by_topic = rows.select("document_id", F.lit(2).alias("k"), F.posexplode("t").alias("i", "topic")).join(topics, "topic").select("document_id", "k", "i", "c")
    first = manual.unionByName(auto).unionByName(by_topic).groupBy("document_id", "c").agg(F.min(F.struct("k", "i")).alias("at"))
    return first.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "c"))), lambda x: x["c"]).alias("collections"))


def backfill(docs: DataFrame) -> DataFrame:
    """DATE-16: import time from the creation date where the slot is empty."""
    had = V.slot_value("import_time")
    return docs.select("document_id", F.coalesce(had, "created_at").alias("import_time"), had.isNull().alias("filled"))


def pdf_name(source: str = "source_pdf", pdf: str = "pdf_id") -> Column:
    """STR-61, JOIN-25: a file's name without its folders, else its id."""
    return F.coalesce(F.when(F.length(source) > 0, F.element_at(F.split(source, "/"), -1)), F.col(pdf))


def batch_hint(c: Column) -> Column:
    """STR-60: batch and ordinal in a name such as scan_3_12.pdf, null without."""
    b = F.regexp_extract(c, r"^(.*?)_(\d+)(?:_(\d+))?\.[A-Za-z]+$", 1)
    n = F.regexp_extract(c, r"^(.*?)_(\d+)(?:_(\d+))?\.[A-Za-z]+$", 2)
    return F.when(b != "", F.struct(b.alias("batch"), n.cast("int").alias("ordinal")))


def source_identity(docs: DataFrame) -> DataFrame:
    """SUP-09..11: source key, position from 0 and label from 1."""
    key = F.coalesce(*(F.when(F.length(F.trim(c)) > 0, F.trim(c)) for c in ("pdf_id", "source_pdf")))
    pos = F.coalesce("page_index", F.col("page_number") - 1)
    return docs.select("document_id", key.alias("source_key"), pos.alias("position"), F.coalesce("page_number", pos + 1).alias("label"))


def reference_fields(refs: DataFrame) -> DataFrame:
    """STR-46: leading mark, DOI and quoted title of bibliography lines."""
    t = T.text("raw")
    quoted = F.regexp_extract(t, "[“\"]([^”\"]{8,}?),?[”\"]", 1)
    return refs.select("ref_id", F.regexp_extract(t, r"^\s*(\[\w+\]|\d{1,3}\.)\s", 1).alias("mark"), F.regexp_extract(t, r"(10\.\d{4,9}/[^\s,;]+)", 1).alias("doi"), quoted.alias("quoted_title"))


def vocabulary_lines(counts: DataFrame, k: int = 400) -> DataFrame:
    """SUP-69, SUP-95: the first k tags by falling count and name."""
    return counts.orderBy(F.desc("n_documents"), F.lower("tag"), "tag").limit(k)


def union_per_group(docs: DataFrame, group: str, column: str) -> DataFrame:
    """SET-05: sorted union of the labels of a group's documents."""
    return docs.where(F.col(group).isNotNull()).select(group, F.explode(V.ordered_distinct(column)).alias("x")).groupBy(group).agg(F.array_sort(F.collect_set("x")).alias("labels"))


def medians(rows: DataFrame, group: str, value: Column) -> DataFrame:
    """MATH-13: number, mean and true median per group."""
    return rows.select(group, value.alias("v")).where("v is not null").groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg("v"), 4).alias("mean"), F.median("v").alias("median"))


def last_rows(rows: DataFrame, order: str, key: str, keep: int) -> DataFrame:
    """SNK-13: the last rows of a log."""
    return rows.orderBy(F.desc_nulls_last(order), key).limit(keep)


def latest_of_cluster(labels: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    """WIN-07: the latest row of each cluster."""
    w = W.partitionBy("cluster").orderBy(F.desc(order), "key")
    return labels.join(rows, "key").withColumn("n", F.row_number().over(w)).where("n = 1").select("cluster", "key")
