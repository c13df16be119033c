"""Readers and writers: explicit schemas, no inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLOT = "struct<value string, source string, confidence string, evidence string, manual boolean>"
RECORD = (
    "document_id string, title string, doc_kind string, created_at string, updated_at string, current_markdown string, topics array<string>, tags array<string>, "
    "collections array<string>, manual_collections array<string>, auto_collections array<string>, collection_names map<string,string>, "
    "manual_relations array<struct<target string, source string>>, pdf_id string, source_pdf string, page_index int, page_number int, merged_into string, device_id string, "
    f"metadata struct<document_time {SLOT}, capture_time {SLOT}, import_time {SLOT}>, received_at timestamp"
)


def records(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Record files as a table; malformed lines are dropped."""
    reader = spark.read.schema(RECORD)
    return reader.option("mode", "DROPMALFORMED").json(path) if fmt == "json" else reader.format(fmt).load(path)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """SRC-15: (name, text) of text files."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("text"))


def evaluation_samples(spark: SparkSession, path: str, categories: tuple[str, ...]) -> DataFrame:
    """SRC-14: samples of a metadata file; an unknown category is an error."""
    rows = spark.read.option("multiLine", True).schema("samples array<struct<id string, category string, image string, gold string>>").json(path).select(F.inline("samples"))
    return rows.withColumn("category", F.when(F.col("category").isin(*categories), F.col("category")).otherwise(F.raise_error(F.concat(F.lit("unknown category: "), F.coalesce("category", F.lit("null"))))))


def write_index(postings: DataFrame, path: str, fingerprint: str, buckets: int = 64) -> None:
    """SNK-05: postings in buckets by token, so that a query reads the buckets of its tokens."""
    rows = postings.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")).withColumn("fingerprint", F.lit(fingerprint))
    rows.repartition("bucket").sortWithinPartitions("token").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_index(spark: SparkSession, path: str, fingerprint: str) -> DataFrame | None:
    """SRC-22, STREAM-01: the stored postings, or None where they are missing or of another state."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        return None
    rows = spark.read.parquet(path)
    head = rows.select("fingerprint").first()
    return rows.drop("fingerprint", "bucket") if head and head[0] == fingerprint else None


def write_bounded(rows: DataFrame, path: str, order: str, keep: int = 200) -> None:
    """SNK-13: a log that keeps its last rows."""
    rows.orderBy(F.desc(order)).limit(keep).coalesce(1).write.mode("overwrite").json(path)
