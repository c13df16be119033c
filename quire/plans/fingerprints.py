"""Fingerprints of table states, and reuse by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def library_fingerprint(docs: DataFrame, part: Column) -> DataFrame:
    """One row: 24 hex digits over all rows' parts, whatever their order.

    Parts are folded to their number, the sum and the exclusive or of their hashes, in partial
    aggregates of a fixed size. An empty table has the fingerprint of nothing.
    """
    h = docs.select(F.sha2(part, 256).alias("h"))
    half = lambda at: F.conv(F.substring("h", at, 15), 16, 10).cast("bigint")
    folded = h.agg(F.count("*").alias("n"), F.sum(half(1).cast("decimal(38,0)")).alias("s"), F.bit_xor(half(16)).alias("x"))
    text = F.concat_ws("|", F.col("n").cast("string"), F.coalesce(F.col("s").cast("string"), F.lit("0")), F.coalesce(F.col("x").cast("string"), F.lit("0")))
    return folded.select(F.substring(F.sha2(text, 256), 1, 24).alias("fingerprint"))
