"""Keyword search over an inverted index.

Postings are a table, so a search is a join with the few query tokens; the tokens of a query are
bounded and broadcast. Documents with null text have no postings; null titles count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.functions import text as T

MAX_LIMIT = 200


def postings(docs: DataFrame, key: str = "key", body: str = "body", title: str = "title") -> DataFrame:
    """(token, key, weight): 1 for each place in the body, 2 for each in the title."""
    both = F.concat(
        F.transform(T.search_tokens(body), lambda x: F.struct(x.alias("token"), F.lit(1).alias("w"))),
        F.transform(T.search_tokens(title), lambda x: F.struct(x.alias("token"), F.lit(2).alias("w"))),
    )
    return docs.select(F.col(key).alias("key"), F.explode(both).alias("p")).groupBy(F.col("p.token").alias("token"), "key").agg(F.sum("p.w").alias("weight"))


def lengths(docs: DataFrame, key: str = "key", body: str = "body", title: str = "title") -> DataFrame:
    """(key, length): weighted number of tokens."""
    return docs.select(F.col(key).alias("key"), (F.size(T.search_tokens(body)) + 2 * F.size(T.search_tokens(title))).alias("length"))


def query_tokens(docs: DataFrame, query: str) -> DataFrame:
    row = docs.sparkSession.range(1).select(F.explode(F.array_distinct(T.search_tokens(F.lit(query)))).alias("token"))
    return row


def match(index: DataFrame, query: str, how: str = "all") -> DataFrame:
    """(key, score) of the documents with all (or any) tokens of the query; no tokens, no rows."""
    tokens = query_tokens(index, query)
    hits = index.join(F.broadcast(tokens), "token").groupBy("key").agg(F.sum("weight").alias("score"), F.count("*").alias("n"))
    if how == "all":
        hits = hits.join(F.broadcast(tokens.agg(F.count("*").alias("want"))), F.col("n") == F.col("want"), "left_semi")
    return hits.select("key", "score")


def top(hits: DataFrame, *ties: str, limit: int | None = 50) -> DataFrame:
    """Best hits first; the limit is clamped to 1 .. 200."""
    n = max(1, min(int(limit or 50), MAX_LIMIT))
    return hits.orderBy(F.desc("score"), *ties).limit(n)


def fresh(hits: DataFrame, live: DataFrame) -> DataFrame:
    """JOIN-04: hits whose indexed hash equals the live one."""
    return hits.join(live.select("key", "content_hash"), ["key", "content_hash"], "left_semi")


def best_per_page(hits: DataFrame) -> DataFrame:
    """WIN-10: one hit per page, the first of equal scores."""
    w = W.partitionBy("pdf_id", "page_index").orderBy(F.desc("score"), "key")
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
