"""Packing of texts into containers of fixed capacity.

Items are placed by best fit in falling size: the open containers are kept in order of what is left
in them, and the search starts at the first that can hold the item and goes on to its successors
until one is compatible. A container carries bitmaps of the sources and of the duplicate clusters in
it; two copies of one text never share a container, and between equally tight containers one that
lacks the item's source is taken. Items above the capacity are divided; their full pieces are
containers of their own and only the rest is packed. No other item is divided.

Items are spread over independent shards of about ``shard_tokens`` tokens, each packed in one task;
at most one container a shard is poorly filled for that. Defined results: null and empty texts have
no container; repeated rows of one key count once; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.mixing import source_name

CAPACITY = 2048
SHARD_TOKENS = 1_000_000


def best_fit(items: list[tuple[int, int, str]], capacity: int) -> tuple[list[int], list[int]]:
    """Container of each (size, cluster, source), in order of the items; and sizes used.

    Items must come in falling size for the packing to be tight.
    """
    twice = Counter(c for _, c, _ in items)
    cluster_bit = {c: 1 << i for i, c in enumerate(c for c, n in twice.items() if n > 1)}
    source_bit: dict[str, int] = {}
    left: list[tuple[int, int]] = []  # (what is left, container), in order
    clusters: list[int] = []
    sources: list[int] = []
    used: list[int] = []
    where = []
    for size, cluster, source in items:
        cb = cluster_bit.get(cluster, 0)
        sb = source_bit.setdefault(source, 1 << len(source_bit))
        k = bisect_left(left, (size, -1))
        pick = None
        while k < len(left):
            room, bin_ = left[k]
            if pick is not None and room > left[pick][0]:
                break
            if not clusters[bin_] & cb:
                if not sources[bin_] & sb:
                    pick = k
                    break
                if pick is None:
                    pick = k
            k += 1
        if pick is None:
            bin_ = len(used)
            used.append(0)
            clusters.append(0)
            sources.append(0)
            room = capacity
        else:
            room, bin_ = left.pop(pick)
        used[bin_] += size
        clusters[bin_] |= cb
        sources[bin_] |= sb
        if room > size:
            insort(left, (room - size, bin_))
        where.append(bin_)
    return where, used


def pack(counts: DataFrame, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(container, doc_id, piece, first_token, tokens) of items (doc_id, source, cluster, tokens)."""
    total = counts.agg(F.sum("tokens")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    items = counts.dropDuplicates(["doc_id"]).withColumn("full", F.floor(F.col("tokens") / capacity).cast("int"))
    whole = (
        items.where(F.col("tokens") > capacity)
        .select("doc_id", F.posexplode(F.sequence(F.lit(1), F.col("full"))).alias("piece", "_one"))
        .select(
            F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("container"),
            "doc_id", "piece", (F.col("piece") * capacity).alias("first_token"), F.lit(capacity).alias("tokens"),
        )
    )
    rest = items.select(
        "doc_id", F.coalesce(source_name("source"), F.lit("")).alias("source"), "cluster", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"),
        F.when(F.col("tokens") > capacity, F.col("full")).otherwise(0).alias("piece"),
        F.when(F.col("tokens") > capacity, F.col("tokens") - F.col("full") * capacity).otherwise(F.col("tokens")).cast("int").alias("tokens"),
    ).where("tokens > 0")

    def fill(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id"], ascending=[False, True], kind="stable")
        where, _ = best_fit(list(zip(pdf["tokens"].tolist(), pdf["cluster"].tolist(), pdf["source"].tolist())), capacity)
        return pd.DataFrame({
            "container": [f"s{key[0]}-{b}" for b in where], "doc_id": pdf["doc_id"].to_numpy(), "piece": pdf["piece"].to_numpy(),
            "first_token": pdf["piece"].to_numpy() * capacity, "tokens": pdf["tokens"].to_numpy(),
        })

    schema = "container string, doc_id long, piece int, first_token int, tokens int"
    return rest.groupBy("shard").applyInPandas(fill, schema).unionByName(whole)


def containers(assigned: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per container: pieces, tokens and tokens unused."""
    return assigned.groupBy("container").agg(F.count("*").alias("n_pieces"), F.sum("tokens").alias("tokens")).withColumn("unused", F.lit(capacity) - F.col("tokens"))


def summary(assigned: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Number of containers, tokens, and the share of the space that is unused."""
    return containers(assigned, capacity).agg(
        F.count("*").alias("n_containers"), F.sum("n_pieces").alias("n_pieces"), F.sum("tokens").alias("tokens"),
        (F.sum("unused") / (F.count("*") * capacity)).alias("unused_share"), F.ceil(F.sum("tokens") / capacity).alias("least_containers"),
    )
