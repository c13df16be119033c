"""Mixing of sources to target shares of the total size.

Each source gets an expected number of copies per document: its target tokens over its own tokens,
at most ``max_repeats``. What capped sources cannot give goes to the others in proportion. Copies
are drawn by systematic sampling: expected copies are summed up along the documents of the source,
one random offset a source (seeded) is added, and a document is emitted once per integer boundary that its part of the sum
crosses, so that a document comes out the expected number of times rounded down or up. Documents
are taken in order of size, so the tokens drawn follow the expectation closely. The sums run in two
levels, over buckets of size and within them, so no source goes through one task.

Defined results: null and empty texts are not drawn; spellings of a source that differ in case and
outer blanks are one source; documents without a source or of one without a target are not drawn and
are reported with a null target; targets without documents come out with share 0; a null or
negative target share is 0 and max_repeats below 0 is 0; repeated rows of one key count once; empty
tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Documents of one size and source that one task ranks, on average.
SALT_ROWS = 1_000_000


def source_name(c: str | Column) -> Column:
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


def rates(sizes: dict[str, int], shares: dict[str, float], caps: dict[str, int], total: float) -> dict[str, float]:
    """Expected copies per document of each source; full sources pass their shortfall on."""
    out: dict[str, float] = {}
    open_ = {s for s in shares if sizes.get(s, 0) > 0 and shares[s] > 0 and caps[s] > 0}
    left = float(total)
    while open_:
        weight = sum(shares[s] for s in open_)
        full = {s for s in open_ if left * shares[s] / weight >= caps[s] * sizes[s]}
        if not full:
            return out | {s: left * shares[s] / weight / sizes[s] for s in open_}
        for s in full:
            out[s] = float(caps[s])
            left -= caps[s] * sizes[s]
        open_ -= full
    return out


def largest_total(sizes: dict[str, int], shares: dict[str, float], caps: dict[str, int]) -> float:
    """Most tokens at which every source with documents reaches its share within its cap."""
    able = [caps[s] * sizes[s] / shares[s] for s in shares if sizes.get(s, 0) > 0 and shares[s] > 0]
    return min(able, default=0.0) * sum(shares[s] for s in shares if sizes.get(s, 0) > 0 and shares[s] > 0)


def offset(source: str | Column, seed: int) -> Column:
    """The random offset of a source, in [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(seed), source), F.lit(1 << 30)) / float(1 << 30)


def mix(counts: DataFrame, targets: DataFrame, total_tokens: int | str | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Drawn documents (doc_id, source, tokens, copies), and the report of the sources.

    ``counts`` has doc_id, source and tokens. The total defaults to the tokens of all documents
    whose source has a target; ``"exact"`` takes the largest total that meets all targets within the
    caps. Another ``seed`` draws other documents; over seeds, each comes out its expected number of times.
    """
    spark = counts.sparkSession
    docs = counts.dropDuplicates(["doc_id"]).select("doc_id", source_name("source").alias("source"), "tokens")
    want = targets.where(F.col("source").isNotNull()).groupBy(source_name("source").alias("source")).agg(
        F.greatest(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.greatest(F.max("max_repeats"), F.lit(0)).alias("max_repeats")
    )
    rows = want.limit(10_001).collect()  # one row a target; the number of sources is checked
    if len(rows) > 10_000:
        raise ValueError("more targets than a plan on the driver may hold")
    shares = {r[0]: float(r[1] or 0) for r in rows}
    caps = {r[0]: int(r[2] or 0) for r in rows}
    aimed = docs.join(F.broadcast(want.select("source")), "source", "left_semi")
    own = {r[0]: (r[1], r[2]) for r in aimed.groupBy("source").agg(F.sum("tokens"), F.count("*")).collect()}
    sizes = {s: n for s, (n, _) in own.items()}
    total = largest_total(sizes, shares, caps) if total_tokens == "exact" else total_tokens if total_tokens is not None else sum(sizes.values())
    e = rates(sizes, shares, caps, total)
    salts = max(32, -(-max((n for _, n in own.values()), default=0) // SALT_ROWS))
    plan = spark.createDataFrame([(s, e.get(s, 0.0)) for s in shares] or [("", 0.0)], "source string, rate double")
    drawn = aimed.join(F.broadcast(plan), "source").where("rate > 0")
    # order: size, then a hash; buckets hold one size and salt each
    keyed = drawn.withColumn("size", F.col("tokens")).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    sums = keyed.groupBy("source", "size", "salt").agg(F.count("*").alias("n"))
    level = sums.groupBy("source", "size").agg(F.sum("n").alias("m")).withColumn("below", F.sum("m").over(W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, -1)))
    before = sums.join(level.select("source", "size", "below"), ["source", "size"]).withColumn(
        "start", F.coalesce("below", F.lit(0)) + F.coalesce(F.sum("n").over(W.partitionBy("source", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    )
    ranked = keyed.withColumn("i", F.row_number().over(W.partitionBy("source", "size", "salt").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id"))).join(
        before.select("source", "size", "salt", "start"), ["source", "size", "salt"]
    )
    at = (F.col("start") + F.col("i")) * F.col("rate") + offset("source", seed) + 1e-9
    chosen = ranked.withColumn("copies", (F.floor(at) - F.floor(at - F.col("rate"))).cast("int")).where("copies > 0").select("doc_id", "source", "tokens", "copies")

    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.sum("copies").alias("n_drawn"), F.max("copies").alias("most_copies"))
    all_tokens = W.partitionBy()
    report = (
        docs.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("tokens").alias("tokens")).join(want, "source", "full_outer").join(got, "source", "left")
        .select(
            "source", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"), "target_share", "max_repeats",
            F.coalesce("n_drawn", F.lit(0)).alias("n_drawn"), F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
            (F.coalesce("mixed_tokens", F.lit(0)) / F.sum("mixed_tokens").over(all_tokens)).alias("actual_share"),
        )
    )
    return chosen, report
