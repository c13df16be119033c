"""Queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import abuse, canonical, denoise, linkage, mixing, neardup, packing, split, tokens
from quire.session import cut, load


def p1_found(s: SparkSession, d: str) -> DataFrame:
    return split.found(load(s, d, "jobs"), load(s, d, "papers"), load(s, d, "split_limits"))


def p1_pieces(s: SparkSession, d: str) -> DataFrame:
    items = split.library_items(load(s, d, "jobs"), load(s, d, "papers")).dropDuplicates(["item_kind", "item_id"])
    return split.split(items, load(s, d, "split_limits"), with_text=False)


def _canonical(s: SparkSession, d: str) -> DataFrame:
    occurrences = canonical.tag_occurrences(load(s, d, "tag_inferences"), load(s, d, "tag_merges"))
    return canonical.canonicalise(occurrences, "value", canonical.reference_entries(load(s, d, "tag_vocabulary")))


def p2_found(s: SparkSession, d: str) -> DataFrame:
    rows = _canonical(s, d).where((F.col("canonical_cost").isNull()) | (F.col("value") != F.col("canonical")))
    return rows.select("field_name", "record_id", "pos", F.col("canonical").alias("tag")).distinct()


def p2_unmatched(s: SparkSession, d: str) -> DataFrame:
    rows = _canonical(s, d).where(F.col("canonical") == canonical.NONE)
    return rows.groupBy("value").agg(F.count("*").alias("n"))


def p3_found(s: SparkSession, d: str) -> DataFrame:
    return linkage.found(load(s, d, "resolved_refs"), load(s, d, "library_entries"))


def p3_links(s: SparkSession, d: str) -> DataFrame:
    return linkage.link(load(s, d, "resolved_refs"), load(s, d, "library_entries"))


def p4_found(s: SparkSession, d: str) -> DataFrame:
    return denoise.found(load(s, d, "jobs"), load(s, d, "qa_sources"), load(s, d, "papers"))


def p4_repaired(s: SparkSession, d: str) -> DataFrame:
    return denoise.repair(denoise.library_texts(load(s, d, "jobs"), load(s, d, "qa_sources"), load(s, d, "papers")))


def p5_found(s: SparkSession, d: str) -> DataFrame:
    pairs = neardup.found_pairs(load(s, d, "jobs"), "job_id", "markdown")
    return pairs.select(F.col("a").alias("job_id_a"), F.col("b").alias("job_id_b"))


def p5_classes(s: SparkSession, d: str) -> DataFrame:
    return neardup.classes(load(s, d, "jobs"), "job_id", "markdown")


def p5_documents(s: SparkSession, d: str) -> DataFrame:
    return neardup.classes(load(s, d, "documents"), "doc_id", "text", size=5, threshold=(4, 5), min_chars=1)


def _packed(s: SparkSession, d: str) -> DataFrame:
    return packing.pack(cut(tokens.token_counts(load(s, d, "documents"))))


def p7_assignments(s: SparkSession, d: str) -> DataFrame:
    return _packed(s, d)


def p7_containers(s: SparkSession, d: str) -> DataFrame:
    return packing.containers(_packed(s, d))


def p7_summary(s: SparkSession, d: str) -> DataFrame:
    return packing.summary(_packed(s, d))


def p8_mixture(s: SparkSession, d: str) -> DataFrame:
    return mixing.mix(cut(tokens.token_counts(load(s, d, "documents"))), load(s, d, "mix_targets"))[0]


def p8_shares(s: SparkSession, d: str) -> DataFrame:
    return mixing.mix(cut(tokens.token_counts(load(s, d, "documents"))), load(s, d, "mix_targets"))[1]


def p9_found(s: SparkSession, d: str) -> DataFrame:
    return abuse.found(load(s, d, "documents"), load(s, d, "review_labels"))


def p9_scores(s: SparkSession, d: str) -> DataFrame:
    return abuse.score(load(s, d, "documents"), load(s, d, "review_labels"))


def p9_rates(s: SparkSession, d: str) -> DataFrame:
    return abuse.rates(abuse.score(load(s, d, "documents"), load(s, d, "review_labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_pieces, p2_found, p2_unmatched, p3_found, p3_links, p4_found, p4_repaired, p5_found, p5_classes, p5_documents,
        p7_assignments, p7_containers, p7_summary, p8_mixture, p8_shares, p9_found, p9_scores, p9_rates,
    )
}

SQL: dict[str, str] = {
    "p1_found": """
        SELECT DISTINCT 'job' AS item_kind, job_id AS item_id FROM jobs
        WHERE length(markdown) > (SELECT max_chars FROM split_limits WHERE item_kind = 'job')
        UNION
        SELECT DISTINCT 'paper', document_id FROM papers
        WHERE length(full_text) > (SELECT max_chars FROM split_limits WHERE item_kind = 'paper')
    """,
}
