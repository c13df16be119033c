"""Library scans, facets, inbox and governance views.

All take the raw records, one row per delivery; ``live`` reduces them to the latest row of each
document. Null arrays count as empty; blank labels are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.functions import text as T
from quire.functions import values as V


def current(records: DataFrame, key: str = "document_id", columns: tuple[str, ...] | None = None) -> DataFrame:
    """SNK-01, STREAM-02: the latest delivery of each document.

    Every column is an aggregate of its own over the same order, so that columns nobody reads are
    pruned before the shuffle. Deliveries at one time are copies.
    """
    cols = columns or tuple(c for c in records.columns if c != key)
    return records.groupBy(key).agg(*(F.max_by(c, "received_at").alias(c) for c in cols))


def archived(c: str = "merged_into") -> Column:
    """PRJ-08"""
    return F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0


def live(records: DataFrame) -> DataFrame:
    """SRC-01: documents that weren't merged into another."""
    return current(records).where(~archived())


def card(docs: DataFrame) -> DataFrame:
    """PRJ-02, PRJ-20: what a list of documents shows."""
    kind = F.when((F.length("source_pdf") > 0) | (F.length("pdf_id") > 0), "pdf").otherwise("document")
    name = F.when(F.length("source_pdf") > 0, F.element_at(F.split("source_pdf", "/"), -1))
    label = F.when(kind == "pdf", F.concat_ws(" p.", F.coalesce(name, F.col("pdf_id")), F.coalesce(F.col("page_number"), F.col("page_index") + 1).cast("string")))
    return docs.select(
        "document_id",
        F.coalesce(F.when(F.length(F.trim("title")) > 0, F.trim("title")), F.when(T.headline("current_markdown") != "", T.headline("current_markdown")), F.col("document_id")).alias("headline"),
        kind.alias("source_kind"), label.alias("source_label"), V.ordered_distinct("tags").alias("tags"),
    )


def faceted(docs: DataFrame, collection: str | None = None, tag: str | None = None, topic: str | None = None) -> DataFrame:
    """PRJ-01: documents with all the given memberships."""
    for column, value in (("collections", collection), ("tags", tag), ("topics", topic)):
        if value is not None:
            docs = docs.where(F.array_contains(F.coalesce(F.col(column), F.array().cast("array<string>")), value))
    return docs


def reasons() -> Column:
    """PRJ-03: why a document waits in the inbox, in order."""
    low = F.exists(
        F.array(*(F.lower(F.col(f"metadata.{s}.confidence")) for s in V.SLOTS)), lambda x: x.isin("low", "低", "degraded", "needs_review", "待复核")
    )
    return F.filter(
        F.array(
            F.when(F.size(V.ordered_distinct("topics")) == 0, "no_topic"),
            F.when(F.size(V.ordered_distinct("tags")) == 0, "no_tag"),
            F.when(low, "low_confidence"),
        ),
        lambda x: x.isNotNull(),
    )


def inbox(docs: DataFrame) -> DataFrame:
    """PRJ-04, PRJ-05: documents with any reason."""
    return docs.select("document_id", T.text("title").alias("title"), reasons().alias("reasons")).where(F.size("reasons") > 0)


def reason_histogram(docs: DataFrame) -> DataFrame:
    """AGG-09: documents by reason."""
    return inbox(docs).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n_documents"))


def facet_counts(docs: DataFrame, column: str, name: str) -> DataFrame:
    """AGG-17, AGG-18: documents per label."""
    return docs.select(F.explode(V.ordered_distinct(column)).alias(name)).groupBy(name).agg(F.count("*").alias("n_documents"))


def vocabulary_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """AGG-12, STR-06: documents per vocabulary tag, resolved by key and alias; zeros are kept."""
    names = vocabulary.select("tag", F.explode(F.concat(F.array("tag"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    keys = names.select("tag", T.tag_key("name").alias("k")).where("k is not null").groupBy("k").agg(F.min("tag").alias("tag"))
    used = docs.select("document_id", F.explode(V.ordered_distinct("tags")).alias("t")).select("document_id", T.tag_key("t").alias("k"))
    n = used.join(keys, "k").select("document_id", "tag").distinct().groupBy("tag").agg(F.count("*").alias("n"))
    return vocabulary.select("tag", F.array_sort("aliases").alias("aliases")).join(n, "tag", "left").select("tag", "aliases", F.coalesce("n", F.lit(0)).alias("n_documents"))


def first_topic(docs: DataFrame) -> DataFrame:
    """AGG-16: every document in the bucket of its first topic, else unclustered."""
    b = F.coalesce(F.try_element_at(V.ordered_distinct("topics"), F.lit(1)), F.lit("(unclustered)"))
    return docs.groupBy(b.alias("bucket")).agg(F.count("*").alias("n_documents"), F.min("document_id").alias("first_id"))


def collection_counts(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """AGG-14: documents per registered collection; empty ones are kept."""
    n = docs.select(F.explode(V.ordered_distinct("collections")).alias("collection_id")).groupBy("collection_id").agg(F.count("*").alias("n"))
    return registry.join(n, "collection_id", "left").select("collection_id", "collection_name", T.slug("collection_name").alias("slug"), F.coalesce("n", F.lit(0)).alias("n_documents"))


def merge_tags(docs: DataFrame, merges: DataFrame) -> DataFrame:
    """ARR-07, ARR-19, SORT-09: tags replaced along chains of merges, repeats dropped.

    ``merges`` (source, target) is folded to final targets first, so a chain lands on its end
    whatever the order; a source with several targets takes the smallest; on a cycle every member
    goes to its smallest name.
    """
    m = merges.where((F.length(F.trim("source")) > 0) & (F.length(F.trim("target")) > 0) & (F.col("source") != F.col("target"))).groupBy("source").agg(F.min("target").alias("target"))
    final = resolve_chains(m)
    used = docs.select("document_id", F.posexplode(V.ordered_distinct("tags")).alias("pos", "tag"))
    new = used.join(final, used.tag == final.source, "left").select("document_id", "pos", F.coalesce("target", "tag").alias("tag"))
    return new.groupBy("document_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag"))), lambda x: x["tag"])).alias("tags"))


def resolve_chains(merges: DataFrame) -> DataFrame:
    """(source, target) with chains followed to their ends by doubling; a cycle ends at its smallest name.

    After as many doublings as it takes to cover all rows, a target that still moves lies on a cycle,
    and the smallest name it has passed since is the smallest of that cycle.
    """
    from quire.session import cut

    m = cut(merges.select("source", "target", F.col("source").alias("low")))
    reach, rows = 1, m.count()
    while reach <= rows:
        nxt = m.select(F.col("source").alias("s2"), F.col("target").alias("t2"), F.col("low").alias("l2"))
        joined = m.join(nxt, m.target == nxt.s2, "left")
        m = cut(joined.select("source", F.coalesce("t2", "target").alias("target"), F.least("low", F.coalesce("l2", "low")).alias("low"), F.col("t2").isNotNull().alias("moved")))
        reach *= 2
        if not m.where("moved").limit(1).count():
            break
        m = m.drop("moved")
    ring = m.select(F.col("source").alias("s2"), F.col("low").alias("l2"))
    return m.join(ring, m.target == ring.s2, "left").select("source", F.coalesce("l2", "target").alias("target"))


def merge_plan_errors(merges: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """ARR-18, SUP-66: broken rules of a merge plan."""
    known = vocabulary.select("tag")
    rows = merges.select("suggestion_id", "source", "target")
    unknown = rows.join(known.withColumnRenamed("tag", "source"), "source", "left_anti").select("suggestion_id", F.lit("unknown_source").alias("error"))
    lost = rows.join(known.withColumnRenamed("tag", "target"), "target", "left_anti").select("suggestion_id", F.lit("unknown_target").alias("error"))
    selfs = rows.where("source = target").select("suggestion_id", F.lit("self_merge").alias("error"))
    twice = rows.withColumn("n", F.count("*").over(W.partitionBy("source"))).where("n > 1").select("suggestion_id", F.lit("duplicate_source").alias("error"))
    back = rows.alias("x").join(rows.select(F.col("target").alias("source"), F.col("source").alias("target")).distinct(), ["source", "target"], "left_semi").where("source <> target").select("suggestion_id", F.lit("cycle").alias("error"))
    return unknown.unionByName(lost).unionByName(selfs).unionByName(twice).unionByName(back)


def tag_groups(vocabulary: DataFrame) -> DataFrame:
    """ARR-20: groups and their tags, and those of none."""
    return vocabulary.groupBy(F.coalesce("tag_group", F.lit("(ungrouped)")).alias("tag_group")).agg(F.array_sort(F.collect_set("tag")).alias("tags"), F.count("*").alias("n_tags"))


def relations(docs: DataFrame) -> DataFrame:
    """ARR-05, AGG-40: distinct pairs related by hand, without loops."""
    r = docs.select("document_id", F.explode("manual_relations").alias("r")).where((F.col("r.source") == "manual") | F.col("r.source").isNull())
    r = r.select("document_id", F.trim("r.target").alias("target")).where((F.length("target") > 0) & (F.col("target") != F.col("document_id")))
    return r.select(F.least("document_id", "target").alias("a"), F.greatest("document_id", "target").alias("b")).distinct()


def graph_edges(docs: DataFrame) -> DataFrame:
    """ARR-06: edges of documents to their topics, tags and collections, and to each other."""
    ids = docs.select("document_id")
    parts = [
        docs.select("document_id", F.explode(V.ordered_distinct(col)).alias("label"))
        .select(F.lit(kind).alias("kind"), F.concat(F.lit("document:"), "document_id").alias("from_id"), F.concat(F.lit(kind + ":"), "label").alias("to_id"))
        for kind, col in (("topic", "topics"), ("tag", "tags"), ("collection", "collections"))
    ]
    rel = relations(docs)
    rel = rel.join(ids, rel.a == ids.document_id, "left_semi").join(ids.withColumnRenamed("document_id", "b"), "b", "left_semi")
    parts.append(rel.select(F.lit("manual").alias("kind"), F.concat(F.lit("document:"), "a").alias("from_id"), F.concat(F.lit("document:"), "b").alias("to_id")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def degrees(edges: DataFrame) -> DataFrame:
    """AGG-15: degree of each node over both ends."""
    return edges.select(F.explode(F.array("from_id", "to_id")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))


def collection_remap(docs: DataFrame, source: str, target: str) -> DataFrame:
    """SNK-19: a collection renamed in every record."""
    swap = lambda c: F.array_distinct(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.when(x == source, F.lit(target)).otherwise(x)))
    return docs.select("document_id", swap("manual_collections").alias("manual_collections"), swap("auto_collections").alias("auto_collections"))


def missing_pages(docs: DataFrame) -> DataFrame:
    """AGG-33: page numbers absent between a file's first and last."""
    p = docs.where(F.col("page_number").isNotNull() & (F.length("pdf_id") > 0)).select("pdf_id", "page_number").distinct()
    gaps = p.withColumn("prev", F.lag("page_number").over(W.partitionBy("pdf_id").orderBy("page_number"))).where("page_number > prev + 1")
    return gaps.select("pdf_id", F.explode(F.sequence(F.col("prev") + 1, F.col("page_number") - 1)).alias("missing_page"))


def adjacent_pages(docs: DataFrame) -> DataFrame:
    """JOIN-13, first tier: neighbouring pages of one file."""
    key = F.coalesce(*(F.when(F.length(c) > 0, F.col(c)) for c in ("pdf_id", "source_pdf")))
    pos = F.coalesce(F.col("page_index"), F.col("page_number") - 1)
    rows = docs.select("document_id", key.alias("source_key"), pos.alias("position")).where("source_key is not null and position is not null")
    w = W.partitionBy("source_key").orderBy("position", "document_id")
    nxt = rows.withColumn("next_id", F.lead("document_id").over(w)).withColumn("next_position", F.lead("position").over(w))
    return nxt.where("next_position = position + 1").select("source_key", F.col("document_id").alias("a"), F.col("next_id").alias("b"), "position")
