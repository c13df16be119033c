"""Changes that people and plans make to records: pairs, collections, tags, vocabularies, paper fields.

SNK-14, SNK-15, SNK-20..28, STR-07, STR-08, ARR-02, ARR-08, ARR-10..12, ARR-17, ARR-23, JOIN-17,
DIFF-10, SUP-13, SUP-18, SUP-19, SUP-44, SUP-45, SUP-64, SUP-65, SUP-67, SUP-68, SUP-72, SUP-73.

Every change is a new table: a union with a rule for which row wins, an anti-join, or a column
rewritten in place. Null arrays and maps count as empty; blank labels are dropped; repeated rows
of a key count once; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import values as V

PROVENANCE = "array<struct<tag:string,source:string>>"


def pair_key(a: str | Column, b: str | Column) -> Column:
    """One key for both orders of a pair."""
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def reject(known: DataFrame, new: DataFrame) -> DataFrame:
    """SNK-14, SUP-18: rejected pairs (pair, distance) with new ones (a, b, distance); the new row wins."""
    fresh = new.where("a is not null and b is not null and a <> b").select(pair_key("a", "b").alias("pair"), "distance").groupBy("pair").agg(F.min("distance").alias("distance"))
    return known.select("pair", "distance").join(fresh, "pair", "left_anti").unionByName(fresh)


def confirm(docs: DataFrame, pairs: DataFrame, rejected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK-15: relations in both directions (source, target, distance, similarity), and the rejections left.

    Pairs with an unknown document and of a document with itself give nothing.
    """
    ids = docs.select("document_id").distinct()
    ok = pairs.where("a <> b").join(ids.withColumnRenamed("document_id", "a"), "a", "left_semi").join(ids.withColumnRenamed("document_id", "b"), "b", "left_semi")
    near = ok.groupBy("a", "b").agg(F.min("distance").alias("distance")).withColumn("similarity", F.round(V.hash_similarity("distance"), 4))
    both = near.select(F.col("a").alias("source"), F.col("b").alias("target"), "distance", "similarity").unionByName(near.select(F.col("b").alias("source"), F.col("a").alias("target"), "distance", "similarity"))
    left = rejected.join(near.select(pair_key("a", "b").alias("pair")).distinct(), "pair", "left_anti")
    return both.dropDuplicates(["source", "target"]), left


def drop_collection(docs: DataFrame, registry: DataFrame, collection: str) -> DataFrame:
    """SNK-20: records without a collection; one that a topic stands for can't be dropped and stays."""
    fixed = registry.where((F.col("collection_id") == collection) & F.col("topic").isNotNull()).limit(1).count() > 0
    if fixed:
        raise ValueError(f"{collection} stands for a topic")
    without = lambda c: F.filter(V.ordered_distinct(c), lambda x: x != collection)
    return docs.select("document_id", without("manual_collections").alias("manual_collections"), without("auto_collections").alias("auto_collections"))


def set_collections(docs: DataFrame, wanted: DataFrame, registry: DataFrame) -> DataFrame:
    """SNK-21: manual collections replaced by ``wanted`` (document_id, collections); unknown ids are named and change nothing."""
    known = registry.select("collection_id").distinct()
    rows = wanted.select("document_id", F.posexplode_outer(V.ordered_distinct("collections")).alias("pos", "collection_id"))
    marked = rows.join(known.withColumn("known", F.lit(True)), "collection_id", "left")
    plan = marked.groupBy("document_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("collection_id").isNotNull(), F.struct("pos", "collection_id")))), lambda x: x["collection_id"]).alias("ids"),
        F.array_sort(F.collect_list(F.when(F.col("collection_id").isNotNull() & F.col("known").isNull(), F.col("collection_id")))).alias("unknown"),
    )
    j = docs.select("document_id", V.ordered_distinct("manual_collections").alias("had")).join(plan, "document_id")
    return j.select("document_id", F.when(F.size("unknown") > 0, F.col("had")).otherwise(F.col("ids")).alias("manual_collections"), "unknown")


def add_auto_collections(docs: DataFrame, found: DataFrame) -> DataFrame:
    """SNK-22: ``found`` (document_id, collections) behind the automatic ones a record has."""
    new = found.select("document_id", F.posexplode(V.ordered_distinct("collections")).alias("pos", "c")).groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda x: x["c"]).alias("new"))
    return docs.join(new, "document_id").select("document_id", F.array_distinct(F.concat(V.ordered_distinct("auto_collections"), "new")).alias("auto_collections"))


def vocabulary_keys(vocabulary: DataFrame) -> DataFrame:
    """ARR-11: (k, tag): names before aliases, then the smallest tag, for every spelling that has a key."""
    names = vocabulary.select("tag", F.lit(0).alias("rank"), F.col("tag").alias("name")).unionByName(
        vocabulary.select("tag", F.lit(1).alias("rank"), F.explode(F.coalesce("aliases", F.array().cast("array<string>"))).alias("name"))
    )
    keyed = names.select(T.tag_key("name").alias("k"), "rank", "tag").where("k is not null")
    return keyed.groupBy("k").agg(F.min(F.struct("rank", "tag"))["tag"].alias("tag"))


def canonical_tags(rows: DataFrame, vocabulary: DataFrame, key: str = "document_id", tags: str = "tags") -> DataFrame:
    """STR-08: (key, tags, created): tags as the vocabulary has them, in order, once; unknown ones take their own key.

    ``created`` names the tags that the vocabulary lacks; tags without a key are dropped.
    """
    used = rows.select(key, F.posexplode(V.ordered_distinct(tags)).alias("pos", "raw")).select(key, "pos", T.tag_key("raw").alias("k")).where("k is not null")
    got = used.join(vocabulary_keys(vocabulary), "k", "left").select(key, "pos", F.coalesce("tag", "k").alias("t"), F.col("tag").isNull().alias("is_new"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "t", "is_new")))
    out = got.groupBy(key).agg(ordered.alias("o"))
    return out.select(key, F.array_distinct(F.transform("o", lambda x: x["t"])).alias("tags"), F.array_distinct(F.transform(F.filter("o", lambda x: x["is_new"]), lambda x: x["t"])).alias("created"))


def ensured_vocabulary(vocabulary: DataFrame, spellings: DataFrame) -> DataFrame:
    """STR-07: (tag, aliases) after ``spellings`` (raw) were looked up or added; a spelling other than the tag becomes an alias."""
    raw = spellings.select(T.alias_form("raw").alias("raw")).where("raw <> ''").distinct().select("raw", T.tag_key("raw").alias("k")).where("k is not null")
    found = raw.join(vocabulary_keys(vocabulary), "k", "left").select(F.coalesce("tag", "k").alias("tag"), "raw")
    new = found.groupBy("tag").agg(F.collect_set(F.when(F.col("raw") != F.col("tag"), F.col("raw"))).alias("more"))
    had = vocabulary.select("tag", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    none = F.array().cast("array<string>")
    return had.join(new, "tag", "full_outer").select("tag", F.array_sort(F.array_union(F.coalesce("aliases", none), F.coalesce("more", none))).alias("aliases"))


def rename_tag(docs: DataFrame, source: str, target: str) -> DataFrame:
    """ARR-08, SUP-65: a tag renamed in every record that has it; where both are there, the first place stays."""
    tags = V.ordered_distinct("tags")
    return docs.where(F.array_contains(tags, source)).select("document_id", F.array_distinct(F.transform(tags, lambda x: F.when(x == source, F.lit(target)).otherwise(x))).alias("tags"))


def provenance(tags: str | Column, source: str) -> Column:
    """SNK-23: tags set by hand or by a run, each with its source."""
    return F.transform(V.ordered_distinct(tags), lambda t: F.struct(t.alias("tag"), F.lit(source).alias("source")))


def added_provenance(had: str | Column, new: str | Column, source: str) -> Column:
    """SNK-24, ARR-10: tags of ``new`` behind those of ``had``; a manual tag is never downgraded."""
    old = F.coalesce(F.col(had) if isinstance(had, str) else had, F.array().cast(PROVENANCE))
    fresh = V.ordered_distinct(new)
    kept = F.transform(old, lambda x: F.struct(x["tag"].alias("tag"), F.when((x["source"] == "manual") | ~F.array_contains(fresh, x["tag"]), x["source"]).otherwise(F.lit(source)).alias("source")))
    names = F.transform(old, lambda x: x["tag"])
    more = F.transform(F.filter(fresh, lambda t: ~F.array_contains(names, t)), lambda t: F.struct(t.alias("tag"), F.lit(source).alias("source")))
    return F.concat(kept, more)


def promoted(had: str | Column, tag: Column) -> Column:
    """SNK-25: a tag made manual; null where the record lacks it."""
    old = F.col(had) if isinstance(had, str) else had
    return F.when(F.exists(old, lambda x: x["tag"] == tag), F.transform(old, lambda x: F.struct(x["tag"].alias("tag"), F.when(x["tag"] == tag, F.lit("manual")).otherwise(x["source"]).alias("source"))))


def removed(had: str | Column, tag: Column) -> Column:
    """SNK-25: a tag and its source taken off a record."""
    old = F.col(had) if isinstance(had, str) else had
    return F.filter(old, lambda x: x["tag"] != tag)


def registered(registry: DataFrame, names: DataFrame) -> DataFrame:
    """ARR-12, SUP-64: the registry (collection_id, collection_name, topic) with new names; what is there wins, a topic joins the collection of its name."""
    new = names.select(T.stripped(T.text("name")).alias("collection_name"), F.col("topic").alias("new_topic")).where("collection_name <> ''")
    new = new.select(T.slug("collection_name").alias("slug"), "collection_name", "new_topic").where("slug <> ''").groupBy("slug").agg(F.min("collection_name").alias("new_name"), F.max("new_topic").alias("new_topic"))
    had = registry.select(T.slug("collection_name").alias("slug"), "collection_id", "collection_name", "topic")
    return had.join(new, "slug", "full_outer").select(
        F.coalesce("collection_id", "slug").alias("collection_id"), F.coalesce("collection_name", "new_name").alias("collection_name"), F.coalesce("topic", "new_topic").alias("topic")
    )


def scheme_errors(topics: DataFrame, assignments: DataFrame, summaries: DataFrame, docs: DataFrame, most: int) -> DataFrame:
    """ARR-17: broken rules of a scheme: topics (topic), assignments (topic, document_id), summaries (document_id, summary)."""
    t = topics.select(T.stripped("topic").alias("topic")).where("topic <> ''").distinct()
    ids = docs.select("document_id").distinct()
    rows = assignments.select("topic", "document_id").distinct()
    many = t.agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.lit("too_many_topics").alias("error"), F.col("n").cast("string").alias("subject"))
    lost_topic = rows.join(t, "topic", "left_anti").select(F.lit("unknown_topic").alias("error"), F.col("topic").alias("subject")).distinct()
    lost_doc = rows.join(ids, "document_id", "left_anti").select(F.lit("unknown_document").alias("error"), F.col("document_id").alias("subject")).distinct()
    bare = ids.join(rows, "document_id", "left_anti").select(F.lit("no_topic").alias("error"), F.col("document_id").alias("subject"))
    silent = ids.join(summaries.where(F.length("summary") > 0), "document_id", "left_anti").select(F.lit("no_summary").alias("error"), F.col("document_id").alias("subject"))
    return many.unionByName(lost_topic).unionByName(lost_doc).unionByName(bare).unionByName(silent)


def topics_with_scheme(docs: DataFrame, assignments: DataFrame) -> DataFrame:
    """ARR-02, JOIN-17: a record's topics, then those a scheme (topic, ordinal, document_id) gives it."""
    own = docs.select("document_id", F.posexplode(V.ordered_distinct("topics")).alias("pos", "topic")).select("document_id", F.lit(0).alias("k"), "pos", "topic")
    more = assignments.join(docs.select("document_id"), "document_id", "left_semi").select("document_id", F.lit(1).alias("k"), F.col("ordinal").cast("int").alias("pos"), "topic")
    return own.unionByName(more).groupBy("document_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("k", "pos", "topic"))), lambda x: x["topic"])).alias("topics"))


def manual_documents(docs: DataFrame) -> DataFrame:
    """SUP-72: documents with collections chosen by hand."""
    return docs.where(F.size(V.ordered_distinct("manual_collections")) > 0).select("document_id")


def apply_assignments(docs: DataFrame, plan: DataFrame, accepted: DataFrame | None = None, with_manual: bool = False) -> DataFrame:
    """SUP-67, SUP-73: each planned pair (document_id, collection_id) and whether it is applied, skipped or had.

    ``accepted`` (document_id, collection_id) narrows the plan; None accepts all.
    """
    p = plan.select("document_id", "collection_id").distinct()
    if accepted is not None:
        p = p.join(accepted.select("document_id", "collection_id").distinct(), ["document_id", "collection_id"], "left_semi")
    j = p.join(docs.select("document_id", V.ordered_distinct("manual_collections").alias("m"), V.ordered_distinct("auto_collections").alias("a")), "document_id")
    has = F.array_contains("m", F.col("collection_id")) | F.array_contains("a", F.col("collection_id"))
    skip = F.lit(False) if with_manual else F.size("m") > 0
    return j.select("document_id", "collection_id", F.when(has, "had").when(skip, "skipped").otherwise("applied").alias("outcome"))


def stale_labels(accepted: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """SUP-68: accepted labels (tag) that no longer resolve."""
    keys = vocabulary_keys(vocabulary)
    return accepted.select("tag", T.tag_key("tag").alias("k")).distinct().join(keys.select("k"), "k", "left_anti").select("tag")


def overlaid(fields: dict[str, tuple[str | Column, str | Column]], override: tuple[str, ...] = ()) -> list[Column]:
    """ARR-23, SNK-26: fields (had, proposed) filled where empty, or replaced where named; ``f_source`` says which."""
    out = []
    for name, (had, new) in fields.items():
        h, n = (F.col(x) if isinstance(x, str) else x for x in (had, new))
        h, n = F.when(T.stripped(T.text(h)) != "", h), F.when(T.stripped(T.text(n)) != "", n)
        value = F.coalesce(n, h) if name in override else F.coalesce(h, n)
        taken = n.isNotNull() & (F.lit(name in override) | h.isNull())
        out += [value.alias(name), F.when(taken, "proposed").when(h.isNotNull(), "parsed").alias(f"{name}_source")]
    return out


def references_of(refs: DataFrame, doc: str = "citing_id") -> DataFrame:
    """SNK-27: each document's references as one array in order of their index."""
    rows = refs.where(F.col(doc).isNotNull()).dropDuplicates(["ref_id"]).select(F.col(doc).alias("document_id"), F.struct(F.col("ref_index").alias("index"), "ref_id", "raw", F.col("document_id").alias("resolved_document_id")).alias("r"))
    return rows.groupBy("document_id").agg(F.array_sort(F.collect_list("r")).alias("refs"))


def patch_reference(papers: DataFrame, patches: DataFrame) -> DataFrame:
    """SNK-28: element ``index`` of ``refs`` gets a resolved document; an index that isn't there is reported.

    ``patches`` has document_id, index and resolved_document_id, one row a document.
    """
    one = patches.groupBy("document_id").agg(F.max(F.struct("index", "resolved_document_id")).alias("p"))
    j = papers.join(one, "document_id")
    fits = F.exists("refs", lambda r: r["index"] == F.col("p.index"))
    new = F.transform("refs", lambda r: F.when(r["index"] == F.col("p.index"), r.withField("resolved_document_id", F.col("p.resolved_document_id"))).otherwise(r))
    return j.select("document_id", F.when(fits, new).otherwise(F.col("refs")).alias("refs"), F.when(~fits, "out_of_range").alias("error"))


def record_hashes(*columns: str | Column) -> Column:
    """SUP-13: hashes of a record in their order, once, without blanks."""
    return F.array_distinct(F.filter(F.array(*columns), lambda x: F.coalesce(x, F.lit("")) != ""))


def content_of(current: str | Column, versions: str | Column) -> Column:
    """SUP-44: the live text, else the last version's, else nothing."""
    c, v = (F.col(x) if isinstance(x, str) else x for x in (current, versions))
    return F.coalesce(F.when(c != "", c), F.when(v != "", v), F.lit(""))


def merge_target(nearest: str | Column, proposed: str | Column) -> Column:
    """DIFF-10: the nearest known document, else the one proposed."""
    return F.coalesce(*(F.col(x) if isinstance(x, str) else x for x in (nearest, proposed)))
