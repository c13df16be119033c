"""Digests and reports: statistics, partitions, texts, replies, fingerprints, stored metas.

AGG-10, AGG-11, ARR-14, ARR-15, ARR-24..27, PRJ-19, PRJ-28, SORT-06, SORT-07, SORT-10, SRC-16, SRC-17,
STR-16..19, STR-23, STR-25, SUP-46, SUP-47, SUP-49..53, SUP-61, SUP-97..99, SNK-06.

Lists that a digest shows are bounded by its own limits (top-k); statistics are aggregates over all
rows. Null labels and blank texts count as empty; an empty range gives one row of zeros with a null
rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import values as V
from quire.operators import library

# What a digest says.
REASONS = {"no_topic": "缺主题", "no_tag": "缺标签", "explicit": "显式标记", "low_confidence": "低置信度"}
SECTIONS = {"overview": "本周概览", "topics": "主题进展", "highlights": "重点文档摘录", "pending": "待整理与连续体进展"}
CORE = ("overview", "progress", "issues", "appendix")
_REPLY = "struct<markdown:string,text:string,content:string,source_document_ids:array<string>,document_ids:array<string>>"


def range_stats(items: DataFrame, docs: DataFrame, first: str, last: str) -> DataFrame:
    """AGG-10: one row of counts of the documents of a range of days."""
    chosen = items.where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).select("document_id")
    made = V.day_of("created_at")
    rows = docs.join(chosen, "document_id", "left_semi").select(
        V.ordered_distinct("topics").alias("t"), V.ordered_distinct("tags").alias("g"), (T.stripped(T.text("current_markdown")) != "").alias("read"),
        F.coalesce(made.between(F.lit(first).cast("date"), F.lit(last).cast("date")), F.lit(False)).alias("new"), library.reasons().alias("r"),
    )
    # distinct labels are counted from one row a label, so that no array holds those of all documents
    counts = rows.agg(
        F.count("*").alias("document_count"), F.count_if("new").alias("new_document_count"), F.count_if("read").alias("parsed_count"), F.count_if(~F.col("read")).alias("failed_count"),
        F.count_if(F.size("g") > 0).alias("tagged_count"), F.count_if(F.size("r") > 0).alias("inbox_in_range"),
    )
    labels = rows.select(F.explode(F.concat(F.transform("t", lambda x: F.struct(F.lit("t").alias("k"), x.alias("v"))), F.transform("g", lambda x: F.struct(F.lit("g").alias("k"), x.alias("v"))))).alias("x")).distinct()
    distinct = labels.agg(F.count_if(F.col("x.k") == "t").alias("topic_count"), F.count_if(F.col("x.k") == "g").alias("tag_count"))
    one = F.lit(1).alias("_one")
    joined = counts.select("*", one).join(distinct.select("*", one), "_one").drop("_one")
    return joined.withColumn("parse_success_rate", F.round(F.try_divide(F.col("parsed_count") * 100.0, F.col("document_count")), 1))


def overview_text(stats: DataFrame) -> DataFrame:
    """SUP-49: the overview of a range's statistics."""
    n = lambda c: F.col(c).cast("string")
    rate = F.when(F.col("parse_success_rate").isNull(), "无材料").otherwise(F.concat(F.format_string("%.1f", "parse_success_rate"), F.lit("%")))
    lines = (
        F.concat(F.lit("- 材料文档："), n("document_count"), F.lit(" 篇（本周新增 "), n("new_document_count"), F.lit(" 篇）")),
        F.concat(F.lit("- 解析成功："), n("parsed_count"), F.lit("/"), n("document_count"), F.lit("（"), rate, F.lit("），失败 "), n("failed_count"), F.lit(" 篇")),
        F.concat(F.lit("- 主题标签："), n("topic_count"), F.lit(" 个主题 / "), n("tag_count"), F.lit(" 个标签（覆盖 "), n("tagged_count"), F.lit(" 篇）")),
    )
    return stats.select(F.concat_ws("\n", *lines).alias("markdown"))


def pending_text(reasons: DataFrame, backlog: Column) -> DataFrame:
    """SUP-46, SUP-50: the backlog and its reasons (reason, n_documents), of which there are four at most."""
    names = F.create_map(*(F.lit(x) for kv in REASONS.items() for x in kv))
    part = F.struct("reason", F.concat_ws(" ", F.coalesce(F.try_element_at(names, F.col("reason")), F.col("reason")), F.col("n_documents").cast("string")).alias("t"))
    detail = reasons.agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "、").alias("d"))
    head = F.concat(F.lit("- Inbox 积压：库内 "), backlog.cast("string"), F.lit(" 篇待整理"))
    return detail.select(F.concat_ws("\n", head, F.when(F.col("d") != "", F.concat(F.lit("  - 原因："), F.col("d")))).alias("markdown"))


def highlight_lines(chosen: DataFrame) -> DataFrame:
    """SUP-51: (rank, document_id, markdown) of chosen documents (rank, document_id, title, day, tags, topics, content)."""
    title = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("document_id"))
    route = F.concat(F.lit("#doc/"), F.replace(F.url_encode("document_id"), F.lit("+"), F.lit("%20")))
    meta = F.concat_ws(
        " ｜ ", F.concat(F.lit("日期："), F.coalesce(F.col("day").cast("string"), F.lit("未知"))), F.when(F.size("tags") > 0, F.concat(F.lit("标签："), F.array_join("tags", "、"))),
        F.when(F.size("topics") > 0, F.concat(F.lit("主题："), F.array_join("topics", "、"))),
    )
    quoted = F.array_join(F.transform(F.split(T.excerpt("content"), "\n"), lambda x: F.rtrim(F.concat(F.lit("> "), x))), "\n")
    head = F.concat(F.lit("### "), F.col("rank").cast("string"), F.lit(". "), title)
    source = F.concat(F.lit("- 来源：["), title, F.lit("]("), route, F.lit(")（`"), F.col("document_id"), F.lit("`）"))
    body = F.concat_ws("\n", head, F.concat(F.lit("- "), meta), source, F.when(T.excerpt("content") != "", F.concat(F.lit("\n"), quoted)))
    return chosen.select("rank", "document_id", body.alias("markdown"))


def appendix_lines(docs: DataFrame) -> DataFrame:
    """SUP-97: one link line a document of the material."""
    title = F.coalesce(F.when(T.text("title") != "", F.col("title")), F.col("document_id"))
    route = F.concat(F.lit("#doc/"), F.replace(F.url_encode("document_id"), F.lit("+"), F.lit("%20")))
    return docs.select("document_id", F.concat(F.lit("- ["), title, F.lit("]("), route, F.lit(")（`"), F.col("document_id"), F.lit("`，"), F.coalesce(F.col("day").cast("string"), F.lit("日期未知")), F.lit("）")).alias("line"))


def material(items: DataFrame, docs: DataFrame, kept: DataFrame) -> DataFrame:
    """AGG-11, PRJ-28: kept documents of a range, each organised or pending; texts aren't carried."""
    bare = (F.size(V.ordered_distinct("topics")) == 0) & (F.size(V.ordered_distinct("tags")) == 0)
    pending = bare | F.arrays_overlap(library.reasons(), F.array(F.lit("low_confidence")))
    return docs.join(kept.select("document_id"), "document_id", "left_semi").join(items.select("document_id", "day"), "document_id").select(
        "document_id", T.text("title").alias("title"), "day", F.when(pending, "pending").otherwise("organised").alias("part"),
    )


def inbox_items(docs: DataFrame) -> DataFrame:
    """SUP-61: inbox rows with the labels of their reasons."""
    names = F.create_map(*(F.lit(x) for kv in REASONS.items() for x in kv))
    r = library.reasons()
    return docs.where(F.size(r) > 0).select("document_id", r.alias("reasons"), F.transform(r, lambda x: F.coalesce(F.try_element_at(names, x), x)).alias("reason_labels"))


def lenient_json(c: str | Column) -> Column:
    """ARR-14: JSON text of a reply: what a fence holds, the whole, or what the outer braces hold; null where none parses."""
    body = T.stripped(T.text(c))
    fenced = T.stripped(F.regexp_extract(body, r"(?s)```(?:json)?\s*(.*?)```", 1))
    outer = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    tries = (F.when(F.try_parse_json(x).isNotNull() & (x != ""), x) for x in (fenced, body, outer))
    return F.coalesce(*tries)


def section_replies(replies: DataFrame, allowed: DataFrame, sections: tuple[str, ...], key: str = "reply_id", text: str = "raw") -> DataFrame:
    """ARR-15, SUP-98: (key, section, markdown, source_document_ids, mode) of replies with sections.

    Sections are those asked for; ids that aren't in ``allowed`` (document_id) are dropped; a
    section without text and ids is no section; mode is ``json`` where a reply has any, else one row
    of mode ``text`` without a section.
    """
    j = replies.select(key, lenient_json(text).alias("j"))
    root = F.coalesce(F.get_json_object("j", "$.sections"), F.col("j"))
    parts = F.array(*(F.struct(F.lit(s).alias("section"), F.get_json_object(root, f"$.{s}").alias("part")) for s in sections))
    rows = j.select(key, F.explode(parts).alias("x")).select(key, "x.section", "x.part").where("part is not null")
    r = F.from_json("part", _REPLY)
    plain = F.coalesce(*(F.when(r[f] != "", r[f]) for f in ("markdown", "text", "content")), F.when(F.substring("part", 1, 1) != "{", F.col("part")), F.lit(""))
    rows = rows.select(key, "section", T.stripped(plain).alias("markdown"), V.ordered_distinct(F.coalesce(r["source_document_ids"], r["document_ids"])).alias("ids"))
    known = rows.select(key, "section", F.posexplode("ids").alias("pos", "document_id")).join(allowed.select("document_id").distinct(), "document_id", "left_semi")
    ids = known.groupBy(key, "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "document_id"))), lambda x: x["document_id"]).alias("source_document_ids"))
    full = rows.drop("ids").join(ids, [key, "section"], "left").withColumn("source_document_ids", F.coalesce("source_document_ids", F.array().cast("array<string>")))
    full = full.where((F.col("markdown") != "") | (F.size("source_document_ids") > 0)).withColumn("mode", F.lit("json"))
    none = replies.select(key).distinct().join(full.select(key).distinct(), key, "left_anti")
    return full.select(key, "section", "markdown", "source_document_ids", "mode").unionByName(
        none.select(key, F.lit(None).cast("string").alias("section"), F.lit("").alias("markdown"), F.array().cast("array<string>").alias("source_document_ids"), F.lit("text").alias("mode"))
    )


def digest_sections(overview: DataFrame, topics: DataFrame, highlights: DataFrame, pending: DataFrame) -> DataFrame:
    """ARR-27: the four sections in order, each from one row (markdown, source_document_ids, generated_by)."""
    out = None
    for i, (k, d) in enumerate(zip(SECTIONS, (overview, topics, highlights, pending))):
        one = d.select(F.lit(i).alias("place"), F.lit(k).alias("key"), F.lit(SECTIONS[k]).alias("title"), "markdown", "source_document_ids", "generated_by")
        out = one if out is None else out.unionByName(one)
    return out


def modules(raw: DataFrame) -> DataFrame:
    """ARR-24: report modules (place, key, title, enabled): valid keys that no fixed section has, first of each, titled by default."""
    ok = raw.where(F.col("key").rlike(r"^[a-z][a-z0-9_]{0,39}$") & ~F.col("key").isin(*CORE))
    first = ok.groupBy("key").agg(F.min_by(F.struct("place", "title", "enabled"), "place").alias("m"))
    return first.select("m.place", "key", F.coalesce(F.when(T.stripped(T.text("m.title")) != "", T.stripped("m.title")), F.col("key")).alias("title"), F.coalesce("m.enabled", F.lit(True)).alias("enabled"))


def chapters(mods: DataFrame, bodies: DataFrame) -> DataFrame:
    """ARR-25, ARR-26: numbered chapters of a report: the core ones, and modules with text and evidence between them.

    ``bodies`` has key, markdown and ids. Numbers have no gaps; the appendix comes last without one.
    """
    fixed = mods.sparkSession.createDataFrame([(-2, "overview", "概览"), (-1, "progress", "进展"), (1_000_000, "issues", "问题与求助")], "place int, key string, title string")
    extra = mods.where("enabled").select(F.col("place").cast("int").alias("place"), "key", "title").join(bodies.where((T.stripped(T.text("markdown")) != "") & (F.size("ids") > 0)).select("key"), "key", "left_semi")
    rows = fixed.unionByName(extra.select("place", "key", "title")).join(bodies, "key", "left")
    # a report has a few dozen chapters, so one ordered list of them is bounded by its modules
    listed = rows.agg(F.array_sort(F.collect_list(F.struct("place", "key", "title", T.stripped(T.text("markdown")).alias("markdown")))).alias("c"))
    one = listed.select(F.posexplode("c").alias("i", "c"))
    return one.select((F.col("i") + 1).alias("number"), F.col("c.key").alias("key"), F.concat((F.col("i") + 1).cast("string"), F.lit("、"), F.col("c.title")).alias("title"), F.col("c.markdown").alias("markdown"))


def fingerprint(*parts: Column) -> Column:
    """STR-16..18: hash of a fixed order of parts; null counts as empty."""
    return F.sha2(F.to_json(F.array(*(T.text(p.cast("string")) for p in parts))), 256)


def section_fingerprints(docs: DataFrame, first: str, last: str) -> DataFrame:
    """STR-17, SUP-52: (part, fingerprint) over the documents (document_id, part, content_hash) of each part; no documents, no row.

    Documents are folded to a sum and an exclusive or of their hashes, so any number of them adds up
    in partial aggregates whatever their order.
    """
    h = F.xxhash64("document_id", T.text("content_hash"))
    sums = docs.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.shiftright(h, 16)).alias("s"), F.bit_xor(h).alias("x"))
    return sums.select("part", fingerprint(F.lit(first), F.lit(last), F.col("part"), F.col("n"), F.col("s"), F.col("x")).alias("fingerprint"))


def vocabulary_fingerprint(vocabulary: DataFrame) -> DataFrame:
    """STR-19: one hash of all tags with their sorted aliases and groups, in any order of rows."""
    h = F.sha2(F.concat_ws("\x1f", "tag", T.text("tag_group"), F.array_join(F.array_sort(F.coalesce("aliases", F.array().cast("array<string>"))), "\x1e")), 256)
    # the reference list is small by its nature; its size is checked by the caller's registry limits
    return vocabulary.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(h)), "\x1e"), 256).alias("fingerprint"))


def digest_id(created: str | Column, fp: str | Column) -> Column:
    """SORT-10: an id from the time and the fingerprint."""
    c, f = (F.col(x) if isinstance(x, str) else x for x in (created, fp))
    return F.concat_ws("-", F.regexp_replace(c, r"[^0-9]", ""), F.substring(f, 1, 8))


def catalogue(metas: DataFrame, template: str | None = None) -> DataFrame:
    """SRC-16, SRC-17: stored metas with an id, newest first; ``template`` keeps those of one kind."""
    ok = metas.where(F.length(F.trim(F.coalesce("digest_id", F.lit("")))) > 0)
    return (ok if template is None else ok.where(F.col("template_id") == template)).orderBy(F.desc("created_at"), F.desc("digest_id"))


def newest_match(metas: DataFrame, fp: str) -> DataFrame:
    """SORT-06: the newest meta with a fingerprint."""
    return catalogue(metas.where(F.col("fingerprint") == fp)).limit(1)


def newest_section(metas: DataFrame, key: str, fp: str) -> DataFrame:
    """SORT-07: the newest stored section with a fingerprint and a text; ``sections`` is an array of (key, fingerprint, markdown)."""
    hit = F.filter("sections", lambda x: (x["key"] == key) & (x["fingerprint"] == fp) & (T.stripped(T.text(x["markdown"])) != ""))
    return catalogue(metas.withColumn("hit", F.try_element_at(hit, F.lit(1))).where("hit is not null")).limit(1).select("digest_id", "hit.*")


def shown_sections(c: str | Column) -> Column:
    """SUP-53: sections with a key, titled by default."""
    names = F.create_map(*(F.lit(x) for kv in SECTIONS.items() for x in kv))
    raw = F.col(c) if isinstance(c, str) else c
    good = F.filter(F.coalesce(raw, F.array().cast("array<struct<key:string,title:string,source_document_ids:array<string>>>")), lambda x: x.isNotNull() & (T.stripped(T.text(x["key"])) != ""))
    return F.transform(good, lambda x: F.struct(
        T.stripped(x["key"]).alias("key"), F.coalesce(F.when(x["title"] != "", x["title"]), F.try_element_at(names, T.stripped(x["key"])), T.stripped(x["key"])).alias("title"),
        F.coalesce(x["source_document_ids"], F.array().cast("array<string>")).alias("source_document_ids")))


def bounded(labels: Column, most: int = 50) -> Column:
    """SUP-99, SNK-06: the first ``most`` of sorted labels, and whether some were left out."""
    a = F.array_sort(F.coalesce(labels, F.array().cast("array<string>")))
    return F.struct(F.slice(a, 1, most).alias("labels"), (F.size(a) > most).alias("truncated"))


def same_display(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """PRJ-19: equal display fields; null and empty are the same."""
    out = F.lit(True)
    for k in a:
        out = out & F.nullif(a[k], F.lit("")).eqNullSafe(F.nullif(b[k], F.lit("")))
    return out


def one_line(c: str | Column, fallback: str | Column, limit: int = 60) -> Column:
    """STR-23: the first line with text, without heading marks, cut with an ellipsis; else the fallback."""
    lines = F.filter(F.transform(F.split(T.text(c), "\n"), lambda x: T.stripped(F.regexp_replace(T.stripped(x), r"^#+", ""))), lambda x: x != "")
    t = F.coalesce(F.try_element_at(lines, F.lit(1)), F.col(fallback) if isinstance(fallback, str) else fallback)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 1), F.lit("…"))).otherwise(t)


def truncated(c: str | Column, limit: int = 2000, mark: str = "\n…（已截断）") -> Column:
    """STR-25: at most ``limit`` characters and a mark that the rest is missing."""
    t = T.text(c)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit(mark))).otherwise(t)
