"""Governance, quality and question-answering views."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.functions import text as T
from quire.functions import values as V

# What stands on a page on which nothing was read.
BLANK = "|".join((
    "纯黑", "全黑", "空白页", "图像为空白", "图像为纯黑", "本页为空白", "页面为空白", "此页无内容", "本页无内容", "无可见文字", "无可见文本", "无可识别", "无可辨识", "无可辨认", "无可读文字", "无法转录", "无可转录", "无任何可读",
    "未包含任何可识别", "未检测到任何文字", "没有可识别", "图中没有可识别", "没有收到任何图片", "未收到任何图片", r"无法进行\s*Markdown\s*转录", "无法进行转录",
))


def blank_placeholder(c: str) -> Column:
    """PRJ-13: no text, or words anywhere that say that nothing was read."""
    t = T.stripped(T.text(c))
    return (t == "") | t.rlike(BLANK)


def health(jobs: DataFrame) -> DataFrame:
    """PRJ-14: (job_id, health): failed, pending, degraded, suspected or healthy."""
    h = (
        F.when(F.length(T.text("error")) > 0, "failed")
        .when(F.col("markdown").isNull(), "pending")
        .when(blank_placeholder("markdown"), "suspected")
        .when(F.size(F.coalesce("degraded", F.array().cast("array<int>"))) > 0, "degraded")
        .otherwise("healthy")
    )
    return jobs.select("job_id", h.alias("health"))


def health_summary(jobs: DataFrame) -> DataFrame:
    """AGG-25: jobs by health, and how many can be read again."""
    h = health(jobs)
    return h.groupBy("health").agg(F.count("*").alias("n_jobs"), F.count_if(F.col("health").isin("failed", "suspected", "degraded")).alias("repairable"))


def reply_tags(inferences: DataFrame) -> DataFrame:
    """ARR-13, ARR-16, SUP-70: tags in the first JSON object of a reply, and whether they are valid.

    Valid is an array of at most 32 strings; nulls in it make it invalid.
    """
    body = F.regexp_extract(T.text("raw"), r"(?s)(\{.*\})", 1)
    parsed = F.from_json(body, "tags array<string>", {"mode": "PERMISSIVE"})
    rows = inferences.select("inference_id", parsed["tags"].alias("reply"))
    ok = F.col("reply").isNotNull() & (F.size("reply") <= 32) & ~F.exists("reply", lambda x: x.isNull())
    keys = F.when(ok, F.array_distinct(F.filter(F.transform("reply", T.tag_key), lambda k: k.isNotNull())))
    return rows.select("inference_id", F.coalesce(ok, F.lit(False)).alias("valid"), F.size(F.coalesce("reply", F.array().cast("array<string>"))).alias("n_reply"), keys.alias("keys"))


def relation_edges(docs: DataFrame, key: str, body: str) -> DataFrame:
    """STR-51, STR-52: distinct edges of the lines written as a → b → c."""
    lines = docs.select(F.col(key).alias("key"), F.explode(F.split(T.text(body), "\n")).alias("line")).where(F.col("line").contains("→"))
    nodes = F.transform(F.split(F.regexp_replace("line", r"^\s*(?:[-*+]|\d+[.)])\s+", ""), "→"), T.stripped)
    n = lines.select("key", F.filter(nodes, lambda x: x != "").alias("n")).where(F.size("n") > 1)
    pair = F.explode(F.arrays_zip(F.slice("n", 1, F.size("n") - 1).alias("a"), F.slice("n", 2, F.size("n") - 1).alias("b")))
    return n.select("key", pair.alias("p")).select("key", F.col("p.a").alias("from_label"), F.col("p.b").alias("to_label")).distinct()


def classify(docs: DataFrame, rules: list[tuple[str, list[str]]], key: str, title: str, body: str) -> DataFrame:
    """STR-26: topics whose keywords occur in title or body, in order of the rules, else misc."""
    t = F.lower(F.concat_ws(" ", T.text(title), T.text(body)))
    hits = F.filter(F.array(*(F.when(F.greatest(*(t.contains(w.lower()) for w in ws), F.lit(False)), F.lit(topic)) for topic, ws in rules)), lambda x: x.isNotNull())
    return docs.select(F.col(key).alias("key"), F.explode(F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit("misc")))).alias("topic"))


def citation_markers(answers: DataFrame, key: str, body: str, allowed: int) -> DataFrame:
    """SET-10: markers [n] of an answer within 1 .. allowed, sorted, and the others."""
    n = F.transform(F.regexp_extract_all(T.text(body), F.lit(r"\[(\d{1,4})\]"), F.lit(1)), lambda x: x.cast("int"))
    rows = answers.select(F.col(key).alias("key"), F.array_distinct(n).alias("n"))
    good = lambda x: (x >= 1) & (x <= allowed)
    return rows.select("key", F.array_sort(F.filter("n", good)).alias("trusted"), F.array_sort(F.filter("n", lambda x: ~good(x))).alias("untrusted"))


def paper_front(papers: DataFrame) -> DataFrame:
    """STR-38, SUP-27..29: title line, byline and abstract of front texts."""
    t = T.text("front_text")
    lines = F.filter(F.transform(F.split(t, "\n"), T.stripped), lambda x: x != "")
    abstract = F.regexp_extract(t, r"(?is)\babstract\b[:.\s]*\n?(.+)", 1)
    return papers.select(
        "document_id", F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")).alias("title"), F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit("")).alias("byline"),
        T.stripped(abstract).alias("abstract"), F.length(T.stripped(abstract)).alias("abstract_chars"),
    )


def merged_slots(docs: DataFrame, slot: str, candidates: DataFrame) -> DataFrame:
    """DATE-13, ARR-22: a slot takes the candidate's value unless it was set by hand."""
    s = F.col(f"metadata.{slot}")
    j = docs.select("document_id", s.alias("s")).join(candidates, "document_id", "left")
    keep = F.coalesce(F.col("s.manual"), F.lit(False)) | (F.coalesce(F.col("s.source"), F.lit("")) == "manual")
    return j.select("document_id", F.when(keep, F.col("s.value")).otherwise(F.coalesce("candidate", "s.value")).alias("value"), keep.alias("manual"))


def topics_by_document(assignments: DataFrame) -> DataFrame:
    """SNK-18: (topic, ordinal, document_id) turned into each document's topics in order."""
    return assignments.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "topic"))), lambda x: x["topic"]).alias("topics"))


def suggestions(docs: DataFrame, plan: DataFrame, rejected: DataFrame) -> DataFrame:
    """JOIN-18, JOIN-19, ARR-21: what a plan (document_id, collection_id) would change.

    ``already`` is a member, ``confirm`` has collections chosen by hand, ``pending`` is free.
    """
    known = plan.join(rejected, ["document_id", "collection_id"], "left_anti").join(docs.select("document_id", "manual_collections", "auto_collections"), "document_id")
    has = F.array_contains(V.memberships("manual_collections", "auto_collections"), F.col("collection_id"))
    status = F.when(has, "already").when(F.size(V.ordered_distinct("manual_collections")) > 0, "confirm").otherwise("pending")
    return known.select("document_id", "collection_id", status.alias("status"))


def highlights(docs: DataFrame, marked: list[str], k: int = 5) -> DataFrame:
    """SORT-03, SUP-48: the first k by marked label, longer text, newer date and id."""
    labels = F.transform(V.labels("topics", "tags"), F.lower)
    hit = F.exists(labels, lambda x: F.greatest(*(x.contains(m.lower()) for m in marked), F.lit(False)))
    rows = docs.select("document_id", hit.alias("marked"), F.length(T.text("current_markdown")).alias("n"), T.text("created_at").alias("d"))
    return rows.orderBy(F.desc("marked"), F.desc("n"), F.desc("d"), "document_id").limit(k).select("document_id", "marked", F.col("n").alias("n_chars"))


def resolve_range(kind: str, today: date, first: date | None = None, last: date | None = None) -> tuple[date, date]:
    """DATE-04, SUP-54: first and last day of this_week, last_week or a custom range."""
    kind = {"week": "this_week", "current_week": "this_week", "previous_week": "last_week", "range": "custom"}.get(kind, kind)
    monday = today - timedelta(days=today.weekday())
    if kind == "this_week":
        return monday, monday + timedelta(days=6)
    if kind == "last_week":
        return monday - timedelta(days=7), monday - timedelta(days=1)
    if kind == "custom" and first and last and first <= last:
        return first, last
    raise ValueError(f"no such range: {kind}")


def dashboard(docs: DataFrame, today: str) -> DataFrame:
    """AGG-03: new and changed documents today, this ISO week and in all."""
    made, changed = V.day_of("created_at"), V.day_of("updated_at")
    t = F.lit(today).cast("date")
    week = V.week_start(t)
    spans = {"today": lambda d: d == t, "week": lambda d: d.between(week, t), "total": lambda d: F.lit(True)}
    rows = [docs.agg(F.lit(name).alias("period"), F.count_if(f(made)).alias("n_new"), F.count_if(f(changed)).alias("n_changed")) for name, f in spans.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def version_source(c: str, idx: str) -> Column:
    """PRJ-17: known provenance wins, else the first version was parsed and later ones parsed again."""
    p = F.lower(F.trim(T.text(c)))
    return F.when(p.isin("parse", "reparse", "edit", "merge", "split", "import"), p).when(p != "", "unknown").when(F.col(idx) <= 0, "parse").otherwise("reparse")


def layers(edges: DataFrame) -> DataFrame:
    """WIN-21: (node, layer) by the longest path from a source; nodes on cycles come one below their deepest free parent.

    A round settles one layer, however many nodes it has, and the rounds end with the deepest.
    """
    from quire.session import cut, discard

    e = cut(edges.select("source", "target").where("source <> target").distinct())
    left = cut(e.select(F.explode(F.array("source", "target")).alias("node")).distinct())
    done, depth = left.limit(0).withColumn("layer", F.lit(0)), 0
    while True:
        # a node is free when none of its parents is left
        held = e.join(left.withColumnRenamed("node", "source"), "source", "left_semi").select(F.col("target").alias("node")).distinct()
        free = cut(left.join(held, "node", "left_anti"))
        if free.limit(1).count() == 0:
            break
        done = done.unionByName(free.withColumn("layer", F.lit(depth)))
        before, left = left, cut(left.join(free, "node", "left_anti"))
        discard(before)
        depth += 1
        if depth % 20 == 0:
            done = cut(done)
    parents = e.join(done.select(F.col("node").alias("source"), "layer"), "source").groupBy(F.col("target").alias("node")).agg(F.max("layer").alias("deepest"))
    rest = left.join(parents, "node", "left").select("node", (F.coalesce("deepest", F.lit(-1)) + 1).alias("layer"))
    return done.unionByName(rest)


def scores_by_group(rows: DataFrame, group: str, pred: str, gold: str) -> DataFrame:
    """AGG-27, AGG-28, MATH-02: edit rates per group: mean, least, most, and over all characters."""
    d = F.levenshtein(T.text(pred), T.text(gold))
    n = F.greatest(F.length(T.text(gold)), F.lit(1))
    return rows.groupBy(group).agg(
        F.count("*").alias("n"), F.round(F.avg(d / n), 4).alias("mean_rate"), F.round(F.min(d / n), 4).alias("least"), F.round(F.max(d / n), 4).alias("most"), F.round(F.sum(d) / F.sum(n), 4).alias("micro_rate"),
    )
