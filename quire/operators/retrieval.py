"""Search over blocks and pages, retrieval within a scope, answers of earlier turns, runs and prices.

WIN-15, SUP-01..07, SUP-55, SUP-56, SUP-58, SUP-89, SUP-93, SUP-94, SET-11, AGG-29..31, ARR-32, SRC-23.

Null and blank texts have one empty block; null scopes mean all files; repeated ids of a scope count
once; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.functions import text as T
from quire.functions import values as V
from quire.operators import search

#: Most hits that one search gives; a scope of several files is cut out of these.
MOST_HITS = 200
# The names that prices per million go by.
PRICES = {"input_price": ("input_per_million", "prompt_per_million"), "output_price": ("output_per_million", "completion_per_million"), "reasoning_price": ("reasoning_per_million",)}


def split_blocks(docs: DataFrame, key: str, body: str) -> DataFrame:
    """WIN-15: (key, block, text, heading): blocks end at blank lines and begin at headings; the last heading is carried on."""
    t = F.regexp_replace(T.text(body), "\r\n", "\n")
    t = F.regexp_replace(t, r"(?m)^(#{1,6}\s)", "\x01$1")
    t = F.regexp_replace(t, r"\n(?:[ \t\r\f]*\n)+|^(?:[ \t\r\f]*\n)+|\n[ \t\r\f]+$", "\x01")
    parts = F.transform(F.split(t, "\x01"), lambda x: F.regexp_replace(x, r"^\n+|\n+$", ""))
    some = F.filter(parts, lambda x: F.trim(x) != "")
    rows = docs.select(F.col(key).alias("key"), F.posexplode(F.when(F.size(some) > 0, some).otherwise(F.array(F.lit("")))).alias("block", "text"))
    own = F.when(F.col("text").rlike(r"^#{1,6}\s"), T.stripped(F.regexp_replace(T.stripped(F.substring_index("text", "\n", 1)), "^#+", "")))
    return rows.withColumn("heading", F.nullif(F.last(own, ignorenulls=True).over(W.partitionBy("key").orderBy("block")), F.lit("")))


def snapshot_part(doc: str | Column, updated: str | Column, version: str | Column, body: str | Column) -> Column:
    """SUP-01, SUP-03: what a record adds to the fingerprint of a library."""
    c = lambda x: T.text(F.col(x) if isinstance(x, str) else x)
    return F.concat_ws("\x1f", c(doc), c(updated), c(version), T.content_hash(body))


def page_postings(pages: DataFrame) -> DataFrame:
    """SUP-02: postings of page texts (key, body), without weight for titles."""
    return pages.select("key", F.explode(T.search_tokens("body")).alias("token")).groupBy("token", "key").agg(F.count("*").alias("weight"))


def document_hits(hits: DataFrame, docs: DataFrame, words: list[str]) -> DataFrame:
    """SUP-05: hits (key, score) with a snippet from the whole text, else the title."""
    j = hits.join(docs.select("key", "title", "body"), "key")
    return j.select("key", "score", T.text("title").alias("title"), F.coalesce(F.when(T.text("body") != "", T.snippet("body", words)), T.text("title")).alias("snippet"))


def page_hits(hits: DataFrame, pages: DataFrame, names: DataFrame) -> DataFrame:
    """SUP-06: hits on pages with the file's name (the job's before the derived one) and its address."""
    j = hits.join(pages.select("key", "pdf_id", "page_index", "derived_name"), "key").join(names.select("pdf_id", "name").dropDuplicates(["pdf_id"]), "pdf_id", "left")
    route = F.concat(F.lit("#pdf/"), F.replace(F.url_encode("pdf_id"), F.lit("+"), F.lit("%20")), F.lit("/"), (F.col("page_index") + 1).cast("string"))
    return j.select("key", "score", "pdf_id", "page_index", F.coalesce("name", "derived_name", "pdf_id").alias("name"), route.alias("route"))


def search_message(words: list[str], n_indexed: int, n_hits: int) -> str:
    """SUP-07: what a search without hits says; nothing where there are some."""
    return "empty_query" if not words else "empty_library" if not n_indexed else "" if n_hits else "no_match"


def scope(ids: list[str | None] | None) -> list[str]:
    """SET-11: ids of a scope in order, once, without blanks; empty means all."""
    return list(dict.fromkeys(x.strip() for x in ids or [] if x and x.strip()))


def scoped_hits(postings: DataFrame, pages: DataFrame, question: str, wanted: list[str], top: int = 8) -> DataFrame:
    """SUP-89: the best hit of each page within a scope: one file is searched by itself, several are cut out of the best ``MOST_HITS`` of all."""
    ids = scope(wanted)
    if len(ids) == 1:
        pages = pages.where(F.col("pdf_id") == ids[0])
    hits = search.match(postings, question, "any").join(pages.select("key", "pdf_id", "page_index"), "key")
    ranked = hits.orderBy(F.desc("score"), "page_index", "key").limit(top if len(ids) == 1 else MOST_HITS)
    if len(ids) > 1:
        ranked = ranked.where(F.col("pdf_id").isin(ids))
    best = search.best_per_page(ranked)
    return best.orderBy(F.desc("score"), "pdf_id", "page_index", "key").limit(top).select("pdf_id", "page_index", "key", "score")


def expanded_snippet(body: str | Column, words: list[str]) -> Column:
    """SUP-94: a wide snippet for an answer's source."""
    return F.substring(T.snippet(body, words, 300), 1, 600)


def history_answer(answer: str | Column, pages: dict[int, int]) -> Column:
    """SUP-93: an earlier answer whose markers are pages mentioned before; unknown markers go, a list follows where none was known."""
    t = T.text(answer)
    known = F.lit(False)
    for n, page in pages.items():
        known = known | t.contains(f"[{n}]")
        t = F.replace(t, F.lit(f"[{n}]"), F.lit(f"（前文提到 第{page}页）"))
    t = F.regexp_replace(t, r"\[\d{1,3}\]", "")
    refs = "、".join(f"第{p}页" for p in dict.fromkeys(pages.values()))
    return F.when(known | F.lit(not pages), t).otherwise(F.concat(t, F.lit(f"（前文提到：{refs}）")))


def document_events(docs: DataFrame, versions: DataFrame) -> DataFrame:
    """SUP-55: one event a version (document_id, at, model), or one of the record itself without any."""
    v = versions.select("document_id", "at", "model")
    bare = docs.join(v.select("document_id").distinct(), "document_id", "left_anti").select("document_id", F.col("created_at").alias("at"), F.lit(None).cast("string").alias("model"))
    return v.join(docs.select("document_id"), "document_id", "left_semi").unionByName(bare)


def with_digest_events(events: DataFrame, digests: DataFrame) -> DataFrame:
    """SUP-56: document events and those of digests (digest_id, at, model), which count in usage only."""
    return events.withColumn("is_document", F.lit(True)).unionByName(digests.select(F.col("digest_id").alias("document_id"), "at", "model", F.lit(False).alias("is_document")))


def cached_state(flags: str | Column) -> Column:
    """SUP-58: true where any flag is, false where any is known, else null."""
    known = F.filter(F.col(flags) if isinstance(flags, str) else flags, lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.exists(known, lambda x: x))


def merge_plan_summary(merges: DataFrame, counts: DataFrame) -> DataFrame:
    """AGG-29: planned merges with the documents (tag, n_documents) of both sides."""
    n = counts.select("tag", "n_documents")
    j = merges.join(n.select(F.col("tag").alias("source"), F.col("n_documents").alias("n_source")), "source", "left").join(n.select(F.col("tag").alias("target"), F.col("n_documents").alias("n_target")), "target", "left")
    return j.select("suggestion_id", "source", "target", F.coalesce("n_source", F.lit(0)).alias("n_source"), F.coalesce("n_target", F.lit(0)).alias("n_target"))


def inference_report(inferences: DataFrame) -> DataFrame:
    """AGG-30: runs of a model: processed, with tags, failed, and tags given."""
    n = F.size(V.ordered_distinct("tags"))
    return inferences.groupBy("model").agg(F.count("*").alias("processed"), F.count_if(n > 0).alias("with_tags"), F.count_if(T.stripped(T.text("warning")) != "").alias("failed"), F.sum(n).alias("n_tags"))


def timing(runs: DataFrame, group: str, at: str, seconds: str) -> DataFrame:
    """AGG-31: seconds of a group's runs one after another, its seconds by the clock, and the speed-up; null where no time passed."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    span = F.max(micros) / 1e6 - F.min(micros) / 1e6
    return runs.groupBy(group).agg(F.count("*").alias("n"), F.round(F.sum(seconds), 3).alias("sequential_seconds"), F.round(span, 3).alias("wall_seconds"), F.round(F.try_divide(F.sum(seconds), span), 6).alias("speed_up"))


def price_table(raw: str | Column) -> Column:
    """ARR-32, SRC-23: (model, input, output, reasoning) of a JSON price list; negative prices and models without any are dropped, nonsense is empty."""
    c = F.col(raw) if isinstance(raw, str) else raw
    source = F.coalesce(F.get_json_object(c, "$.models"), c)
    models = F.coalesce(F.from_json(source, "map<string,string>"), F.create_map().cast("map<string,string>"))

    def priced(model: Column, values: Column) -> Column:
        fields = [
            F.coalesce(*(F.when(F.get_json_object(values, f"$.{k}").try_cast("double") >= 0, F.get_json_object(values, f"$.{k}").try_cast("double")) for k in ks), F.lit(None).cast("double")).alias(name)
            for name, ks in PRICES.items()
        ]
        return F.struct(model.alias("model"), *fields)

    rows = F.transform(F.map_entries(models), lambda e: priced(e["key"], e["value"]))
    return F.filter(rows, lambda r: (r["model"] != "currency") & F.coalesce(*(r[k] for k in PRICES)).isNotNull())
