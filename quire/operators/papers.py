"""Bibliographic fields, reference lists and citation graphs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T


def doi_in(c: str | Column) -> Column:
    """STR-39: first DOI of a text, in canonical form."""
    d = F.regexp_extract(T.text(c), r"(10\.\d{4,9}/[^\s,;]+)", 1)
    return F.when(d != "", T.doi_key(d))


def year_in(c: str | Column) -> Column:
    """STR-40, SUP-24: the year in parentheses, else the last year of the line outside a DOI."""
    t = F.regexp_replace(T.text(c), r"10\.\d{4,9}/[^\s,;]+", " ")
    inner = F.regexp_extract(t, r"\(((?:19|20)\d\d)[a-z]?\)", 1)
    years = F.regexp_extract_all(t, F.lit(r"\b((?:19|20)\d\d)\b"), F.lit(1))
    return F.when(inner != "", inner.cast("int")).otherwise(F.try_element_at(years, F.lit(-1)).cast("int"))


def unique_keys(entries: DataFrame, key: Column, name: str) -> DataFrame:
    """SUP-21: keys of one document only; a key of two documents is ambiguous and left out."""
    rows = entries.select("document_id", key.alias(name)).where(F.length(name) > 0).distinct()
    return rows.groupBy(name).agg(F.min("document_id").alias("doc"), F.count("*").alias("n")).where("n = 1").select(name, "doc")


def resolve(references: DataFrame, entries: DataFrame) -> DataFrame:
    """JOIN-14, JOIN-15: (ref_id, citing_id, doc, matched_by) by DOI, else by title; ambiguity matches nothing.

    ``references`` has ref_id, citing_id, doi and title; both indexes are joined by shuffle or
    broadcast as their size allows.
    """
    by_doi = unique_keys(entries, T.doi_key("doi"), "doi_k").withColumnRenamed("doc", "doc_doi")
    by_title = unique_keys(entries, T.title_key("title"), "title_k").withColumnRenamed("doc", "doc_title")
    r = references.withColumn("doi_k", F.nullif(T.doi_key("doi"), F.lit(""))).withColumn("title_k", F.nullif(T.title_key("title"), F.lit("")))
    j = r.join(by_doi, "doi_k", "left").join(by_title, "title_k", "left")
    how = F.when(F.col("doc_doi").isNotNull(), "doi").when(F.col("doc_title").isNotNull(), "title")
    return j.select("ref_id", "citing_id", F.coalesce("doc_doi", "doc_title").alias("doc"), how.alias("matched_by"))


def titles_in(references: DataFrame, entries: DataFrame) -> DataFrame:
    """(ref_id, title) of references (ref_id, raw): the longest run of parts that is one document's title.

    Parts end at commas, full stops, years and line ends, so every style of reference is covered.
    """
    t = F.regexp_replace(T.text("raw"), r"(?i)(?:doi[:\s]*|https?://\S*?/)?10\.\d{4,9}/[^\s,;]+", " ")
    t = F.regexp_replace(t, r"^\s*(?:\[\w+\]|\d{1,3}\.)\s+", "")
    t = F.regexp_replace(t, r"(\(?\b(?:19|20)\d\d[a-z]?\)?[.,:]?)\s+", "\u0001$1\u0001")
    # a part's number belongs to the title before it
    t = F.regexp_replace(t, r"([.,]+[”\"]?)\s+(?!(?i:part)\b)|\s*\n\s*", "$1\u0001")
    parts = F.split(t, "\u0001+")
    n = F.size("parts")
    runs = F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.array_join(F.slice("parts", i, k), " ")))
    rows = references.select("ref_id", parts.alias("parts")).select("ref_id", F.explode(F.array_distinct(F.flatten(runs))).alias("title"))
    hits = rows.withColumn("title_k", T.title_key("title")).join(unique_keys(entries, T.title_key("title"), "title_k"), "title_k")
    return hits.groupBy("ref_id").agg(F.max_by("title", F.struct(F.length("title_k"), "title_k")).alias("title"))


def citation_edges(resolved: DataFrame) -> DataFrame:
    """JOIN-16: distinct (source, target, matched_by), without self-citations."""
    return resolved.where("doc is not null and doc <> citing_id").select(F.col("citing_id").alias("source"), F.col("doc").alias("target"), "matched_by").distinct()


def citation_nodes(edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("source").alias("id")).agg(F.countDistinct("target").alias("cites"))
    into = edges.groupBy(F.col("target").alias("id")).agg(F.countDistinct("source").alias("cited_by"))
    return out.join(into, "id", "full_outer").select("id", F.coalesce("cites", F.lit(0)).alias("cites"), F.coalesce("cited_by", F.lit(0)).alias("cited_by"))


def headings(papers: DataFrame, body: str = "full_text") -> DataFrame:
    """STR-49, WIN-13: numbered headings of the texts, in order, with level 1."""
    lines = papers.select("document_id", F.posexplode(F.split(body, "\n")).alias("line", "text"))
    m = lines.where(F.col("text").rlike(r"^\d{1,2} \S") & (F.length("text") <= 120))
    return m.select("document_id", "line", F.regexp_extract("text", r"^(\d{1,2}) ", 1).cast("int").alias("number"), F.trim(F.regexp_extract("text", r"^\d{1,2} (.*)$", 1)).alias("heading"))


def text_routing(papers: DataFrame, body: str = "full_text", page_chars: int = 3000, page_min: int = 60, total_min: int = 200, ratio_min: float = 0.3) -> DataFrame:
    """PRJ-11, PRJ-12: whether a document's text suffices, and the first reason if not."""
    pages = papers.select("document_id", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(T.text(body)) / page_chars) - 1))).alias("page"), T.text(body).alias("t"))
    chars = T.visible_chars(F.substring("t", (F.col("page") * page_chars + 1).cast("int"), F.lit(page_chars)))
    per = pages.select("document_id", chars.alias("n")).groupBy("document_id").agg(F.sum("n").alias("chars"), F.count_if(F.col("n") >= page_min).alias("text_pages"), F.count("*").alias("pages"))
    why = F.when(F.col("chars") < total_min, "too_few_chars").when(F.col("text_pages") == 0, "no_text_page").when(F.col("text_pages") / F.col("pages") < ratio_min, "low_ratio")
    return per.select("document_id", "chars", "text_pages", "pages", F.when(why.isNull(), "text-layer").otherwise("vlm").alias("route"), why.alias("reason"))


def split_references(papers: DataFrame, column: str = "references_text") -> DataFrame:
    """STR-45, STR-47, WIN-16..18: (document_id, ref_index, raw) of reference sections.

    Entries begin at a number or at a blank line; wrapped lines are joined, hyphens at line ends
    removed; an entry without a year goes to the one before.
    """
    import re

    start = re.compile(r"^\s*(?:\[\w+\]|\d{1,3}\.)\s+")
    year = re.compile(r"(?:19|20)\d\d")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["document_id"], pdf[column]):
                entries: list[str] = []
                numbered = sum(bool(start.match(x)) for x in text.split("\n")) >= 2
                fresh = True
                for line in text.split("\n"):
                    if not line.strip():
                        fresh = True
                        continue
                    begins = bool(start.match(line)) if numbered else fresh
                    if begins or not entries:
                        entries.append(line.strip())
                    else:
                        last = entries[-1]
                        entries[-1] = last[:-1] + line.strip() if re.search(r"[a-z]-$", last) else last + " " + line.strip()
                    fresh = False
                merged: list[str] = []
                for e in entries:
                    if merged and not numbered and not year.search(e):
                        merged[-1] += " " + e
                    else:
                        merged.append(e)
                rows += [(doc, i, e) for i, e in enumerate(merged, 1)]
            yield pd.DataFrame(rows, columns=["document_id", "ref_index", "raw"])

    docs = papers.where(F.length(F.trim(column)) > 0).select("document_id", column).dropDuplicates(["document_id"])
    return docs.mapInPandas(work, "document_id string, ref_index int, raw string")
