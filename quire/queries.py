"""Queries of the core operators, and the SQL that DuckDB checks them with.

Every query runs over whole tables. Where a result cannot be said in SQL (format mixtures, block
diffs, chains of merges) there is none; the tests compare those with brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import values as V
from quire.operators import details, diff, governance, library, papers, search, similarity, timeline, timestamps, versions
from quire.plans import fingerprints
from quire.session import cut, load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_HAN = "\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}"
_WIDE, _NARROW = T.WIDE, T.NARROW.replace("'", "''")
#: Views that the SQL starts from: the latest row of each document, and those not merged away.
_LIB = """WITH cur AS (SELECT DISTINCT ON (document_id) * FROM library_records ORDER BY document_id, received_at DESC),
 lib AS (SELECT * FROM cur WHERE length(trim(coalesce(merged_into, ''))) = 0)
"""


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s　 ]+|[\\s　 ]+$', '', 'g')"


def _distinct(c: str) -> str:
    """Order-preserving distinct of trimmed labels."""
    x = f"list_filter(list_transform(coalesce({c}, []), lambda v: {_strip("coalesce(v, '')")}), lambda v: v <> '')"
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def _tokens(c: str) -> str:
    runs = f"regexp_extract_all(coalesce({c}, ''), '[{_HAN}]+')"
    return (
        f"list_concat(list_transform(regexp_extract_all(coalesce({c}, ''), '[A-Za-z0-9_]+'), lambda w: lower(w)), "
        f"flatten(list_transform({runs}, lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i::INT, 2)) END)))"
    )


def _live(s: SparkSession, d: str) -> DataFrame:
    return library.live(load(s, d, "library_records"))


def _keyed(s: SparkSession, d: str) -> DataFrame:
    return _live(s, d).select(F.col("document_id").alias("key"), F.col("current_markdown").alias("body"), "title", "pdf_id", "page_index", "updated_at")


# scans and views ---------------------------------------------------------------------------------


@query(_LIB + "SELECT document_id, title, updated_at FROM lib")
def src_live_documents(s, d):
    return _live(s, d).select("document_id", "title", "updated_at")


@query(_LIB + "SELECT document_id, merged_into FROM cur WHERE length(trim(coalesce(merged_into, ''))) > 0")
def src_archived(s, d):
    return library.current(load(s, d, "library_records")).where(library.archived()).select("document_id", "merged_into")


@query(_LIB + "SELECT document_id, substr(sha256(coalesce(current_markdown, '')), 1, 16) AS content_hash FROM cur")
def src_document_hashes(s, d):
    return library.current(load(s, d, "library_records")).select("document_id", T.content_hash("current_markdown").alias("content_hash"))


@query("""SELECT document_id, any_value(title) AS title, coalesce(any_value(doi), '') AS doi FROM (SELECT DISTINCT document_id, title, doi FROM library_entries) GROUP BY document_id""")
def src_paper_entries(s, d):
    e = load(s, d, "library_entries").select("document_id", "title", "doi").distinct()
    return e.groupBy("document_id").agg(F.any_value("title").alias("title"), F.coalesce(F.any_value("doi"), F.lit("")).alias("doi"))


@query("""SELECT turn_id, count(*) AS n_sources, count(DISTINCT document_id) AS n_documents, min(source_index) AS first_index
FROM (SELECT DISTINCT ON (source_id) * FROM qa_sources) GROUP BY turn_id""")
def src_qa_turns(s, d):
    q = load(s, d, "qa_sources").dropDuplicates(["source_id"])
    return q.groupBy("turn_id").agg(F.count("*").alias("n_sources"), F.countDistinct("document_id").alias("n_documents"), F.min("source_index").alias("first_index"))


@query("""SELECT job_id, CASE WHEN status IN ('queued', 'processing') THEN 'interrupted' ELSE status END AS status, model
FROM (SELECT DISTINCT ON (job_id) * FROM jobs ORDER BY job_id, received_at DESC)""")
def src_jobs_recovered(s, d):
    j = load(s, d, "jobs").groupBy("job_id").agg(F.max_by(F.struct("status", "model"), "received_at").alias("r"))
    return j.select("job_id", F.when(F.col("r.status").isin("queued", "processing"), "interrupted").otherwise(F.col("r.status")).alias("status"), "r.model")


@query(_LIB + f"SELECT document_id FROM lib WHERE list_contains(tags, 'graph theory')")
def prj_faceted(s, d):
    return library.faceted(_live(s, d), tag="graph theory").select("document_id")


@query(_LIB + f"""SELECT document_id, list_filter([CASE WHEN len({_distinct('topics')}) = 0 THEN 'no_topic' END, CASE WHEN len({_distinct('tags')}) = 0 THEN 'no_tag' END,
 CASE WHEN len(list_filter([metadata.document_time.confidence, metadata.capture_time.confidence, metadata.import_time.confidence], lambda c: lower(c) IN ('low', '低', 'degraded', 'needs_review', '待复核'))) > 0 THEN 'low_confidence' END], lambda r: r IS NOT NULL) AS reasons,
 coalesce(title, '') AS title FROM lib WHERE len(reasons) > 0""")
def prj_inbox(s, d):
    return library.inbox(_live(s, d))


@query(_LIB + f"""SELECT reason, count(*) AS n_documents FROM (SELECT unnest(list_filter([CASE WHEN len({_distinct('topics')}) = 0 THEN 'no_topic' END, CASE WHEN len({_distinct('tags')}) = 0 THEN 'no_tag' END,
 CASE WHEN len(list_filter([metadata.document_time.confidence, metadata.capture_time.confidence, metadata.import_time.confidence], lambda c: lower(c) IN ('low', '低', 'degraded', 'needs_review', '待复核'))) > 0 THEN 'low_confidence' END], lambda r: r IS NOT NULL)) AS reason FROM lib) GROUP BY reason""")
def agg_inbox_reasons(s, d):
    return library.reason_histogram(_live(s, d))


@query(_LIB + """SELECT document_id, CASE WHEN length(source_pdf) > 0 OR length(pdf_id) > 0 THEN 'pdf' ELSE 'document' END AS source_kind FROM lib""")
def prj_source_kind(s, d):
    return library.card(_live(s, d)).select("document_id", "source_kind")


@query("""SELECT document_id, chars, text_pages, pages, CASE WHEN chars < 200 OR text_pages = 0 OR text_pages / pages < 0.3 THEN 'vlm' ELSE 'text-layer' END AS route,
 CASE WHEN chars < 200 THEN 'too_few_chars' WHEN text_pages = 0 THEN 'no_text_page' WHEN text_pages / pages < 0.3 THEN 'low_ratio' END AS reason
FROM (SELECT document_id, sum(n) AS chars, count(*) FILTER (n >= 60) AS text_pages, count(*) AS pages FROM (
 SELECT document_id, length(regexp_replace(substr(t, (p * 3000 + 1)::INT, 3000), '\\s+', '', 'g')) AS n FROM (
  SELECT document_id, t, unnest(range(0, greatest(1, ceil(length(t) / 3000))::BIGINT)) AS p FROM (SELECT DISTINCT document_id, coalesce(full_text, '') AS t FROM papers))) GROUP BY document_id)""")
def prj_text_routing(s, d):
    return papers.text_routing(load(s, d, "papers").dropDuplicates(["document_id"]))


# search ------------------------------------------------------------------------------------------


_POSTINGS = _LIB + f""", post AS (SELECT token, key, sum(w) AS weight FROM (
 SELECT document_id AS key, unnest({_tokens('current_markdown')}) AS token, 1 AS w FROM lib
 UNION ALL SELECT document_id, unnest({_tokens('title')}), 2 FROM lib) GROUP BY token, key)
"""


@query(_POSTINGS + "SELECT token, key, weight::BIGINT AS weight FROM post")
def agg_search_postings(s, d):
    return search.postings(_keyed(s, d))


@query(_LIB + f"SELECT document_id AS key, (len({_tokens('current_markdown')}) + 2 * len({_tokens('title')}))::INT AS length FROM lib")
def agg_search_lengths(s, d):
    return search.lengths(_keyed(s, d))


@query(_POSTINGS + "SELECT key, sum(weight)::BIGINT AS score FROM post WHERE token IN ('graph', 'baseline') GROUP BY key HAVING count(*) = 2")
def join_search_all(s, d):
    return search.match(search.postings(_keyed(s, d)), "Graph baseline")


@query(_POSTINGS + "SELECT key, sum(weight)::BIGINT AS score FROM post WHERE token IN ('节点', 'glacier') GROUP BY key")
def join_search_any(s, d):
    return search.match(search.postings(_keyed(s, d)), "节点 glacier", "any")


@query(_POSTINGS + "SELECT key, sum(weight)::BIGINT AS score FROM post WHERE token IN ('the', 'is') GROUP BY key HAVING count(*) = 2 ORDER BY score DESC, key LIMIT 50")
def sort_search_top(s, d):
    return search.top(search.match(search.postings(_keyed(s, d)), "the is"), "key")


@query(_POSTINGS + """SELECT pdf_id, page_index, key, score FROM (SELECT pdf_id, page_index, key, score, row_number() OVER (PARTITION BY pdf_id, page_index ORDER BY score DESC, key) AS n
 FROM (SELECT key, sum(weight)::BIGINT AS score FROM post WHERE token IN ('note', 'page') GROUP BY key) h JOIN (SELECT document_id AS key, pdf_id, page_index FROM lib WHERE pdf_id IS NOT NULL) USING (key)) WHERE n = 1""")
def win_best_hit_per_page(s, d):
    docs = _keyed(s, d)
    hits = search.match(search.postings(docs), "note page", "any").join(docs.where("pdf_id is not null").select("key", "pdf_id", "page_index"), "key")
    return search.best_per_page(hits).select("pdf_id", "page_index", "key", "score")


@query(_POSTINGS + """SELECT pdf_id, count(*) AS n_hits, count(DISTINCT page_index) AS n_pages FROM (SELECT key FROM post WHERE token = 'matrix') JOIN (SELECT document_id AS key, pdf_id, page_index FROM lib WHERE pdf_id IS NOT NULL) USING (key) GROUP BY pdf_id""")
def agg_hits_per_pdf(s, d):
    docs = _keyed(s, d)
    hits = search.match(search.postings(docs), "matrix").join(docs.where("pdf_id is not null").select("key", "pdf_id", "page_index"), "key")
    return hits.groupBy("pdf_id").agg(F.count("*").alias("n_hits"), F.countDistinct("page_index").alias("n_pages"))


@query(_LIB + """SELECT document_id, CASE WHEN hit IS NULL THEN first_part ELSE (CASE WHEN a > 1 THEN '…' ELSE '' END) || regexp_replace(replace(substr(t, a, e - a + 1), chr(10), ' '), '^\\s+|\\s+$', '', 'g') || (CASE WHEN e < length(t) THEN '…' ELSE '' END) END AS snippet
FROM (SELECT document_id, t, hit, greatest(hit - 72, 1) AS a, least(hit + 71, length(t)) AS e, regexp_replace(replace(substr(t, 1, 144), chr(10), ' '), '^\\s+|\\s+$', '', 'g') AS first_part
 FROM (SELECT document_id, coalesce(current_markdown, '') AS t, nullif(instr(lower(coalesce(current_markdown, '')), 'harbour'), 0) AS hit FROM lib))""")
def str_snippets(s, d):
    return _live(s, d).select("document_id", T.snippet("current_markdown", ["harbour"]).alias("snippet"))


# text functions ----------------------------------------------------------------------------------


@query(_LIB + f"SELECT document_id, {_tokens('title')} AS tokens FROM lib")
def str_search_tokens(s, d):
    return _live(s, d).select("document_id", T.search_tokens("title").alias("tokens"))


_PLAIN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '```.*?```', ' ', 'gs'), '`[^`]*`', ' ', 'g'), '!\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), 'https?://\\S+', ' ', 'g')"
_SIM = "regexp_extract_all(lower(" + _PLAIN.replace("{0}", "coalesce({0}, '')") + f"), '[0-9a-z]+|[{_HAN}\\x{{3040}}-\\x{{30ff}}\\x{{ac00}}-\\x{{d7af}}]')"


@query(_LIB + "SELECT document_id, len(" + _SIM.replace("{0}", "current_markdown") + ")::INT AS n_tokens FROM lib")
def str_similarity_tokens(s, d):
    return _live(s, d).select("document_id", F.size(T.similarity_tokens("current_markdown", None)).alias("n_tokens"))


@query("""SELECT document_id, coalesce(regexp_extract(t, '(10\\.\\d{4,9}/[^\\s,;]+)', 1), '') AS doi_raw FROM (SELECT DISTINCT document_id, coalesce(doi, '') AS t FROM library_entries)""")
def str_doi_raw(s, d):
    e = load(s, d, "library_entries").select("document_id", T.text("doi").alias("t")).distinct()
    return e.select("document_id", F.regexp_extract("t", r"(10\.\d{4,9}/[^\s,;]+)", 1).alias("doi_raw"))


_DOI = "regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce({0}, ''))), '^(https?://[^/]*/|doi[:\\s]\\s*)+', ''), '^[\\[(<{{]+', ''), '[\\])>}}.,;:\\s]+$', '')"
_TITLE = f"trim(regexp_replace(replace(lower(coalesce({{0}}, '')), '&', ' and '), '[^0-9a-z{_HAN}]+', ' ', 'g'))".replace("{3400}", "{{3400}}").replace("{4dbf}", "{{4dbf}}").replace("{4e00}", "{{4e00}}").replace("{9fff}", "{{9fff}}").replace("{f900}", "{{f900}}").replace("{faff}", "{{faff}}")


@query("SELECT DISTINCT document_id, " + _DOI.format("doi") + " AS doi_key, " + _TITLE.format("title") + " AS title_key FROM library_entries")
def str_bibliographic_keys(s, d):
    return load(s, d, "library_entries").select("document_id", T.doi_key("doi").alias("doi_key"), T.title_key("title").alias("title_key")).distinct()


_TAGKEY = f"nullif(lower(trim(regexp_replace(regexp_replace(regexp_replace(translate(coalesce({{0}}, ''), '{_WIDE}', '{_NARROW}'), '^[\\s ]+|[\\s ]+$', '', 'g'), '^#+', ''), '[\\s _\\-./|]+', ' ', 'g'))), '')"


def _tagkey(c: str) -> str:
    return _TAGKEY.replace("{0}", c)


@query("SELECT DISTINCT source AS raw, " + _tagkey("source") + " AS tag_key FROM tag_merges WHERE source IS NOT NULL")
def str_tag_keys(s, d):
    return load(s, d, "tag_merges").where("source is not null").select(F.col("source").alias("raw"), T.tag_key("source").alias("tag_key")).distinct()


@query("""SELECT collection_id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(collection_name), '\\s+', '-', 'g'), '[^0-9A-Za-z_\\-""" + _HAN + """]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')) AS slug,
 regexp_replace(regexp_replace(collection_name, '[^0-9A-Za-z_.\\-""" + _HAN + """]+', '_', 'g'), '^_+|_+$', '', 'g') AS vault_name,
 regexp_replace(regexp_replace(regexp_replace(collection_id, '[^A-Za-z0-9._-]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS file_id FROM collection_registry""")
def str_safe_names(s, d):
    return load(s, d, "collection_registry").select("collection_id", T.slug("collection_name").alias("slug"), T.vault_name("collection_name").alias("vault_name"), T.file_id("collection_id").alias("file_id"))


@query(_LIB + f"""SELECT document_id, length(regexp_replace(coalesce(current_markdown, ''), '[\\s ]+', '', 'g'))::INT AS visible_chars, ceil(length(coalesce(current_markdown, '')) / 1.5)::BIGINT AS prompt_tokens,
 substr(sha256(coalesce(current_markdown, '')), 1, 16) AS content_hash FROM lib""")
def str_measures(s, d):
    return _live(s, d).select("document_id", T.visible_chars("current_markdown").alias("visible_chars"), T.prompt_tokens("current_markdown").alias("prompt_tokens"), T.content_hash("current_markdown").alias("content_hash"))


@query(_LIB + """SELECT document_id, CASE WHEN length(t) <= 240 THEN t ELSE substr(t, 1, 239) || '…' END AS excerpt, CASE WHEN length(p) <= 80 THEN p ELSE substr(p, 1, 79) || '…' END AS preview
FROM (SELECT document_id, """ + _strip("coalesce(current_markdown, '')") + """ AS t, """ + _strip("regexp_replace(coalesce(current_markdown, ''), '[\\s　 ]+', ' ', 'g')") + """ AS p FROM lib)""")
def str_excerpts(s, d):
    return _live(s, d).select("document_id", T.excerpt("current_markdown").alias("excerpt"), T.preview("current_markdown").alias("preview"))


@query(_LIB + """SELECT document_id, regexp_extract_all(coalesce(current_markdown, ''), '\\]\\(([^)\\s]+)\\)', 1) AS targets FROM lib""")
def str_reference_targets(s, d):
    return _live(s, d).select("document_id", T.reference_targets("current_markdown").alias("targets"))


@query(_LIB + """SELECT document_id, substr(regexp_replace(regexp_replace(coalesce(list_filter(list_transform(string_split(regexp_replace(coalesce(current_markdown, ''), '```.*?(```|$)', chr(10), 'gs'), chr(10)), lambda x: """ + _strip("x") + """), lambda x: x <> '')[1], ''), '^#{1,6}\\s+', ''), '\\s+#+$', ''), 1, 200) AS headline FROM lib""")
def str_headlines(s, d):
    return _live(s, d).select("document_id", T.headline("current_markdown").alias("headline"))


# facets, vocabulary, graph -----------------------------------------------------------------------


@query(_LIB + f"SELECT tag, count(*) AS n_documents FROM (SELECT unnest({_distinct('tags')}) AS tag FROM lib) GROUP BY tag")
def agg_tag_facets(s, d):
    return library.facet_counts(_live(s, d), "tags", "tag")


@query(_LIB + f"SELECT topic, count(*) AS n_documents FROM (SELECT unnest({_distinct('topics')}) AS topic FROM lib) GROUP BY topic")
def agg_topic_facets(s, d):
    return library.facet_counts(_live(s, d), "topics", "topic")


@query(_LIB + f"""SELECT collection_id, collection_name, count(c) AS n_documents FROM collection_registry LEFT JOIN (SELECT unnest({_distinct('collections')}) AS c FROM lib) ON c = collection_id GROUP BY ALL""")
def agg_collection_counts(s, d):
    return library.collection_counts(_live(s, d), load(s, d, "collection_registry")).drop("slug")


@query(_LIB + f"""SELECT coalesce(({_distinct('topics')})[1], '(unclustered)') AS bucket, count(*) AS n_documents, min(document_id) AS first_id FROM lib GROUP BY 1""")
def agg_topic_clusters(s, d):
    return library.first_topic(_live(s, d))


@query(_LIB + f""", keys AS (SELECT k, min(tag) AS tag FROM (SELECT tag, {_tagkey('name')} AS k FROM (SELECT tag, unnest(list_concat([tag], coalesce(aliases, []))) AS name FROM tag_vocabulary)) WHERE k IS NOT NULL GROUP BY k),
 used AS (SELECT DISTINCT document_id, tag FROM (SELECT document_id, {_tagkey('t')} AS k FROM (SELECT document_id, unnest({_distinct('tags')}) AS t FROM lib)) JOIN keys USING (k))
SELECT v.tag, list_sort(v.aliases) AS aliases, count(u.document_id) AS n_documents FROM tag_vocabulary v LEFT JOIN used u ON u.tag = v.tag GROUP BY ALL""")
def agg_vocabulary_counts(s, d):
    return library.vocabulary_counts(_live(s, d), load(s, d, "tag_vocabulary"))


@query("SELECT coalesce(tag_group, '(ungrouped)') AS tag_group, list_sort(list(DISTINCT tag)) AS tags, count(*) AS n_tags FROM tag_vocabulary GROUP BY 1")
def arr_tag_groups(s, d):
    return library.tag_groups(load(s, d, "tag_vocabulary"))


@query("""WITH m AS (SELECT DISTINCT ON (suggestion_id) suggestion_id, source, target FROM tag_merges)
SELECT suggestion_id, 'unknown_source' AS error FROM m WHERE source NOT IN (SELECT tag FROM tag_vocabulary) OR source IS NULL
UNION ALL SELECT suggestion_id, 'unknown_target' FROM m WHERE target NOT IN (SELECT tag FROM tag_vocabulary) OR target IS NULL
UNION ALL SELECT suggestion_id, 'self_merge' FROM m WHERE source = target
UNION ALL SELECT suggestion_id, 'duplicate_source' FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM m) WHERE n > 1
UNION ALL SELECT suggestion_id, 'cycle' FROM m WHERE source <> target AND EXISTS (SELECT 1 FROM m x WHERE x.source = m.target AND x.target = m.source)""")
def arr_merge_plan_errors(s, d):
    return library.merge_plan_errors(load(s, d, "tag_merges").dropDuplicates(["suggestion_id"]), load(s, d, "tag_vocabulary"))


@query()
def arr_merged_tags(s, d):
    return library.merge_tags(_live(s, d), load(s, d, "tag_merges").dropDuplicates(["suggestion_id"]))


_REL = """rel AS (SELECT DISTINCT least(document_id, target) AS a, greatest(document_id, target) AS b FROM (
 SELECT document_id, trim(r.target) AS target, r.source AS src FROM (SELECT document_id, unnest(manual_relations) AS r FROM lib)) WHERE (src = 'manual' OR src IS NULL) AND length(target) > 0 AND target <> document_id)
"""


@query(_LIB + "," + _REL + "SELECT a, b FROM rel")
def arr_relations(s, d):
    return library.relations(_live(s, d))


_EDGES = _LIB + "," + _REL + f""", edges AS (SELECT 'topic' AS kind, 'document:' || document_id AS from_id, 'topic:' || unnest({_distinct('topics')}) AS to_id FROM lib
 UNION ALL SELECT 'tag', 'document:' || document_id, 'tag:' || unnest({_distinct('tags')}) FROM lib
 UNION ALL SELECT 'collection', 'document:' || document_id, 'collection:' || unnest({_distinct('collections')}) FROM lib
 UNION ALL SELECT 'manual', 'document:' || a, 'document:' || b FROM rel WHERE a IN (SELECT document_id FROM lib) AND b IN (SELECT document_id FROM lib))
"""


@query(_EDGES + "SELECT kind, from_id, to_id FROM edges")
def arr_graph_edges(s, d):
    return library.graph_edges(_live(s, d))


@query(_EDGES + "SELECT node_id, count(*) AS degree FROM (SELECT unnest([from_id, to_id]) AS node_id FROM edges) GROUP BY node_id")
def agg_graph_degrees(s, d):
    return library.degrees(library.graph_edges(_live(s, d)))


@query(_LIB + """SELECT document_id, """ + _distinct("list_transform(coalesce(manual_collections, []), lambda x: CASE WHEN x = 'col-00' THEN 'col-01' ELSE x END)") + """ AS manual_collections,
 """ + _distinct("list_transform(coalesce(auto_collections, []), lambda x: CASE WHEN x = 'col-00' THEN 'col-01' ELSE x END)") + """ AS auto_collections FROM lib""")
def snk_collection_rename(s, d):
    return library.collection_remap(_live(s, d), "col-00", "col-01")


@query(_LIB + f"SELECT document_id, {_distinct('list_concat(coalesce(manual_collections, []), coalesce(auto_collections, []))')} AS collections FROM lib")
def arr_memberships(s, d):
    return _live(s, d).select("document_id", V.memberships("manual_collections", "auto_collections").alias("collections"))


@query(_LIB + f"SELECT document_id, list_sort({_distinct('list_concat(coalesce(topics, []), coalesce(tags, []))')}) AS labels FROM lib")
def set_labels(s, d):
    return _live(s, d).select("document_id", V.labels("topics", "tags").alias("labels"))


@query(_LIB + """SELECT pdf_id, unnest(range(prev + 1, page_number)) AS missing_page FROM (SELECT pdf_id, page_number, lag(page_number) OVER (PARTITION BY pdf_id ORDER BY page_number) AS prev
 FROM (SELECT DISTINCT pdf_id, page_number FROM lib WHERE page_number IS NOT NULL AND length(pdf_id) > 0)) WHERE page_number > prev + 1""")
def agg_missing_pages(s, d):
    return library.missing_pages(_live(s, d))


@query(_LIB + """SELECT source_key, document_id AS a, next_id AS b, position FROM (SELECT *, lead(document_id) OVER w AS next_id, lead(position) OVER w AS next_position FROM (
 SELECT document_id, CASE WHEN length(pdf_id) > 0 THEN pdf_id WHEN length(source_pdf) > 0 THEN source_pdf END AS source_key, coalesce(page_index, page_number - 1) AS position FROM lib) WHERE source_key IS NOT NULL AND position IS NOT NULL
 WINDOW w AS (PARTITION BY source_key ORDER BY position, document_id)) WHERE next_position = position + 1""")
def join_adjacent_pages(s, d):
    return library.adjacent_pages(_live(s, d))


# time --------------------------------------------------------------------------------------------


def _items(fallback: bool) -> str:
    chain = "CASE " + " ".join(f"WHEN metadata.{x}.value <> '' THEN {{'field': '{x}', 'value': metadata.{x}.value, 'source': coalesce(nullif(metadata.{x}.source, ''), '{x}')}}" for x in V.SLOTS)
    if fallback:
        chain += " WHEN length(created_at) > 0 THEN {'field': 'import_time', 'value': created_at, 'source': 'import_fallback'}"
    return _LIB + f""", items AS (SELECT *, CASE WHEN day IS NULL THEN NULL ELSE strftime(day, '%G-W%V') END AS week FROM (SELECT document_id, coalesce(title, '') AS title, e.field AS field, e.value AS value, e.source AS source,
 CASE WHEN regexp_full_match(substr(e.value, 1, 10), '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast(substr(e.value, 1, 10) AS DATE) END AS day, {_distinct('topics')} AS topics, {_distinct('tags')} AS tags
 FROM (SELECT *, {chain} END AS e FROM lib)))
"""


def _dated(s: SparkSession, d: str, fallback: str | None = None) -> DataFrame:
    return timeline.dated(_live(s, d), fallback)


@query(_items(False) + "SELECT document_id, field, value, source, day, week FROM items")
def date_effective(s, d):
    return _dated(s, d).select("document_id", "field", "value", "source", "day", "week")


@query(_items(True) + "SELECT document_id, field, value, source FROM items")
def date_effective_digest(s, d):
    return _dated(s, d, "created_at").select("document_id", "field", "value", "source")


@query(_items(False) + """SELECT day, n_documents, first_id, greatest(0, date_diff('day', lag(day) OVER (ORDER BY day), day) - 1) AS gap_days FROM (SELECT day, count(*) AS n_documents, min(document_id) AS first_id FROM items WHERE day IS NOT NULL GROUP BY day)""")
def win_day_groups(s, d):
    # one row per day remains, so the global order is over a bounded calendar
    return timeline.day_groups(_dated(s, d)).select("day", "n_documents", "first_id", "gap_days")


@query(_items(False) + """SELECT week, min(date_trunc('week', day))::DATE AS starts, max(date_trunc('week', day) + INTERVAL 6 DAY)::DATE AS ends, count(*) AS n_documents FROM items WHERE day IS NOT NULL GROUP BY week""")
def win_week_groups(s, d):
    return timeline.week_groups(_dated(s, d))


@query(_items(False) + """SELECT month, n_documents, first_day, round(n_documents / max(n_documents) OVER (), 6) AS density FROM (SELECT strftime(day, '%Y-%m') AS month, count(*) AS n_documents, min(day) AS first_day FROM items WHERE day IS NOT NULL GROUP BY 1)""")
def agg_monthly_density(s, d):
    return timeline.monthly_density(_dated(s, d))


@query(_items(False) + """SELECT week, topic, min(i)::INT AS first_index, count(*) AS length, min_by(document_id, i) AS first_id FROM (SELECT *, i - row_number() OVER (PARTITION BY week, topic ORDER BY i) AS island FROM (
 SELECT week, document_id, i, unnest(topics) AS topic FROM (SELECT *, row_number() OVER (PARTITION BY week ORDER BY day, value, document_id) AS i FROM items WHERE day IS NOT NULL))) GROUP BY week, topic, island HAVING count(*) > 1""")
def win_topic_runs(s, d):
    return timeline.topic_runs(_dated(s, d))


@query(_items(False) + """SELECT week, topic, count(DISTINCT document_id) AS n_documents FROM (SELECT week, document_id, unnest(topics) AS topic FROM items WHERE day IS NOT NULL) GROUP BY ALL""")
def agg_timeline_topics(s, d):
    return timeline.topic_aggregates(_dated(s, d))


@query(_items(True) + "SELECT document_id, day FROM items WHERE day BETWEEN DATE '2023-01-01' AND DATE '2023-06-30'")
def date_range_filter(s, d):
    return timeline.in_range(_dated(s, d, "created_at"), "2023-01-01", "2023-06-30").select("document_id", "day")


@query(_items(True) + """, x AS (SELECT document_id, day, list_concat(topics, tags) AS labels FROM items WHERE day IS NOT NULL),
 newest AS (SELECT document_id, day FROM x ORDER BY day DESC, document_id DESC LIMIT 60),
 promised AS (SELECT DISTINCT document_id, day FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY day DESC, document_id DESC) AS n FROM (SELECT DISTINCT document_id, day, unnest(labels) AS label FROM x)) WHERE n <= 2),
 p AS (SELECT * FROM promised ORDER BY day DESC, document_id DESC LIMIT 60)
SELECT document_id, day, guaranteed FROM (SELECT document_id, day, document_id IN (SELECT document_id FROM p) AS guaranteed FROM (SELECT * FROM newest UNION SELECT * FROM p)) ORDER BY guaranteed DESC, day DESC, document_id DESC LIMIT 60""")
def win_digest_budget(s, d):
    return timeline.budget(_dated(s, d, "created_at"))


# usage -------------------------------------------------------------------------------------------


_USE = """WITH u AS (SELECT event_id, ts, user_id, event_type AS model, event_id % 10 = 0 AS cached, CASE WHEN k >= 0 THEN k END AS prompt_tokens, CASE WHEN value >= 0 THEN floor(value)::BIGINT END AS output_tokens
 FROM (SELECT *, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))
"""


@query(_USE + """SELECT strftime(ts, '%Y-%m') AS bucket, model, count(*) AS n_events, count(*) FILTER (cached) AS n_cached, sum(CASE WHEN NOT cached THEN prompt_tokens END)::BIGINT AS prompt_tokens, sum(CASE WHEN NOT cached THEN output_tokens END)::BIGINT AS output_tokens FROM u GROUP BY 1, 2""")
def agg_usage_by_month(s, d):
    return timeline.usage_by(timeline.usage_events(load(s, d, "events")), "month")


@query(_USE + """SELECT strftime(ts, '%Y-%m-%d') AS bucket, model, count(*) AS n_events, count(*) FILTER (cached) AS n_cached, sum(CASE WHEN NOT cached THEN prompt_tokens END)::BIGINT AS prompt_tokens, sum(CASE WHEN NOT cached THEN output_tokens END)::BIGINT AS output_tokens FROM u GROUP BY 1, 2""")
def agg_usage_by_day(s, d):
    return timeline.usage_by(timeline.usage_events(load(s, d, "events")), "day")


@query(_USE + """, p(model, input_price, output_price) AS (VALUES ('click', 2.0, 8.0), ('purchase', 1.0, 4.0)),
 c AS (SELECT u.model, CASE WHEN cached THEN 'cached' WHEN input_price IS NULL THEN 'no_price_config' WHEN prompt_tokens IS NULL OR output_tokens IS NULL THEN 'usage_unavailable' ELSE 'priced' END AS cost_status,
  (prompt_tokens * input_price + output_tokens * output_price) / 1000000 AS full_cost FROM u LEFT JOIN p USING (model))
SELECT model, cost_status, count(*) AS n_events, round(sum(CASE WHEN cost_status = 'priced' THEN full_cost WHEN cost_status = 'cached' THEN 0.0 END), 4) AS cost FROM c GROUP BY ALL""")
def agg_costs(s, d):
    prices = s.createDataFrame([("click", 2.0, 8.0), ("purchase", 1.0, 4.0)], "model string, input_price double, output_price double")
    return timeline.costs(timeline.usage_events(load(s, d, "events")), prices)


@query(_USE + """SELECT user_id, count(*) AS n_turns, sum(output_tokens)::BIGINT AS output_tokens, min_by(model, n) AS last_model FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM u) WHERE n <= 20 GROUP BY user_id""")
def win_recent_sessions(s, d):
    return timeline.sessions(timeline.usage_events(load(s, d, "events")))


@query("""SELECT status, coalesce(error_kind, '(none)') AS error_kind, count(*) AS n_jobs FROM (SELECT DISTINCT ON (job_id) * FROM jobs ORDER BY job_id, received_at DESC) GROUP BY ALL""")
def agg_job_status(s, d):
    j = load(s, d, "jobs").groupBy("job_id").agg(F.max_by(F.struct("status", "error_kind"), "received_at").alias("r"))
    return j.groupBy(F.col("r.status").alias("status"), F.coalesce("r.error_kind", F.lit("(none)")).alias("error_kind")).agg(F.count("*").alias("n_jobs"))


# similarity --------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT DISTINCT ON (document_id) document_id, full_text FROM papers WHERE full_text IS NOT NULL),
 t AS (SELECT document_id, """ + _SIM.replace("{0}", "full_text") + """ AS t FROM p),
 sh AS (SELECT DISTINCT document_id AS k, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) <= 3 THEN [array_to_string(t, ' ')] ELSE list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' ')) END) AS s FROM t),
 n AS (SELECT k, count(*) AS n FROM sh GROUP BY k),
 c AS (SELECT x.k AS a, y.k AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.k < y.k GROUP BY ALL)
SELECT a, b, score FROM (SELECT a, b, round(c / (na.n + nb.n - c), 6) AS score FROM c JOIN n na ON na.k = a JOIN n nb ON nb.k = b) WHERE score >= 0.08""")
def join_jaccard_pairs(s, d):
    p = load(s, d, "papers").where("full_text is not null").dropDuplicates(["document_id"])
    return similarity.jaccard_pairs(p, "document_id", "full_text", max_chars=None)


_HASH = """WITH h AS (SELECT vec_id AS key, list_transform(embedding[1:64], lambda v: CASE WHEN v > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings),
 pairs AS (SELECT a, b, distance FROM (SELECT x.key AS a, y.key AS b, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN x.bits[i] <> y.bits[i] THEN 1 ELSE 0 END))::INT AS distance FROM h x JOIN h y ON x.key < y.key) WHERE distance <= 16)
"""


@query(_HASH + "SELECT a, b, distance FROM pairs")
def join_hamming_pairs(s, d):
    return similarity.hamming_pairs(similarity.sign_hash(load(s, d, "embeddings")), 16)


@query(_HASH.replace("<= 16", "<= 24") + """SELECT key, nearest, distance FROM (SELECT key, nearest, distance, row_number() OVER (PARTITION BY key ORDER BY distance, nearest) AS n FROM (SELECT a AS key, b AS nearest, distance FROM pairs UNION ALL SELECT b, a, distance FROM pairs) WHERE key % 100 = 0) WHERE n = 1""")
def join_nearest_hash(s, d):
    h = similarity.sign_hash(load(s, d, "embeddings"))
    return similarity.nearest(h.where("key % 100 = 0"), h, 24)


@query(_HASH.replace("WITH h", "WITH RECURSIVE h") + """, e AS (SELECT a AS u, b AS v FROM pairs UNION ALL SELECT b, a FROM pairs), reach(u, v) AS (SELECT key, key FROM h UNION SELECT reach.u, e.v FROM reach JOIN e ON e.u = reach.v)
SELECT u AS key, min(v) AS cluster FROM reach GROUP BY u""")
def join_hash_clusters(s, d):
    h = similarity.sign_hash(load(s, d, "embeddings"))
    return similarity.components(h, similarity.hamming_pairs(h, 16))


# papers ------------------------------------------------------------------------------------------


@query("""SELECT ref_id, coalesce(CASE WHEN inner_y <> '' THEN inner_y::INT END, ys[len(ys)]::INT) AS year FROM (SELECT ref_id, regexp_extract(t, '\\(((?:19|20)\\d\\d)[a-z]?\\)', 1) AS inner_y, regexp_extract_all(t, '\\b((?:19|20)\\d\\d)\\b', 1) AS ys
FROM (SELECT DISTINCT ref_id, regexp_replace(coalesce(raw, ''), '10\\.\\d{4,9}/[^\\s,;]+', ' ', 'g') AS t FROM resolved_refs))""")
def str_reference_years(s, d):
    return load(s, d, "resolved_refs").dropDuplicates(["ref_id"]).select("ref_id", papers.year_in("raw").alias("year"))


def _resolved(s: SparkSession, d: str) -> DataFrame:
    raw, entries = load(s, d, "resolved_refs").dropDuplicates(["ref_id"]), load(s, d, "library_entries")
    r = raw.select("ref_id", "citing_id", F.regexp_extract(T.text("raw"), r"(10\.\d{4,9}/[^\s,;]+)", 1).alias("doi"))
    return papers.resolve(r.join(papers.titles_in(raw, entries), "ref_id", "left"), entries)


@query()  # titles inside free text are found by n-grams of words, tests compare with brute force
def join_resolved_references(s, d):
    return _resolved(s, d)


@query()  # titles inside free text are found by n-grams of words, tests compare with brute force
def join_citation_edges(s, d):
    return papers.citation_edges(_resolved(s, d))


@query()  # titles inside free text are found by n-grams of words, tests compare with brute force
def agg_citation_nodes(s, d):
    return papers.citation_nodes(papers.citation_edges(_resolved(s, d)))


@query("""SELECT document_id, (i - 1)::INT AS line, regexp_extract(t, '^(\\d{1,2}) ', 1)::INT AS number, trim(regexp_extract(t, '^\\d{1,2} (.*)$', 1)) AS heading
FROM (SELECT document_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT document_id, string_split(full_text, chr(10)) AS l FROM (SELECT DISTINCT document_id, full_text FROM papers)))
WHERE regexp_matches(t, '^\\d{1,2} \\S') AND length(t) <= 120""")
def win_paper_headings(s, d):
    return papers.headings(load(s, d, "papers").dropDuplicates(["document_id"]))


@query()
def str_reference_entries(s, d):
    return papers.split_references(load(s, d, "papers"))


# blocks and versions -----------------------------------------------------------------------------


def _job_pairs(s: SparkSession, d: str) -> DataFrame:
    """What a job read from a document's page, and the document's text as it is now."""
    j = load(s, d, "jobs").where("markdown is not null and document_id is not null").groupBy("job_id").agg(F.max_by(F.struct("markdown", "document_id"), "received_at").alias("r"))
    now = library.current(load(s, d, "library_records")).where("current_markdown is not null").select("document_id", F.col("current_markdown").alias("text_b"))
    return j.select("job_id", "r.document_id", F.col("r.markdown").alias("text_a")).join(now, "document_id").select(F.col("job_id").alias("pair_id"), "text_a", "text_b")


@query()
def diff_changes(s, d):
    return diff.diff_versions(_job_pairs(s, d))


@query()
def diff_summary(s, d):
    return diff.summary(diff.diff_versions(_job_pairs(s, d)))


@query()
def str_blocks(s, d):
    j = load(s, d, "jobs").where("markdown is not null").dropDuplicates(["job_id"])
    return diff.block_rows(j, "job_id", "markdown").groupBy("block_type").agg(F.count("*").alias("n_blocks"), F.sum(F.length("text")).alias("n_chars"))


@query("""WITH j AS (SELECT DISTINCT ON (job_id) * FROM jobs ORDER BY job_id, received_at DESC)
SELECT job_id, document_id, (row_number() OVER w - 1)::INT AS idx, row_number() OVER w = count(*) OVER (PARTITION BY document_id) AS is_latest FROM j WHERE document_id IS NOT NULL
WINDOW w AS (PARTITION BY document_id ORDER BY coalesce(started_at::VARCHAR, ''), job_id)""".replace("coalesce(started_at::VARCHAR, '')", "coalesce(lpad((started_at * 1000)::BIGINT::VARCHAR, 20, '0'), '')"))
def win_version_rank(s, d):
    j = load(s, d, "jobs").groupBy("job_id").agg(F.max_by(F.struct("document_id", "started_at"), "received_at").alias("r")).select("job_id", "r.*").where("document_id is not null")
    at = F.lpad(F.round(F.col("started_at") * 1000).cast("bigint").cast("string"), 20, "0")
    return versions.ranked(j.withColumn("at", at), "document_id", "at", "job_id").select("job_id", "document_id", "idx", "is_latest")


_THREE = _LIB + """, want AS (SELECT document_id AS path, substr(sha256(coalesce(current_markdown, '')), 1, 16) AS h FROM lib), have AS (SELECT document_id AS path, substr(sha256(coalesce(title, '')), 1, 16) AS h FROM cur WHERE ascii(right(document_id, 1)) % 3 <> 0),
 was AS (SELECT document_id AS path, substr(sha256(coalesce(title, '')), 1, 16) AS h FROM cur WHERE ascii(right(document_id, 1)) % 2 = 0)
SELECT path, CASE WHEN want.h IS NOT NULL AND have.h IS NULL THEN 'added' WHEN want.h = have.h THEN 'unchanged' WHEN want.h IS NOT NULL AND have.h = was.h THEN 'updated' WHEN want.h IS NOT NULL THEN 'conflict' WHEN have.h = was.h THEN 'deleted' WHEN have.h IS NOT NULL THEN 'kept_user' ELSE 'gone' END AS action
FROM want FULL JOIN have USING (path) FULL JOIN was USING (path)"""


@query(_THREE)
def set_three_way(s, d):
    cur = library.current(load(s, d, "library_records"))
    last = F.ascii(F.right("document_id", F.lit(1)))
    want = cur.where(~library.archived()).select(F.col("document_id").alias("path"), T.content_hash("current_markdown").alias("hash"))
    have = cur.where(last % 3 != 0).select(F.col("document_id").alias("path"), T.content_hash("title").alias("hash"))
    was = cur.where(last % 2 == 0).select(F.col("document_id").alias("path"), T.content_hash("title").alias("hash"))
    return versions.three_way(want, have, was)


@query(_LIB + "SELECT document_id, updated_at FROM cur ORDER BY updated_at DESC NULLS LAST, document_id LIMIT 100")
def snk_evicted(s, d):
    cur = library.current(load(s, d, "library_records")).select("document_id", "updated_at")
    return versions.evict(cur, "document_id", "updated_at", 100)


@query(_LIB + """SELECT document_id FROM cur WHERE document_id NOT IN (SELECT document_id FROM papers WHERE document_id IS NOT NULL)""")
def snk_removed(s, d):
    return versions.remove(library.current(load(s, d, "library_records")).select("document_id"), load(s, d, "papers"), "document_id")


@query(_LIB + """, h AS (SELECT sha256(document_id || chr(31) || coalesce(updated_at, '') || chr(31) || substr(sha256(coalesce(current_markdown, '')), 1, 16)) AS h FROM cur)
SELECT substr(sha256(count(*) || '|' || sum(('0x' || substr(h, 1, 15))::BIGINT)::HUGEINT || '|' || bit_xor(('0x' || substr(h, 16, 15))::BIGINT)), 1, 24) AS fingerprint FROM h""")
def plan_fingerprint(s, d):
    cur = library.current(load(s, d, "library_records"))
    return fingerprints.library_fingerprint(cur, F.concat_ws("\x1f", "document_id", T.text("updated_at"), T.content_hash("current_markdown")))


@query("""SELECT document_id, job_id, status FROM (SELECT DISTINCT ON (job_id) * FROM jobs ORDER BY job_id, received_at DESC) j WHERE document_id IS NOT NULL AND document_id NOT IN (SELECT document_id FROM (SELECT DISTINCT ON (document_id) * FROM library_records ORDER BY document_id, received_at DESC) WHERE length(trim(coalesce(merged_into, ''))) = 0)""")
def join_dangling_jobs(s, d):
    j = load(s, d, "jobs").groupBy("job_id").agg(F.max_by(F.struct("document_id", "status"), "received_at").alias("r")).select("r.document_id", "job_id", "r.status").where("document_id is not null")
    return j.join(_live(s, d).select("document_id"), "document_id", "left_anti")


# timestamps --------------------------------------------------------------------------------------


@query()
def p6_found(s, d):
    return timestamps.found(load(s, d, "library_records"), load(s, d, "scanners"))


@query()
def p6_order_weights(s, d):
    return timestamps.order_weights(timestamps.slot_values(load(s, d, "library_records")), load(s, d, "scanners"))


# governance and quality --------------------------------------------------------------------------


def _jobs(s: SparkSession, d: str) -> DataFrame:
    cols = ("markdown", "error", "degraded", "model", "title", "document_id", "provider", "original_ext")
    return load(s, d, "jobs").groupBy("job_id").agg(F.max_by(F.struct(*cols), "received_at").alias("r")).select("job_id", "r.*")


_JOBS = "WITH j AS (SELECT DISTINCT ON (job_id) * FROM jobs ORDER BY job_id, received_at DESC)\n"
_BLANK = governance.BLANK.replace("'", "''")
_HEALTH = f"""CASE WHEN length(coalesce(error, '')) > 0 THEN 'failed' WHEN markdown IS NULL THEN 'pending' WHEN {_strip('markdown')} = '' OR regexp_matches({_strip('markdown')}, '{_BLANK}') THEN 'suspected' WHEN len(coalesce(degraded, [])) > 0 THEN 'degraded' ELSE 'healthy' END"""


@query(_JOBS + f"SELECT job_id, {_HEALTH} AS health FROM j")
def prj_job_health(s, d):
    return governance.health(_jobs(s, d))


@query(_JOBS + f"SELECT health, count(*) AS n_jobs, count(*) FILTER (health IN ('failed', 'suspected', 'degraded')) AS repairable FROM (SELECT {_HEALTH} AS health FROM j) GROUP BY health")
def agg_health_summary(s, d):
    return governance.health_summary(_jobs(s, d))


@query("""WITH x AS (SELECT DISTINCT ON (inference_id) inference_id, try_cast(regexp_extract(coalesce(raw, ''), '(?s)(\\{.*\\})', 1) AS JSON) AS j FROM tag_inferences),
 y AS (SELECT inference_id, CASE WHEN json_type(j, '$.tags') = 'ARRAY' THEN from_json(json_extract(j, '$.tags'), '["VARCHAR"]') END AS r FROM x)
SELECT inference_id, coalesce(r IS NOT NULL AND len(r) <= 32 AND len(list_filter(r, lambda v: v IS NULL)) = 0, false) AS valid, len(coalesce(r, []))::INT AS n_reply FROM y""")
def arr_reply_tags(s, d):
    return governance.reply_tags(load(s, d, "tag_inferences").dropDuplicates(["inference_id"])).drop("keys")


@query(_JOBS + f""", l AS (SELECT job_id AS key, unnest(string_split(coalesce(markdown, ''), chr(10))) AS line FROM j),
 n AS (SELECT key, list_filter(list_transform(string_split(regexp_replace(line, '^\\s*(?:[-*+]|\\d+[.)])\\s+', ''), '→'), lambda x: {_strip('x')}), lambda x: x <> '') AS n FROM l WHERE contains(line, '→'))
SELECT DISTINCT key, n[i] AS from_label, n[i + 1] AS to_label FROM (SELECT key, n, unnest(range(1, len(n))) AS i FROM n WHERE len(n) > 1)""")
def str_relation_edges(s, d):
    return governance.relation_edges(_jobs(s, d), "job_id", "markdown")


_RULES = [("reading", ["bibliography", "citation", "书目"]), ("devices", ["scanner", "camera", "扫描仪"]), ("meetings", ["minutes", "agenda", "议程"])]


@query(_LIB + """, t AS (SELECT document_id AS key, lower(coalesce(title, '') || ' ' || coalesce(current_markdown, '')) AS t FROM lib),
 h AS (SELECT key, list_filter([CASE WHEN contains(t, 'bibliography') OR contains(t, 'citation') OR contains(t, '书目') THEN 'reading' END, CASE WHEN contains(t, 'scanner') OR contains(t, 'camera') OR contains(t, '扫描仪') THEN 'devices' END,
  CASE WHEN contains(t, 'minutes') OR contains(t, 'agenda') OR contains(t, '议程') THEN 'meetings' END], lambda x: x IS NOT NULL) AS h FROM t)
SELECT key, unnest(CASE WHEN len(h) > 0 THEN h ELSE ['misc'] END) AS topic FROM h""")
def str_rule_topics(s, d):
    return governance.classify(_live(s, d), _RULES, "document_id", "title", "current_markdown")


@query("""WITH n AS (SELECT doc_id AS key, list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '\\[(\\d{1,4})\\]', 1), lambda x: x::INT)) AS n FROM documents WHERE lower(trim(source)) = 'qa_answers')
SELECT key, list_sort(list_filter(n, lambda x: x BETWEEN 1 AND 4)) AS trusted, list_sort(list_filter(n, lambda x: x NOT BETWEEN 1 AND 4)) AS untrusted FROM n""")
def set_citation_markers(s, d):
    return governance.citation_markers(load(s, d, "documents").where(F.lower(F.trim("source")) == "qa_answers"), "doc_id", "text", 4)


@query(f"""WITH p AS (SELECT DISTINCT document_id, coalesce(front_text, '') AS t FROM papers), l AS (SELECT *, list_filter(list_transform(string_split(t, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '') AS l, {_strip("regexp_extract(t, '(?is)\\babstract\\b[:.\\s]*\\n?(.+)', 1)")} AS a FROM p)
SELECT document_id, coalesce(l[1], '') AS title, coalesce(l[2], '') AS byline, a AS abstract, length(a)::INT AS abstract_chars FROM l""")
def str_paper_front(s, d):
    return governance.paper_front(load(s, d, "papers").dropDuplicates(["document_id"]))


@query(_LIB + """, c AS (SELECT document_id, min(created_at) AS candidate FROM lib GROUP BY document_id)
SELECT document_id, CASE WHEN m THEN v ELSE coalesce(candidate, v) END AS value, m AS manual FROM (SELECT document_id, metadata.document_time.value AS v, coalesce(metadata.document_time.manual, false) OR coalesce(metadata.document_time.source, '') = 'manual' AS m FROM lib) LEFT JOIN c USING (document_id)""")
def date_merged_slot(s, d):
    lib = _live(s, d)
    return governance.merged_slots(lib, "document_time", lib.select("document_id", F.col("created_at").alias("candidate")))


@query(_LIB + f""", a AS (SELECT unnest({_distinct('topics')}) AS topic, document_id FROM lib) SELECT document_id, list(topic ORDER BY ascii(topic), topic) AS topics FROM a GROUP BY document_id""")
def snk_topic_assignment(s, d):
    a = _live(s, d).select(F.explode(V.ordered_distinct("topics")).alias("topic"), "document_id")
    return governance.topics_by_document(a.withColumn("ordinal", F.ascii("topic")))


@query(_LIB + f""", plan AS (SELECT document_id, collection_id FROM lib JOIN collection_registry r ON list_contains(topics, r.topic)),
 rejected AS (SELECT document_id, collection_id FROM plan WHERE ascii(right(document_id, 1)) % 5 = 0)
SELECT p.document_id, p.collection_id, CASE WHEN list_contains({_distinct('list_concat(coalesce(l.manual_collections, []), coalesce(l.auto_collections, []))')}, p.collection_id) THEN 'already' WHEN len({_distinct('l.manual_collections')}) > 0 THEN 'confirm' ELSE 'pending' END AS status
FROM plan p JOIN lib l USING (document_id) WHERE (p.document_id, p.collection_id) NOT IN (SELECT document_id, collection_id FROM rejected)""")
def join_suggestions(s, d):
    lib = _live(s, d)
    topics = lib.select("document_id", F.explode(F.array_distinct("topics")).alias("topic"))
    plan = topics.join(load(s, d, "collection_registry").select("collection_id", "topic"), "topic").select("document_id", "collection_id").distinct()
    return governance.suggestions(lib, plan, plan.where(F.ascii(F.right("document_id", F.lit(1))) % 5 == 0))


@query(_LIB + f"""SELECT document_id, marked, n::INT AS n_chars FROM (SELECT document_id, len(list_filter(list_transform({_distinct('list_concat(coalesce(topics, []), coalesce(tags, []))')}, lambda x: lower(x)), lambda x: contains(x, 'review') OR contains(x, 'plan'))) > 0 AS marked, length(coalesce(current_markdown, '')) AS n, coalesce(created_at, '') AS d FROM lib)
ORDER BY marked DESC, n DESC, d DESC, document_id LIMIT 5""")
def sort_highlights(s, d):
    return governance.highlights(_live(s, d), ["review", "plan"])


def _day(c: str) -> str:
    return f"CASE WHEN regexp_full_match(substr({c}, 1, 10), '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast(substr({c}, 1, 10) AS DATE) END"


@query(_LIB + f""", x AS (SELECT {_day('created_at')} AS m, {_day('updated_at')} AS c FROM lib)
SELECT 'today' AS period, count(*) FILTER (m = DATE '2024-05-15') AS n_new, count(*) FILTER (c = DATE '2024-05-15') AS n_changed FROM x
UNION ALL SELECT 'week', count(*) FILTER (m BETWEEN DATE '2024-05-13' AND DATE '2024-05-15'), count(*) FILTER (c BETWEEN DATE '2024-05-13' AND DATE '2024-05-15') FROM x
UNION ALL SELECT 'total', count(*), count(*) FROM x""")
def agg_dashboard(s, d):
    return governance.dashboard(_live(s, d), "2024-05-15")


@query(_LIB + """SELECT document_id, CASE WHEN p IN ('parse', 'reparse', 'edit', 'merge', 'split', 'import') THEN p WHEN p <> '' THEN 'unknown' WHEN page_index <= 0 THEN 'parse' ELSE 'reparse' END AS version_source FROM (SELECT document_id, lower(trim(coalesce(doc_kind, ''))) AS p, page_index FROM lib)""")
def prj_version_source(s, d):
    return _live(s, d).select("document_id", governance.version_source("doc_kind", "page_index").alias("version_source"))


@query()  # the distance that the SQL has counts bytes
def math_tag_edits(s, d):
    m = load(s, d, "tag_merges").dropDuplicates(["suggestion_id"]).where("source is not null and target is not null")
    return m.groupBy(F.lower(F.trim("source")).alias("source_key"), F.lower(F.trim("target")).alias("target_key")).agg(F.count("*").alias("n"), F.round(F.avg(F.levenshtein("source", "target")), 4).alias("mean_edits"))


@query()  # as above
def agg_edit_rates(s, d):
    m = load(s, d, "tag_merges").dropDuplicates(["suggestion_id"]).where("source is not null")
    j = m.join(load(s, d, "tag_vocabulary").withColumnRenamed("tag", "target"), "target").withColumn("tag_group", F.coalesce("tag_group", F.lit("(none)")))
    return governance.scores_by_group(j, "tag_group", "source", "target")


@query()
def win_merge_layers(s, d):
    return governance.layers(load(s, d, "tag_merges").where("length(trim(source)) > 0 and length(trim(target)) > 0"))


@query()
def diff_cross_validation(s, d):
    return diff.cross_validate(_job_pairs(s, d))


@query()
def diff_repeated_blocks(s, d):
    return diff.repeated_blocks(_jobs(s, d).where("markdown is not null"), "job_id", "markdown")


@query()
def join_continuity(s, d):
    lib = _live(s, d)
    t = lib.select("document_id", F.col("current_markdown").alias("t"))
    adj = library.adjacent_pages(lib)
    pairs = adj.join(t.select(F.col("document_id").alias("a"), F.col("t").alias("text_a")), "a").join(t.select(F.col("document_id").alias("b"), F.col("t").alias("text_b")), "b")
    return diff.continuity(pairs.select(F.concat_ws("|", "a", "b").alias("pair_id"), "text_a", "text_b"))


# details -----------------------------------------------------------------------------------------


@query(_LIB + f"""SELECT * FROM (SELECT document_id, len({_distinct('topics')}) = 0 AND len({_distinct('tags')}) = 0 AS pending, len({_distinct('tags')}) = 0 AND {_strip("coalesce(current_markdown, '')")} <> '' AS to_tag,
 length(regexp_replace(coalesce(current_markdown, ''), '[\\s ]+', '', 'g')) >= 60 AS text_page FROM lib) WHERE pending OR to_tag""")
def prj_pending_material(s, d):
    return details.pending_material(_live(s, d))


@query("SELECT DISTINCT doc_id FROM documents WHERE regexp_matches(coalesce(text, ''), '" + details.ORDERS + "')")
def prj_injections(s, d):
    return details.injections(load(s, d, "documents"), "doc_id", "text").distinct()


@query(f"""SELECT document_id, count(*) AS n_lines FROM (SELECT document_id, {_strip("unnest(string_split(full_text, chr(10)))")} AS t FROM (SELECT DISTINCT document_id, full_text FROM papers WHERE full_text IS NOT NULL))
WHERE length(t) BETWEEN 1 AND 120 AND NOT regexp_matches(t, '[.!?;。！？；]$') GROUP BY document_id""")
def prj_heading_lines(s, d):
    p = load(s, d, "papers").where("full_text is not null").dropDuplicates(["document_id"]).select("document_id", F.explode(F.split("full_text", "\n")).alias("line"))
    return details.heading_like(p, "line").groupBy("document_id").agg(F.count("*").alias("n_lines"))


@query("""WITH t AS (SELECT DISTINCT document_id, path FROM (SELECT doc_id AS document_id, unnest(regexp_extract_all(coalesce(text, ''), '\\]\\(([^)\\s]+)\\)', 1)) AS path FROM documents) WHERE NOT regexp_matches(path, '^(?:[a-z]+:|#|/)'))
SELECT document_id, path FROM t WHERE path NOT IN (SELECT source_pdf FROM library_records WHERE source_pdf IS NOT NULL)""")
def join_missing_attachments(s, d):
    docs = load(s, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("current_markdown"))
    return details.missing_targets(docs, load(s, d, "library_records").where("source_pdf is not null").select(F.col("source_pdf").alias("path")))


@query("""WITH h AS (SELECT vec_id AS key, list_transform(embedding[1:64], lambda v: CASE WHEN v > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings), q AS (SELECT key AS query, bits AS qb FROM h WHERE key % 100 = 0)
SELECT query, key, distance, round(greatest(0, 1 - distance / 64), 4) AS similarity FROM (SELECT query, key, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN bits[i] <> qb[i] THEN 1 ELSE 0 END))::INT AS distance FROM h, q WHERE key <> query) WHERE distance <= 28""")
def join_hash_range(s, d):
    h = similarity.sign_hash(load(s, d, "embeddings"))
    return details.within_hash(h, h.where("key % 100 = 0"), 28)


@query(_LIB + """, adj AS (SELECT source_key, document_id AS a, next_id AS b FROM (SELECT *, lead(document_id) OVER w AS next_id, lead(position) OVER w AS next_position FROM (
 SELECT document_id, CASE WHEN length(pdf_id) > 0 THEN pdf_id WHEN length(source_pdf) > 0 THEN source_pdf END AS source_key, coalesce(page_index, page_number - 1) AS position FROM lib) WHERE source_key IS NOT NULL AND position IS NOT NULL
 WINDOW w AS (PARTITION BY source_key ORDER BY position, document_id)) WHERE next_position = position + 1)
SELECT document_id, list_sort(list(DISTINCT source_key)) AS labels FROM (SELECT unnest([a, b]) AS document_id, source_key FROM adj) GROUP BY document_id""")
def agg_evidence_index(s, d):
    return details.evidence(library.adjacent_pages(_live(s, d)).select("a", "b", F.col("source_key").alias("label")))


@query("SELECT pdf_id, page_number, count(*) AS n_documents FROM library_records WHERE page_number IS NOT NULL AND length(pdf_id) > 0 GROUP BY ALL HAVING count(*) > 1")
def agg_repeated_pages(s, d):
    return details.repeated_pages(load(s, d, "library_records"))


@query(_LIB + f""", r AS (SELECT document_id, {_distinct('manual_collections')} AS m, {_distinct('auto_collections')} AS a, {_distinct('topics')} AS t FROM lib),
 x AS (SELECT document_id, 0 AS k, unnest(m) AS c, generate_subscripts(m, 1) AS i FROM r
  UNION ALL SELECT document_id, 1, c, i FROM (SELECT document_id, unnest(a) AS c, generate_subscripts(a, 1) AS i FROM r) WHERE c IN (SELECT collection_id FROM collection_registry)
  UNION ALL SELECT document_id, 2, collection_id, i FROM (SELECT document_id, unnest(t) AS tp, generate_subscripts(t, 1) AS i FROM r) JOIN collection_registry ON topic = tp)
SELECT document_id, list(c ORDER BY k, i, c) AS collections FROM (SELECT document_id, c, min(k) AS k, min_by(i, (k, i)) AS i FROM x GROUP BY document_id, c) GROUP BY document_id""")
def arr_effective_collections(s, d):
    return details.effective_collections(_live(s, d), load(s, d, "collection_registry"))


@query(_LIB + "SELECT document_id, coalesce(nullif(metadata.import_time.value, ''), created_at) AS import_time, nullif(metadata.import_time.value, '') IS NULL AS filled FROM lib")
def date_backfill(s, d):
    return details.backfill(_live(s, d))


@query(_LIB + """SELECT document_id, coalesce(CASE WHEN length(source_pdf) > 0 THEN string_split(source_pdf, '/')[-1] END, pdf_id) AS pdf_name,
 nullif(regexp_extract(coalesce(string_split(source_pdf, '/')[-1], ''), '^(.*?)_(\\d+)(?:_(\\d+))?\\.[A-Za-z]+$', 1), '') AS batch FROM lib""")
def str_pdf_names(s, d):
    name = details.pdf_name()
    return _live(s, d).select("document_id", name.alias("pdf_name"), details.batch_hint(name)["batch"].alias("batch"))


@query(_LIB + """SELECT document_id, coalesce(CASE WHEN length(trim(pdf_id)) > 0 THEN trim(pdf_id) END, CASE WHEN length(trim(source_pdf)) > 0 THEN trim(source_pdf) END) AS source_key, coalesce(page_index, page_number - 1) AS position, coalesce(page_number, page_index + 1) AS label FROM lib""")
def sup_source_identity(s, d):
    return details.source_identity(_live(s, d))


@query("""SELECT DISTINCT ref_id, regexp_extract(coalesce(raw, ''), '^\\s*(\\[\\w+\\]|\\d{1,3}\\.)\\s', 1) AS mark, regexp_extract(coalesce(raw, ''), '(10\\.\\d{4,9}/[^\\s,;]+)', 1) AS doi, regexp_extract(coalesce(raw, ''), '[“"]([^”"]{8,}?),?[”"]', 1) AS quoted_title FROM resolved_refs""")
def str_reference_fields(s, d):
    return details.reference_fields(load(s, d, "resolved_refs").dropDuplicates(["ref_id"]))


@query(_LIB + f"SELECT tag, n_documents FROM (SELECT tag, count(*) AS n_documents FROM (SELECT unnest({_distinct('tags')}) AS tag FROM lib) GROUP BY tag) ORDER BY n_documents DESC, lower(tag), tag LIMIT 40")
def sup_vocabulary_lines(s, d):
    return details.vocabulary_lines(library.facet_counts(_live(s, d), "tags", "tag"), 40)


@query(_LIB + f"SELECT pdf_id, list_sort(list(DISTINCT x)) AS labels FROM (SELECT pdf_id, unnest({_distinct('tags')}) AS x FROM lib WHERE pdf_id IS NOT NULL) GROUP BY pdf_id")
def set_labels_per_pdf(s, d):
    return details.union_per_group(_live(s, d), "pdf_id", "tags")


@query(_JOBS + "SELECT model, count(*) AS n, round(avg(length(markdown)), 4) AS mean, median(length(markdown)) AS median FROM j WHERE markdown IS NOT NULL GROUP BY model")
def math_medians(s, d):
    return details.medians(_jobs(s, d), "model", F.length("markdown"))


@query("SELECT job_id, started_at FROM (SELECT DISTINCT ON (job_id) * FROM jobs ORDER BY job_id, received_at DESC) ORDER BY started_at DESC NULLS LAST, job_id LIMIT 200")
def snk_last_rows(s, d):
    j = load(s, d, "jobs").groupBy("job_id").agg(F.max_by("started_at", "received_at").alias("started_at"))
    return details.last_rows(j, "started_at", "job_id", 200)


@query(_LIB + f"""SELECT document_id, CASE WHEN length(x) > 120 THEN substr(x, 1, 120) || '…' ELSE x END AS first_paragraph FROM (SELECT document_id, coalesce(list_filter(list_transform(string_split(coalesce(current_markdown, ''), chr(10)), lambda x: {_strip("regexp_replace(regexp_replace(x, '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '^#+\\s*', '')")}), lambda x: x <> '')[1], '') AS x FROM lib)""")
def str_first_paragraphs(s, d):
    return _live(s, d).select("document_id", T.first_paragraph("current_markdown").alias("first_paragraph"))


@query("SELECT tag, regexp_replace(tag, '([\\\\`*_{}\\[\\]<>#])', '\\\\\\1', 'g') AS escaped, regexp_replace(translate(tag, '" + _WIDE + "', '" + _NARROW + "'), '\\s+', '', 'g') AS folded FROM tag_vocabulary")
def str_escaped_labels(s, d):
    return load(s, d, "tag_vocabulary").select("tag", T.escape_markdown("tag").alias("escaped"), T.label_fold("tag").alias("folded"))


@query(_LIB + """SELECT kind, count(*) AS n FROM (SELECT coalesce(doc_kind, '(none)') AS kind FROM lib) GROUP BY kind""")
def agg_kinds(s, d):
    return _live(s, d).groupBy(F.coalesce("doc_kind", F.lit("(none)")).alias("kind")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT DISTINCT document_id, title, venue FROM library_entries) SELECT coalesce(venue, '(none)') AS venue, count(DISTINCT document_id) AS n_entries FROM e GROUP BY 1""")
def agg_venues(s, d):
    return load(s, d, "library_entries").groupBy(F.coalesce("venue", F.lit("(none)")).alias("venue")).agg(F.countDistinct("document_id").alias("n_entries"))

