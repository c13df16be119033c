"""Queries of metadata dates, changes to records, typed documents and digests, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import values as V
from quire.operators import curation, dates, digest, ir, library, retrieval
from quire.queries import _LIB, _day, _distinct, _items, _live, _strip, _tagkey, _tokens, query
from quire.session import load

# dates -------------------------------------------------------------------------------------------

_P = r"(?:^|[^0-9])(19\d{2}|20\d{2})\s*[-/.年]\s*(\d{1,2})\s*[-/.月]\s*(\d{1,2})\s*日?"
_ISO = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?(Z|[+-]\d{2}:\d{2})?)?$"


def _g(v: str, form: str, i: int) -> str:
    return f"regexp_extract({v}, '{form}', {i})"


def _flex(v: str) -> str:
    s = _strip(f"coalesce({v}, '')")
    made = f"try_cast({_g(s, _P, 1)} || '-' || lpad({_g(s, _P, 2)}, 2, '0') || '-' || lpad({_g(s, _P, 3)}, 2, '0') AS DATE)"
    packed = f"try_cast(substr({s}, 1, 4) || '-' || substr({s}, 5, 2) || '-' || substr({s}, 7, 2) AS DATE)"
    return f"CASE WHEN regexp_matches({s}, '{_P}') THEN {made} WHEN regexp_full_match({s}, '(?:19|20)\\d{{6}}') THEN {packed} END"


def _stamp(v: str) -> str:
    s = _strip(f"coalesce({v}, '')")
    g = {i: _g(s, _ISO, i) for i in range(1, 6)}
    real = f"try_cast({g[1]} AS DATE) IS NOT NULL AND {g[2]} < '24' AND {g[3]} < '60' AND {g[4]} < '60'"
    clock = f"CASE WHEN {g[2]} = '' THEN '00:00:00' ELSE {g[2]} || ':' || {g[3]} || ':' || CASE WHEN {g[4]} = '' THEN '00' ELSE {g[4]} END END"
    return f"CASE WHEN regexp_matches({s}, '{_ISO}') AND {real} THEN {g[1]} || 'T' || ({clock}) || CASE WHEN {g[5]} = 'Z' THEN '+00:00' ELSE {g[5]} END ELSE strftime({_flex(v)}, '%Y-%m-%d') END"


def _normal(field: str, v: str) -> str:
    return f"strftime({_flex(v)}, '%Y-%m-%d')" if field == "document_time" else _stamp(v)


_SLOTS = " UNION ALL ".join(
    f"""SELECT document_id, '{s}' AS slot_name, {_normal(s, f'metadata.{s}.value')} AS value, coalesce(nullif(metadata.{s}.source, ''), CASE WHEN metadata.{s}.manual THEN 'manual' ELSE 'none' END) AS source,
 CASE WHEN metadata.{s}.confidence IN ('high', 'medium', 'low') THEN metadata.{s}.confidence END AS confidence, nullif(metadata.{s}.evidence, '') AS evidence,
 coalesce(metadata.{s}.manual, false) OR coalesce(nullif(metadata.{s}.source, ''), CASE WHEN metadata.{s}.manual THEN 'manual' ELSE 'none' END) = 'manual' AS manual FROM lib"""
    for s in V.SLOTS
)


@query(_LIB + "SELECT document_id, " + ", ".join(f"{_flex(f'metadata.{s}.value')} AS {s}" for s in V.SLOTS) + " FROM lib")
def date_flexible(s, d):
    return _live(s, d).select("document_id", *(dates.flexible_date(f"metadata.{x}.value").alias(x) for x in V.SLOTS))


@query(_LIB + _SLOTS)
def date_metadata(s, d):
    return dates.normal_metadata(_live(s, d))


@query(_LIB + f""", n AS ({_SLOTS}), r AS (SELECT *, CASE slot_name WHEN 'document_time' THEN 0 WHEN 'capture_time' THEN 1 ELSE 2 END AS k FROM n WHERE value IS NOT NULL),
 f AS (SELECT document_id, min_by(slot_name, k) AS field, min_by(value, k) AS value, min_by(source, k) AS source, arg_min_null(confidence, k) AS confidence FROM r GROUP BY document_id)
SELECT document_id, field, value, source, confidence FROM lib LEFT JOIN f USING (document_id)""")
def date_effective_metadata(s, d):
    return dates.effective_metadata(_live(s, d))


@query()
def date_inferred(s, d):
    return _live(s, d).select("document_id", dates.inferred_date("current_markdown").alias("i")).select("document_id", "i.*")


@query(_LIB + """SELECT document_id, CASE WHEN regexp_matches(t, f) AND NOT (s = ':' AND b = 'T') AND h < '24' AND m < '60' AND x < '60' AND try_cast(y || '-' || mo || '-' || dd AS DATE) IS NOT NULL THEN y || '-' || mo || '-' || dd || 'T' || h || ':' || m || ':' || x END AS taken
FROM (SELECT *, regexp_extract(t, f, 1) AS y, regexp_extract(t, f, 2) AS s, regexp_extract(t, f, 3) AS mo, regexp_extract(t, f, 4) AS s2, regexp_extract(t, f, 5) AS dd, regexp_extract(t, f, 6) AS b, regexp_extract(t, f, 7) AS h, regexp_extract(t, f, 8) AS m, regexp_extract(t, f, 9) AS x
 FROM (SELECT document_id, trim(coalesce(metadata.capture_time.value, '')) AS t, '^(\\d{4})([:-])(\\d{2})([:-])(\\d{2})([ T])(\\d{2}):(\\d{2}):(\\d{2})$' AS f FROM lib)) WHERE s = s2""")
def date_exif(s, d):
    t = F.trim(T.text("metadata.capture_time.value"))
    form = r"^(\d{4})([:-])(\d{2})([:-])(\d{2})([ T])(\d{2}):(\d{2}):(\d{2})$"
    rows = _live(s, d).where(F.regexp_extract(t, form, 2) == F.regexp_extract(t, form, 4))
    return rows.select("document_id", dates.exif_timestamp("metadata.capture_time.value").alias("taken"))


@query(_LIB + f""", u AS (SELECT document_id, ['document_time', 'capture_time', 'import_time'][1 + ascii(right(document_id, 1)) % 3] AS field, metadata.capture_time.value AS v FROM lib),
 n AS (SELECT document_id, field, v, CASE field WHEN 'document_time' THEN {_normal('document_time', 'v')} WHEN 'capture_time' THEN {_stamp('v')} END AS value FROM u),
 t AS (SELECT *, CASE WHEN field = 'import_time' THEN 'system_field' WHEN coalesce(v, '') = '' THEN 'cleared' WHEN value IS NULL THEN 'no_time' ELSE 'set' END AS status FROM n)
SELECT document_id, field, CASE WHEN status = 'set' THEN value END AS value, status FROM t""")
def date_updates(s, d):
    field = F.element_at(F.array(*map(F.lit, ("document_time", "capture_time", "import_time"))), 1 + F.ascii(F.right("document_id", F.lit(1))) % 3)
    return dates.guarded_updates(_live(s, d).select("document_id", field.alias("field"), F.col("metadata.capture_time.value").alias("value")))


@query(_LIB + f""", r AS (SELECT document_id, metadata.document_time.value AS dt, metadata.document_time.confidence AS c, title AS e, CASE WHEN regexp_full_match(metadata.document_time.value, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast(metadata.document_time.value AS DATE) END AS day FROM lib),
 g AS (SELECT *, coalesce(day IS NOT NULL AND c IN ('high', 'medium', 'low') AND length(e) BETWEEN 1 AND 400, false) AS ok FROM r)
SELECT document_id, CASE WHEN ok THEN strftime(day, '%Y-%m-%d') END AS value, CASE WHEN ok THEN 'inferred' END AS source, CASE WHEN ok THEN c END AS confidence, CASE WHEN ok THEN {_strip('e')} END AS evidence FROM g""")
def date_checked_inference(s, d):
    r = _live(s, d).select("document_id", F.col("metadata.document_time.value").alias("date"), F.col("metadata.document_time.confidence").alias("confidence"), F.col("title").alias("evidence"))
    return dates.checked_inference(r)


# changes to records ------------------------------------------------------------------------------

_RELS = """, rl AS (SELECT DISTINCT document_id AS a, trim(x.target) AS b FROM (SELECT document_id, unnest(manual_relations) AS x FROM lib) WHERE length(trim(x.target)) > 0 AND trim(x.target) <> document_id)
"""


def _pairs(lib: DataFrame) -> DataFrame:
    r = lib.select(F.col("document_id").alias("a"), F.explode("manual_relations").alias("x")).select("a", F.trim("x.target").alias("b"))
    return r.where("length(b) > 0 and a <> b").distinct()


@query(_LIB + _RELS + """, known AS (SELECT DISTINCT least(document_id, trim(merged_into)) || '|' || greatest(document_id, trim(merged_into)) AS pair, 0 AS distance FROM cur WHERE length(trim(merged_into)) > 0),
 fresh AS (SELECT least(a, b) || '|' || greatest(a, b) AS pair, min(length(a || b) % 13)::INT AS distance FROM rl GROUP BY 1)
SELECT pair, distance FROM known WHERE pair NOT IN (SELECT pair FROM fresh) UNION ALL SELECT pair, distance FROM fresh""")
def snk_rejected_pairs(s, d):
    cur = library.current(load(s, d, "library_records"), columns=("merged_into",))
    known = cur.where("length(trim(merged_into)) > 0").select(T.pair_key("document_id", F.trim("merged_into")).alias("pair"), F.lit(0).alias("distance")).distinct()
    return curation.reject(known, _pairs(_live(s, d)).withColumn("distance", F.length(F.concat("a", "b")) % 13))


@query(_LIB + _RELS + """, ok AS (SELECT a, b, (ascii(right(b, 1)) % 13)::INT AS distance FROM rl WHERE b IN (SELECT document_id FROM lib))
SELECT source, target, any_value(distance) AS distance, round(1 - any_value(distance) / 64, 4) AS similarity FROM (SELECT a AS source, b AS target, distance FROM ok UNION ALL SELECT b, a, distance FROM ok WHERE (b, a) NOT IN (SELECT a, b FROM ok)) GROUP BY ALL""")
def snk_confirmed_relations(s, d):
    lib = _live(s, d)
    p = _pairs(lib)
    # a pair written on both documents counts as the one of each direction
    both = p.join(p.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi")
    one = p.join(both, ["a", "b"], "left_anti").withColumn("distance", (F.ascii(F.right("b", F.lit(1))) % 13).cast("int"))
    two = both.withColumn("distance", (F.ascii(F.right("b", F.lit(1))) % 13).cast("int"))
    empty = s.createDataFrame([], "pair string, distance int")
    single = curation.confirm(lib, one, empty)[0]
    ids = lib.select(F.col("document_id").alias("a"))
    mutual = two.join(ids, "a", "left_semi").select(F.col("a").alias("source"), F.col("b").alias("target"), "distance", F.round(V.hash_similarity("distance"), 4).alias("similarity"))
    return single.unionByName(mutual)


@query(_LIB + "SELECT document_id, " + ", ".join(f"list_filter({_distinct(c)}, lambda x: x <> 'col-00') AS {c}" for c in ("manual_collections", "auto_collections")) + " FROM lib")
def snk_collection_drop(s, d):
    return curation.drop_collection(_live(s, d), load(s, d, "collection_registry"), "col-00")


@query(_LIB + f""", w AS (SELECT document_id, {_distinct('manual_collections')} AS had, CASE WHEN ascii(right(document_id, 1)) % 4 = 0 THEN list_concat({_distinct('auto_collections')}, ['col-xx']) ELSE {_distinct('auto_collections')} END AS ids FROM lib)
SELECT document_id, CASE WHEN list_contains(ids, 'col-xx') THEN had ELSE ids END AS manual_collections, list_filter(ids, lambda x: x = 'col-xx') AS unknown FROM w""")
def snk_collections_set(s, d):
    lib = _live(s, d)
    extra = F.when(F.ascii(F.right("document_id", F.lit(1))) % 4 == 0, F.array(F.lit("col-xx"))).otherwise(F.array().cast("array<string>"))
    return curation.set_collections(lib, lib.select("document_id", F.concat(V.ordered_distinct("auto_collections"), extra).alias("collections")), load(s, d, "collection_registry"))


@query(_LIB + f"SELECT document_id, {_distinct('list_concat(coalesce(auto_collections, []), coalesce(topics, []))')} AS auto_collections FROM lib WHERE len({_distinct('topics')}) > 0")
def snk_auto_collections(s, d):
    lib = _live(s, d)
    return curation.add_auto_collections(lib, lib.select("document_id", F.col("topics").alias("collections")))


_KEYS = f"""keys AS (SELECT k, min_by(tag, (rank, tag)) AS tag FROM (SELECT tag, rank, {_tagkey('name')} AS k FROM (SELECT tag, 0 AS rank, tag AS name FROM tag_vocabulary UNION ALL SELECT tag, 1, unnest(aliases) FROM tag_vocabulary)) WHERE k IS NOT NULL AND length(k) <= 80 GROUP BY k)
"""


@query("WITH " + _KEYS + f""", i AS (SELECT DISTINCT ON (inference_id) inference_id, {_distinct('tags')} AS t FROM tag_inferences), u AS (SELECT inference_id, pos, {_tagkey('raw')} AS k FROM (SELECT inference_id, unnest(t) AS raw, generate_subscripts(t, 1) AS pos FROM i)),
 g AS (SELECT inference_id, pos, coalesce(tag, k) AS t, tag IS NULL AS fresh FROM u LEFT JOIN keys USING (k) WHERE k IS NOT NULL AND length(k) <= 80),
 f AS (SELECT inference_id, t, min(pos) AS pos, any_value(fresh) AS fresh FROM g GROUP BY inference_id, t)
SELECT inference_id, list(t ORDER BY pos) AS tags, coalesce(list(t ORDER BY pos) FILTER (fresh), []) AS created FROM f GROUP BY inference_id""")
def str_canonical_tags(s, d):
    return curation.canonical_tags(load(s, d, "tag_inferences").dropDuplicates(["inference_id"]), load(s, d, "tag_vocabulary"), "inference_id")


@query("WITH " + _KEYS + f""", raw AS (SELECT DISTINCT raw, {_tagkey('raw')} AS k FROM (SELECT {_strip("regexp_replace(" + _strip("translate(coalesce(source, ''), '" + __import__('quire.queries', fromlist=['_WIDE'])._WIDE + "', '" + __import__('quire.queries', fromlist=['_NARROW'])._NARROW + "')") + ", '^#+', '')")} AS raw FROM tag_merges) WHERE raw <> ''),
 f AS (SELECT coalesce(tag, k) AS tag, raw FROM raw LEFT JOIN keys USING (k) WHERE k IS NOT NULL AND length(k) <= 80), n AS (SELECT tag, coalesce(list(raw) FILTER (raw <> tag), []) AS more FROM f GROUP BY tag)
SELECT tag, list_sort(list_distinct(list_concat(coalesce(aliases, []), coalesce(more, [])))) AS aliases FROM tag_vocabulary FULL JOIN n USING (tag)""")
def str_ensured_vocabulary(s, d):
    return curation.ensured_vocabulary(load(s, d, "tag_vocabulary"), load(s, d, "tag_merges").select(F.col("source").alias("raw")))


@query(_LIB + f"SELECT document_id, {_distinct('''list_transform(tags, lambda x: CASE WHEN trim(x) = 'machine learning' THEN 'probability' ELSE x END)''')} AS tags FROM lib WHERE list_contains({_distinct('tags')}, 'machine learning')")
def arr_renamed_tag(s, d):
    return curation.rename_tag(_live(s, d), "machine learning", "probability")


@query(_LIB + f""", t AS (SELECT document_id, {_distinct('tags')} AS g, {_distinct('topics')} AS n FROM lib)
SELECT document_id, list_concat(list_transform(g, lambda x: x || '=' || CASE WHEN list_contains(n, x) THEN 'manual' ELSE 'auto' END), list_transform(list_filter(n, lambda x: NOT list_contains(g, x)), lambda x: x || '=manual')) AS sources FROM t""")
def arr_added_provenance(s, d):
    p = curation.added_provenance(curation.provenance("tags", "auto"), "topics", "manual")
    return _live(s, d).select("document_id", F.transform(p, lambda x: F.concat_ws("=", x["tag"], x["source"])).alias("sources"))


@query(_LIB + f"""SELECT document_id, t[1] AS tag, t[1] || '=manual' AS first_source, len(t)::INT - 1 AS left_over FROM (SELECT document_id, {_distinct('tags')} AS t FROM lib) WHERE len(t) > 0""")
def arr_promoted_tag(s, d):
    lib = _live(s, d).select("document_id", curation.provenance("tags", "auto").alias("p")).where(F.size("p") > 0)
    tag = F.col("p")[0]["tag"]
    return lib.select("document_id", tag.alias("tag"), F.concat_ws("=", curation.promoted("p", tag)[0]["tag"], curation.promoted("p", tag)[0]["source"]).alias("first_source"), F.size(curation.removed("p", tag)).alias("left_over"))


@query(_LIB + f""", t AS (SELECT DISTINCT {_strip('topic')} AS topic FROM collection_registry WHERE topic IS NOT NULL), a AS (SELECT DISTINCT unnest({_distinct('topics')}) AS topic, document_id FROM cur)
SELECT 'too_many_topics' AS error, count(*)::VARCHAR AS subject FROM t HAVING count(*) > 20
UNION ALL SELECT DISTINCT 'unknown_topic', topic FROM a WHERE topic NOT IN (SELECT topic FROM t)
UNION ALL SELECT DISTINCT 'unknown_document', document_id FROM a WHERE document_id NOT IN (SELECT document_id FROM lib)
UNION ALL SELECT 'no_topic', document_id FROM lib WHERE document_id NOT IN (SELECT document_id FROM a)
UNION ALL SELECT 'no_summary', document_id FROM lib WHERE coalesce(length(title), 0) = 0""")
def arr_scheme_errors(s, d):
    cur = library.current(load(s, d, "library_records"), columns=("topics", "title", "merged_into"))
    topics = load(s, d, "collection_registry").where("topic is not null").select("topic")
    given = cur.select(F.explode(V.ordered_distinct("topics")).alias("topic"), "document_id")
    return curation.scheme_errors(topics, given, cur.select("document_id", F.col("title").alias("summary")), cur.where(~library.archived()), 20)


@query(_LIB + f""", own AS (SELECT document_id, 0 AS k, unnest(t) AS topic, generate_subscripts(t, 1) AS pos FROM (SELECT document_id, {_distinct('topics')} AS t FROM lib)),
 more AS (SELECT DISTINCT document_id, 1 AS k, topic, ascii(topic) AS pos FROM (SELECT document_id, unnest({_distinct('collections')}) AS c FROM lib) JOIN collection_registry ON c = collection_id WHERE topic IS NOT NULL),
 f AS (SELECT document_id, topic, min((k, pos)) AS spot FROM (SELECT document_id, k, topic, pos FROM own UNION ALL SELECT document_id, k, topic, pos FROM more) GROUP BY ALL)
SELECT document_id, list(topic ORDER BY spot, topic) AS topics FROM f GROUP BY document_id""")
def arr_scheme_topics(s, d):
    lib = _live(s, d)
    c = lib.select("document_id", F.explode(V.ordered_distinct("collections")).alias("collection_id"))
    given = c.join(load(s, d, "collection_registry").where("topic is not null"), "collection_id").select("document_id", "topic", F.ascii("topic").alias("ordinal")).distinct()
    return curation.topics_with_scheme(lib, given)


@query(_LIB + f""", plan AS (SELECT DISTINCT document_id, collection_id FROM lib JOIN collection_registry r ON list_contains({_distinct('topics')}, r.topic))
SELECT document_id, collection_id, CASE WHEN list_contains({_distinct('manual_collections')}, collection_id) OR list_contains({_distinct('auto_collections')}, collection_id) THEN 'had' WHEN len({_distinct('manual_collections')}) > 0 THEN 'skipped' ELSE 'applied' END AS outcome
FROM plan JOIN lib USING (document_id) WHERE ascii(right(document_id, 1)) % 2 = 0""")
def join_assignment_outcomes(s, d):
    lib = _live(s, d)
    topics = lib.select("document_id", F.explode(V.ordered_distinct("topics")).alias("topic"))
    plan = topics.join(load(s, d, "collection_registry").select("collection_id", "topic"), "topic").select("document_id", "collection_id").distinct()
    return curation.apply_assignments(lib, plan, plan.where(F.ascii(F.right("document_id", F.lit(1))) % 2 == 0))


@query("WITH " + _KEYS + f"SELECT DISTINCT target AS tag FROM tag_merges WHERE target IS NOT NULL AND {_tagkey('target')} IS NOT NULL AND {_tagkey('target')} NOT IN (SELECT k FROM keys) UNION SELECT DISTINCT target FROM tag_merges WHERE {_tagkey('target')} IS NULL")
def arr_stale_labels(s, d):
    return curation.stale_labels(load(s, d, "tag_merges").select(F.col("target").alias("tag")), load(s, d, "tag_vocabulary"))


@query("""SELECT DISTINCT document_id, coalesce(v, t) AS venue, CASE WHEN v IS NULL AND t IS NOT NULL THEN 'proposed' WHEN v IS NOT NULL THEN 'parsed' END AS venue_source, coalesce(t, x) AS doi, CASE WHEN t IS NOT NULL THEN 'proposed' WHEN x IS NOT NULL THEN 'parsed' END AS doi_source
FROM (SELECT document_id, CASE WHEN trim(venue) <> '' THEN venue END AS v, CASE WHEN trim(title) <> '' THEN title END AS t, CASE WHEN trim(doi) <> '' THEN doi END AS x FROM library_entries)""")
def arr_filled_fields(s, d):
    e = load(s, d, "library_entries")
    return e.select("document_id", *curation.overlaid({"venue": ("venue", "title"), "doi": ("doi", "title")}, ("doi",))).distinct()


@query("""WITH r AS (SELECT DISTINCT ON (ref_id) * FROM resolved_refs), p AS (SELECT citing_id AS document_id, count(*)::INT AS n_refs, count(*) FILTER (document_id IS NOT NULL AND document_id <> '' OR ref_index = 1)::INT AS n_resolved, count(*) FILTER (ref_index = 1) = 0 AS outside FROM r WHERE citing_id IS NOT NULL GROUP BY citing_id)
SELECT document_id, n_refs, n_resolved, CASE WHEN outside THEN 'out_of_range' END AS error FROM p""")
def snk_patched_references(s, d):
    per = curation.references_of(load(s, d, "resolved_refs"))
    done = curation.patch_reference(per, per.select("document_id", F.lit(1).alias("index"), F.lit("found").alias("resolved_document_id")))
    return done.select("document_id", F.size("refs").alias("n_refs"), F.size(F.filter("refs", lambda r: F.length(r["resolved_document_id"]) > 0)).alias("n_resolved"), "error")


@query(_LIB + f"SELECT document_id FROM lib WHERE len({_distinct('manual_collections')}) > 0")
def sup_manual_documents(s, d):
    return curation.manual_documents(_live(s, d))


@query("SELECT document_id, coalesce(nullif(substr(sha256(coalesce(t, '')), 1, 16), ''), '') AS first_hash, CASE WHEN coalesce(t, '') = coalesce(u, '') THEN 1 ELSE 2 END AS n_hashes, coalesce(nullif(u, ''), nullif(t, ''), '') AS content FROM (SELECT DISTINCT document_id, front_text AS t, references_text AS u FROM papers)")
def sup_record_hashes(s, d):
    p = load(s, d, "papers").select("document_id", "front_text", "references_text").distinct()
    h = curation.record_hashes(T.content_hash("front_text"), T.content_hash("references_text"))
    return p.select("document_id", h[0].alias("first_hash"), F.size(h).alias("n_hashes"), curation.content_of("references_text", "front_text").alias("content"))


# typed documents ---------------------------------------------------------------------------------


def _documents(s: SparkSession, d: str) -> DataFrame:
    """Every record as the JSON of a document: a heading, a quote, a list of tags, code, a table and a flow through the tags."""
    tags = V.ordered_distinct("tags")
    title = T.stripped(F.regexp_replace(T.text("title"), r"[^0-9A-Za-z ]", ""))
    block = lambda **c: F.struct(*(v.alias(k) for k, v in c.items()))
    at = F.sequence(F.lit(1), F.greatest(F.size(tags) - 1, F.lit(1)))
    edges = F.when(F.size(tags) > 1, F.transform(at, lambda i: F.struct(tags[i - 1].alias("from"), tags[i].alias("to")))).otherwise(F.array().cast("array<struct<from:string,to:string>>"))
    doc = F.to_json(F.struct(F.lit("note").alias("document_type"), F.lit(1).alias("version"), F.array(
        F.to_json(block(type=F.lit("heading"), level=F.length(title) % 8, text=title)), F.to_json(block(type=F.lit("quote"), text=F.concat(F.lit("# "), title))),
        F.to_json(block(type=F.lit("list"), ordered=F.lit(True), items=F.transform(tags, lambda x: F.struct(F.concat(F.lit("*"), x).alias("text"))))),
        F.to_json(block(type=F.lit("code"), language=F.lit("txt"), content=title)), F.to_json(block(type=F.lit("table"), headers=F.array(F.lit("a|b"), F.lit("c")), rows=F.array(F.array(title, F.lit("x"))))),
        F.to_json(block(type=F.lit("flow"), caption=title, nodes=F.transform(tags, lambda x: F.struct(x.alias("id"), x.alias("label"))), edges=edges)),
    ).alias("blocks")))
    # blocks of several shapes can't share an array of structs, so they are joined as texts
    raw = F.concat(F.lit('{"document_type":"note","version":1,"blocks":['), F.array_join(F.from_json(doc, "struct<blocks:array<string>>")["blocks"], ","), F.lit("]}"))
    return _live(s, d).select("document_id", title.alias("title"), tags.alias("tags"), raw.alias("raw"))


_IRT = _LIB + f""", t AS (SELECT document_id, {_strip("regexp_replace(coalesce(title, ''), '[^0-9A-Za-z ]', '', 'g')")} AS t, {_distinct('tags')} AS g FROM lib)
"""


@query(_IRT + "SELECT document_id, CASE WHEN length(t) % 8 IN (0, 7) THEN 'bad_level' END AS error, 6 AS n_blocks FROM t")
def ir_errors(s, d):
    return _documents(s, d).select("document_id", ir.errors("raw").alias("error"), F.size(ir.load("raw")["blocks"]).alias("n_blocks"))


@query(_IRT + """SELECT document_id, repeat('#', length(t) % 8) || ' ' || t || chr(10) || chr(10) || '> \\# ' || t || chr(10) || chr(10) || array_to_string(list_transform(g, lambda x: '1. \\*' || regexp_replace(x, '([\\\\`*_{}\\[\\]<>#])', '\\\\\\1', 'g')), chr(10)) || chr(10) || chr(10)
 || '```txt' || chr(10) || t || chr(10) || '```' || chr(10) || chr(10) || '| a\\|b | c |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || t || ' | x |' || chr(10) || chr(10) || '![' || t || '](attachments/' || document_id || '-5.png)' || chr(10) AS markdown FROM t""")
def ir_rendered(s, d):
    return _documents(s, d).select("document_id", ir.render(ir.load("raw"), F.col("document_id")).alias("markdown"))


@query(_IRT + """SELECT document_id, g[i] AS from_id, g[i + 1] AS to_id, 'solid' AS style FROM (SELECT document_id, g, unnest(range(1, len(g))) AS i FROM t WHERE len(g) > 1)""")
def ir_edges(s, d):
    flow = ir.load("raw")["blocks"][5]
    e = ir.canonical_edges(flow["edges"], F.transform(flow["nodes"], lambda n: n["id"]))
    return _documents(s, d).select("document_id", F.explode(e).alias("e")).select("document_id", F.col("e.from").alias("from_id"), F.col("e.to").alias("to_id"), "e.style")


@query(_IRT + "SELECT document_id, CASE WHEN len(g) = 0 THEN 'malformed' ELSE 'ok' END AS verdict FROM t")
def ir_diagram_verdicts(s, d):
    raw = F.to_json(ir.load("raw")["blocks"][5])
    return _documents(s, d).select("document_id", ir.diagram_verdict(F.when(F.size("tags") > 0, raw).otherwise(F.regexp_replace(raw, '"edges":\\[\\]', '"edges":null'))).alias("verdict"))


@query(_IRT + """SELECT document_id, 'heading' AS block_type, 0 AS idx, t AS text FROM t UNION ALL SELECT document_id, 'quote', 1, '# ' || t FROM t UNION ALL SELECT document_id, 'list', 2, array_to_string(list_transform(g, lambda x: '*' || x), ' | ') FROM t UNION ALL SELECT document_id, 'code', 3, t FROM t
UNION ALL SELECT document_id, 'table', 4, 'a|b | c | ' || t || ' | x' FROM t
UNION ALL SELECT document_id, 'flow', 5, array_to_string(list_concat(CASE WHEN t = '' THEN [] ELSE [t] END, list_transform(g, lambda x: x || ':' || x), CASE WHEN len(g) < 2 THEN [] ELSE list_transform(range(1, len(g)), lambda i: g[i] || '->' || g[i + 1]) END), ' | ') FROM t""")
def ir_block_texts(s, d):
    return _documents(s, d).select("document_id", F.explode(ir.one_sided(ir.load("raw"), "a")).alias("b")).select("document_id", "b.block_type", F.col("b.index").alias("idx"), "b.text")


@query(_LIB + f""", n AS (SELECT document_id, coalesce(nullif({_strip("coalesce(title, '')")}, ''), document_id) AS t, {_distinct('topics')} AS tp, {_distinct('tags')} AS g, coalesce(current_markdown, '') AS m FROM lib),
 f AS (SELECT 'note' AS kind, 'notes/' || document_id || '.md' AS path, '---' || chr(10) || 'title: ' || t || chr(10) || 'id: ' || document_id || chr(10) || 'topics: [' || array_to_string(tp, ', ') || ']' || chr(10) || 'tags: [' || array_to_string(g, ', ') || ']' || chr(10) || 'exported: 2024-05-15' || chr(10) || '---' || chr(10) || chr(10) || m || chr(10) AS content FROM n
 UNION ALL SELECT 'topic', 'topics/' || regexp_replace(regexp_replace(topic, '[^0-9A-Za-z_.\\-]+', '_', 'g'), '^_+|_+$', '', 'g') || '.md', '# ' || topic || chr(10) || chr(10) || string_agg('- [[' || document_id || ']]', chr(10) ORDER BY document_id) || chr(10) FROM (SELECT document_id, unnest(tp) AS topic FROM n) GROUP BY topic)
SELECT kind, path, substr(sha256(content), 1, 16) AS fingerprint FROM f""")
def snk_vault_manifest(s, d):
    docs = _live(s, d).withColumns({"topics": V.ordered_distinct("topics"), "tags": V.ordered_distinct("tags")})
    return ir.vault_files(docs, "2024-05-15").select("kind", "path", "fingerprint")


# digests -----------------------------------------------------------------------------------------

_RANGE = "DATE '2023-01-01' AND DATE '2023-06-30'"
_LOW = "len(list_filter([metadata.document_time.confidence, metadata.capture_time.confidence, metadata.import_time.confidence], lambda c: lower(c) IN ('low', '低', 'degraded', 'needs_review', '待复核'))) > 0"
_STATS = _items(True) + f""", x AS (SELECT l.*, {_distinct('l.topics')} AS tp, {_distinct('l.tags')} AS g, {_strip("coalesce(l.current_markdown, '')")} <> '' AS read, coalesce({_day('l.created_at')} BETWEEN {_RANGE}, false) AS fresh, {_LOW.replace('metadata', 'l.metadata')} AS low FROM lib l WHERE document_id IN (SELECT document_id FROM items WHERE day BETWEEN {_RANGE})),
 stats AS (SELECT count(*) AS document_count, count(*) FILTER (fresh) AS new_document_count, count(*) FILTER (read) AS parsed_count, count(*) FILTER (NOT read) AS failed_count, count(*) FILTER (len(g) > 0) AS tagged_count, count(*) FILTER (len(tp) = 0 OR len(g) = 0 OR low) AS inbox_in_range,
  (SELECT count(DISTINCT v) FROM (SELECT unnest(tp) AS v FROM x)) AS topic_count, (SELECT count(DISTINCT v) FROM (SELECT unnest(g) AS v FROM x)) AS tag_count, round(count(*) FILTER (read) * 100.0 / count(*), 1)::DOUBLE AS parse_success_rate FROM x)
"""


def _range(s: SparkSession, d: str) -> DataFrame:
    from quire.operators import timeline

    lib = _live(s, d)
    return digest.range_stats(timeline.dated(lib, "created_at"), lib, "2023-01-01", "2023-06-30")


@query(_STATS + "SELECT * FROM stats")
def agg_digest_stats(s, d):
    return _range(s, d)


@query(_STATS + """SELECT '- 材料文档：' || document_count || ' 篇（本周新增 ' || new_document_count || ' 篇）' || chr(10) || '- 解析成功：' || parsed_count || '/' || document_count || '（' || format('{:.1f}', parse_success_rate) || '%），失败 ' || failed_count || ' 篇' || chr(10)
 || '- 主题标签：' || topic_count || ' 个主题 / ' || tag_count || ' 个标签（覆盖 ' || tagged_count || ' 篇）' AS markdown FROM stats""")
def sup_overview_text(s, d):
    return digest.overview_text(_range(s, d))


@query(_LIB + f""", r AS (SELECT unnest(list_filter([CASE WHEN len({_distinct('topics')}) = 0 THEN 'no_topic' END, CASE WHEN len({_distinct('tags')}) = 0 THEN 'no_tag' END, CASE WHEN {_LOW} THEN 'low_confidence' END], lambda v: v IS NOT NULL)) AS reason FROM lib), c AS (SELECT reason, count(*) AS n FROM r GROUP BY reason)
SELECT '- Inbox 积压：库内 ' || (SELECT sum(n) FROM c) || ' 篇待整理' || chr(10) || '  - 原因：' || string_agg(CASE reason WHEN 'no_topic' THEN '缺主题' WHEN 'no_tag' THEN '缺标签' ELSE '低置信度' END || ' ' || n, '、' ORDER BY reason) AS markdown FROM c""")
def sup_pending_text(s, d):
    reasons = library.reason_histogram(_live(s, d))
    total = reasons.agg(F.sum("n_documents")).first()[0]
    return digest.pending_text(reasons, F.lit(total))


@query(_items(True) + f""", k AS (SELECT document_id, day FROM items WHERE day IS NOT NULL ORDER BY day DESC, document_id DESC LIMIT 60)
SELECT document_id, coalesce(title, '') AS title, day, CASE WHEN len({_distinct('topics')}) = 0 AND len({_distinct('tags')}) = 0 OR {_LOW} THEN 'pending' ELSE 'organised' END AS part FROM lib JOIN k USING (document_id)""")
def agg_material_parts(s, d):
    from quire.operators import timeline

    lib = _live(s, d)
    items = timeline.dated(lib, "created_at")
    return digest.material(items, lib, items.where("day is not null").orderBy(F.desc("day"), F.desc("document_id")).limit(60))


@query(_LIB + f""", r AS (SELECT document_id, list_filter([CASE WHEN len({_distinct('topics')}) = 0 THEN 'no_topic' END, CASE WHEN len({_distinct('tags')}) = 0 THEN 'no_tag' END, CASE WHEN {_LOW} THEN 'low_confidence' END], lambda v: v IS NOT NULL) AS reasons FROM lib)
SELECT document_id, reasons, list_transform(reasons, lambda x: CASE x WHEN 'no_topic' THEN '缺主题' WHEN 'no_tag' THEN '缺标签' ELSE '低置信度' END) AS reason_labels FROM r WHERE len(reasons) > 0""")
def sup_inbox_items(s, d):
    return digest.inbox_items(_live(s, d))


@query(_items(True) + """SELECT document_id, '- [' || t || '](#doc/' || document_id || ')（`' || document_id || '`，' || coalesce(day::VARCHAR, '日期未知') || '）' AS line FROM (SELECT document_id, coalesce(nullif(title, ''), document_id) AS t, day FROM items)""")
def sup_appendix_lines(s, d):
    from quire.operators import timeline

    return digest.appendix_lines(timeline.dated(_live(s, d), "created_at"))


@query(_LIB + f"""SELECT document_id, CASE WHEN length(t) > 60 THEN substr(t, 1, 59) || '…' ELSE t END AS summary, CASE WHEN length(m) > 200 THEN substr(m, 1, 200) || chr(10) || '…（已截断）' ELSE m END AS truncated FROM (SELECT document_id, coalesce(list_filter(list_transform(string_split(coalesce(current_markdown, ''), chr(10)), lambda x: {_strip("regexp_replace(" + _strip('x') + ", '^#+', '')")}), lambda x: x <> '')[1], document_id) AS t, coalesce(current_markdown, '') AS m FROM lib)""")
def str_one_line(s, d):
    return _live(s, d).select("document_id", digest.one_line("current_markdown", "document_id").alias("summary"), digest.truncated("current_markdown", 200).alias("truncated"))


@query("SELECT sha256(string_agg(h, chr(30) ORDER BY h)) AS fingerprint FROM (SELECT sha256(tag || chr(31) || coalesce(tag_group, '') || chr(31) || array_to_string(list_sort(coalesce(aliases, [])), chr(30))) AS h FROM tag_vocabulary)")
def plan_vocabulary_fingerprint(s, d):
    return digest.vocabulary_fingerprint(load(s, d, "tag_vocabulary"))


@query(_LIB + f"SELECT document_id, list_sort({_distinct('list_concat(coalesce(topics, []), coalesce(tags, []))')})[1:2] AS shown, len({_distinct('list_concat(coalesce(topics, []), coalesce(tags, []))')}) > 2 AS truncated FROM lib")
def arr_bounded_labels(s, d):
    return _live(s, d).select("document_id", digest.bounded(V.labels("topics", "tags"), 2).alias("b")).select("document_id", F.col("b.labels").alias("shown"), "b.truncated")


@query()
def arr_section_replies(s, d):
    known = _live(s, d).select("document_id")
    return digest.section_replies(load(s, d, "tag_inferences").dropDuplicates(["inference_id"]), known, ("tags", "summary"), "inference_id")


@query()
def plan_section_fingerprints(s, d):
    lib = _live(s, d)
    part = F.when(F.size(V.ordered_distinct("topics")) > 0, "topics").otherwise("pending")
    return digest.section_fingerprints(lib.select("document_id", part.alias("part"), T.content_hash("current_markdown").alias("content_hash")), "2023-01-01", "2023-06-30")


# retrieval ---------------------------------------------------------------------------------------


def _pages(s: SparkSession, d: str) -> DataFrame:
    return _live(s, d).where("pdf_id is not null").select(F.col("document_id").alias("key"), F.col("current_markdown").alias("body"), "pdf_id", "page_index")


_PAGE_POST = _LIB + f", post AS (SELECT token, key, count(*) AS weight FROM (SELECT document_id AS key, unnest({_tokens('current_markdown')}) AS token FROM lib WHERE pdf_id IS NOT NULL) GROUP BY ALL)\n"


@query(_PAGE_POST + "SELECT token, key, weight FROM post")
def agg_page_postings(s, d):
    return retrieval.page_postings(_pages(s, d))


@query(_PAGE_POST + """, hits AS (SELECT key, sum(weight)::BIGINT AS score, any_value(pdf_id) AS pdf_id, any_value(page_index) AS page_index FROM post JOIN lib ON document_id = key WHERE token IN ('note', 'page', 'matrix') GROUP BY key ORDER BY score DESC, page_index, key LIMIT 200),
 f AS (SELECT * FROM hits WHERE pdf_id IN (SELECT DISTINCT pdf_id FROM lib WHERE pdf_id IS NOT NULL ORDER BY pdf_id LIMIT 40)), b AS (SELECT *, row_number() OVER (PARTITION BY pdf_id, page_index ORDER BY score DESC, key) AS n FROM f)
SELECT pdf_id, page_index, key, score FROM b WHERE n = 1 ORDER BY score DESC, pdf_id, page_index, key LIMIT 8""")
def join_scoped_hits(s, d):
    pages = _pages(s, d)
    ids = [r[0] for r in pages.select("pdf_id").distinct().orderBy("pdf_id").limit(40).collect()]  # a scope that a reader chose
    return retrieval.scoped_hits(retrieval.page_postings(pages), pages, "note page matrix", ids)


@query("""SELECT doc_id, CASE WHEN contains(t, '[1]') OR contains(t, '[2]') THEN x ELSE x || '（前文提到：第5页、第9页）' END AS answer FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(replace(replace(coalesce(text, ''), '[1]', '（前文提到 第5页）'), '[2]', '（前文提到 第9页）'), '\\[\\d{1,3}\\]', '', 'g') AS x FROM documents WHERE lower(trim(source)) = 'qa_answers')""")
def str_history_answers(s, d):
    return load(s, d, "documents").where(F.lower(F.trim("source")) == "qa_answers").select("doc_id", retrieval.history_answer("text", {1: 5, 2: 9}).alias("answer"))


@query(_LIB + f""", c AS (SELECT tag, count(*) AS n FROM (SELECT unnest({_distinct('tags')}) AS tag FROM lib) GROUP BY tag), m AS (SELECT DISTINCT ON (suggestion_id) suggestion_id, source, target FROM tag_merges)
SELECT suggestion_id, source, target, coalesce(a.n, 0) AS n_source, coalesce(b.n, 0) AS n_target FROM m LEFT JOIN c a ON a.tag = source LEFT JOIN c b ON b.tag = target""")
def agg_merge_plan(s, d):
    return retrieval.merge_plan_summary(load(s, d, "tag_merges").dropDuplicates(["suggestion_id"]), library.facet_counts(_live(s, d), "tags", "tag"))


@query(f"""SELECT model, count(*) AS processed, count(*) FILTER (n > 0) AS with_tags, count(*) FILTER (w <> '') AS failed, sum(n)::BIGINT AS n_tags FROM (SELECT model, len({_distinct('tags')}) AS n, {_strip("coalesce(warning, '')")} AS w FROM (SELECT DISTINCT ON (inference_id) * FROM tag_inferences)) GROUP BY model""")
def agg_inference_runs(s, d):
    return retrieval.inference_report(load(s, d, "tag_inferences").dropDuplicates(["inference_id"]))


@query("""SELECT event_type, count(*) AS n, round(sum(value), 3) AS sequential_seconds, round(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6, 3) AS wall_seconds, round(sum(value) / nullif(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6, 0), 6) AS speed_up FROM events GROUP BY event_type""")
def agg_run_timing(s, d):
    return retrieval.timing(load(s, d, "events"), "event_type", "ts", "value")


@query()
def str_search_blocks(s, d):
    return retrieval.split_blocks(_live(s, d), "document_id", "current_markdown").select("key", "block", F.length("text").alias("n_chars"), "heading")
