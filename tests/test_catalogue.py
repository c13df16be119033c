"""Dates, changes to records, typed documents, digests: fixed cases, nulls, empty tables."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from quire.operators import curation, dates, digest, governance, ir, library, similarity


def one(spark, column, *values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(column.alias("x")).collect()]


def brute_date(text):
    for m in re.finditer(r"(?<!\d)(19\d{2}|20\d{2})\s*[-/.年]\s*(\d{1,2})\s*[-/.月]\s*(\d{1,2})\s*日?", text or ""):
        try:
            return date(*map(int, m.groups()))
        except ValueError:
            return None
    return None


def test_flexible_dates(spark):
    given = ["on 2024-3-9.", "2024年2月30日", "20240131", "2024/12/01 and 2023.1.1", "12024-01-01", " ", None, "20241399"]
    assert one(spark, dates.flexible_date("v"), *given) == [date(2024, 3, 9), None, date(2024, 1, 31), date(2024, 12, 1), None, None, None, None]


def test_timestamps_of_cameras_and_slots(spark):
    assert one(spark, dates.exif_timestamp("v"), "2020:01:02 03:04:05", "2020-01-02T03:04:05", "2020:01:02T03:04:05", "2020:02:30 00:00:00", None) == ["2020-01-02T03:04:05", "2020-01-02T03:04:05", None, None, None]
    got = one(spark, dates.normal_timestamp("v", "import_time"), "2024-01-02", "2024-01-02T03:04Z", "2024-01-02 03:04:05.9+08:00", "2024/1/2", "2024-01-02T25:00", "x", None)
    assert got == ["2024-01-02T00:00:00", "2024-01-02T03:04:00+00:00", "2024-01-02T03:04:05+08:00", "2024-01-02", "2024-01-02", None, None]
    local = [str(x) if x else None for x in one(spark, dates.local_time("v"), "2024-01-02T03:04:05Z", "2024-01-02T03:04:05", "2024-01-02T03:04:05-05:30", None)]
    assert local == ["2024-01-02 11:04:05", "2024-01-02 03:04:05", "2024-01-02 16:34:05", None]


def test_inferred_dates(spark):
    texts = ["# Notes\ndate: 2021-05-06\n2020-01-01", "Intro 2020-02-31\nat 2020-03-04", "\n" * 20 + "late 2019/7/8 text", "nothing", "", None]
    got = one(spark, dates.inferred_date("v"), *texts)
    assert [(g.date, g.confidence) for g in got] == [(date(2021, 5, 6), "high"), (date(2020, 3, 4), "high"), (date(2019, 7, 8), "medium"), (None, None), (None, None), (None, None)]
    assert got[2].evidence == "late 2019/7/8 text" and "2021-05-06" in got[0].evidence and got[3].evidence is None
    for t, g in zip(texts[2:3], got[2:3]):
        assert brute_date(t) == g.date


def test_pairs_are_rejected_and_confirmed(spark):
    known = spark.createDataFrame([("a|b", 9), ("c|d", 1)], "pair string, distance int")
    new = spark.createDataFrame([("b", "a", 3), ("a", "b", 4), ("e", "e", 1), (None, "x", 1)], "a string, b string, distance int")
    assert {tuple(r) for r in curation.reject(known, new).collect()} == {("a|b", 3), ("c|d", 1)}
    docs = spark.createDataFrame([("a",), ("b",), ("b",)], "document_id string")
    rel, left = curation.confirm(docs, new, known)
    assert {(r.source, r.target) for r in rel.collect()} == {("a", "b"), ("b", "a")} and [r.pair for r in left.collect()] == ["c|d"]
    assert curation.confirm(docs.limit(0), new, known)[0].count() == 0


def test_chains_and_cycles_end_at_their_ends(spark):
    rows = [("a", "b"), ("b", "c"), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "z"), *((f"n{i:03d}", f"n{i + 1:03d}") for i in range(100))]
    got = {r.source: r.target for r in library.resolve_chains(spark.createDataFrame(rows, "source string, target string")).collect()}
    assert got["a"] == got["b"] == "c" and {got[k] for k in "xyzw"} == {"x"} and {got[f"n{i:03d}"] for i in range(100)} == {"n100"}
    assert library.resolve_chains(spark.createDataFrame([], "source string, target string")).count() == 0


def test_layers_go_as_deep_as_the_graph(spark):
    rows = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(70)]
    got = {r.node: r.layer for r in governance.layers(spark.createDataFrame(rows, "source string, target string")).collect()}
    assert got["n070"] == 70 and got["n000"] == 0


def test_tags_keep_their_provenance(spark):
    df = spark.createDataFrame([(["b", "a", "b", " "], ["a", "c", None]), (None, None)], "tags array<string>, new array<string>")
    p = curation.added_provenance(curation.provenance("tags", "manual"), "new", "auto")
    got = [[(x.tag, x.source) for x in r[0]] for r in df.select(p).collect()]
    assert got == [[("b", "manual"), ("a", "manual"), ("c", "auto")], []]
    vocabulary = spark.createDataFrame([("graph theory", ["graphs"]), ("x", None)], "tag string, aliases array<string>")
    rows = spark.createDataFrame([(1, ["Graphs", "GRAPH_THEORY", "#New one", None, ""]), (2, None)], "document_id int, tags array<string>")
    assert [tuple(r) for r in curation.canonical_tags(rows, vocabulary).collect()] == [(1, ["graph theory", "new one"], ["new one"])]
    grown = {r.tag: r.aliases for r in curation.ensured_vocabulary(vocabulary, spark.createDataFrame([("Graphs",), ("#Fresh",), (None,)], "raw string")).collect()}
    assert grown == {"graph theory": ["Graphs", "graphs"], "x": [], "fresh": ["Fresh"]}


def test_collections(spark):
    registry = spark.createDataFrame([("c1", "One", None), ("c2", "Two", "t")], "collection_id string, collection_name string, topic string")
    docs = spark.createDataFrame([("d", ["c1"], None), ("e", None, ["c1", "c1"])], "document_id string, manual_collections array<string>, auto_collections array<string>")
    assert {(r[0], tuple(r[1]), tuple(r[2])) for r in curation.drop_collection(docs, registry, "c1").collect()} == {("d", (), ()), ("e", (), ())}
    with pytest.raises(ValueError, match="topic"):
        curation.drop_collection(docs, registry, "c2")
    wanted = spark.createDataFrame([("d", ["c2", "zz"]), ("e", ["c2"])], "document_id string, collections array<string>")
    assert {(r[0], tuple(r[1]), tuple(r[2])) for r in curation.set_collections(docs, wanted, registry).collect()} == {("d", ("c1",), ("zz",)), ("e", ("c2",), ())}
    more = curation.registered(registry, spark.createDataFrame([("one", "topic"), ("New name", None), (" ", None)], "name string, topic string"))
    assert {tuple(r) for r in more.collect()} == {("c1", "One", "topic"), ("c2", "Two", "t"), ("new-name", "New name", None)}
    plan = spark.createDataFrame([("d", "c2"), ("e", "c1"), ("e", "c2")], "document_id string, collection_id string")
    assert {tuple(r) for r in curation.apply_assignments(docs, plan).collect()} == {("d", "c2", "skipped"), ("e", "c1", "had"), ("e", "c2", "applied")}


DOC = """{"document_type":"note","blocks":[{"type":"heading","level":2,"text":"A*b"},{"type":"list","ordered":false,"items":[{"text":"x","items":[{"text":"y"}]},{"text":"z"}]},
{"type":"formula","latex":"x^2","inline":true},{"type":"code","content":"a ``` b"},{"type":"quote","text":"p\\nq"},{"type":"table","headers":["h|"],"rows":[["1"]],"caption":"cap"},
{"type":"flow","caption":"f","nodes":[{"id":"b","label":"B","note":"n"},{"id":"a","label":"A"}],"edges":[{"from":"a","to":"b","style":"dashed"},{"from":"a","to":"zz"}],"groups":[{"id":"g","label":"G","nodes":["b","a"]}]}]}"""


def test_documents_render(spark):
    text = one(spark, ir.render(ir.load("v"), F.lit("d")), DOC)[0]
    assert text.startswith("## A\\*b\n\n- x\n\n  - y\n- z\n\n$x^2$\n\n````\na ``` b\n````\n\n> p\n> q\n\n| h\\| |\n| --- |\n| 1 |\n\n*cap*\n\n![f](attachments/d-6.png)\n\n<!-- diagram-semantics: ")
    assert '"dashed_edges":[["a","b"]]' in text and '"notes":{"b":"n"}' in text
    assert one(spark, ir.render(ir.load("v"), F.lit("d")), '{"blocks":[]}') == [""]


def test_documents_are_checked(spark):
    cases = {
        DOC: None, '{"blocks":[]}': None, "nonsense": "unreadable", None: "unreadable", '{"blocks":[],"more":1}': "extra_key", '{"blocks":[{"type":"odd"}]}': "unknown_block",
        '{"blocks":[{"type":"heading","level":7,"text":"x"}]}': "bad_level", '{"blocks":[{"type":"paragraph"}]}': "missing_field", '{"blocks":[{"type":"flow","groups":[{"id":"g","nodes":["q"]}]}]}': "bad_group",
    }
    assert one(spark, ir.errors("v"), *cases) == list(cases.values())


def test_diagrams(spark):
    flow = ir.load("v")["blocks"][6]
    ids = F.transform(flow["nodes"], lambda n: n["id"])
    assert [tuple(e) for e in one(spark, ir.canonical_edges(flow["edges"], ids), DOC)[0]] == [("a", "b", "", "dashed")]
    assert [tuple(g) for g in one(spark, ir.canonical_groups(flow["groups"], ids), DOC)[0]] == [("g", "G", "cluster", ["a", "b"])]
    assert one(spark, ir.compared_text(flow), DOC) == ["f | B | A | A->B | A->zz"]
    good = '{"nodes":[{"id":"a"},{"id":"b"}],"edges":[{"from":"a","to":"b"}]}'
    cases = {good: "ok", '{"error":"none"}': "no_flow", '{"nodes":[],"edges":[]}': "malformed", good.replace('"to":"b"', '"to":"a"'): "malformed", good.replace('"id":"b"', '"id":"a"'): "malformed", "x": "malformed", None: "malformed"}
    assert one(spark, ir.diagram_verdict("v"), *cases) == list(cases.values())


def test_section_replies(spark):
    replies = spark.createDataFrame([(1, '```json\n{"sections":{"topics":{"markdown":" t ","source_document_ids":["a","zz","a"]},"pending":"p"}}\n```'), (2, "plain"), (3, None), (4, 'say {"topics":{"text":"u"}} ok')], "reply_id int, raw string")
    allowed = spark.createDataFrame([("a",)], "document_id string")
    got = {(r.reply_id, r.section, r.markdown, tuple(r.source_document_ids), r.mode) for r in digest.section_replies(replies, allowed, ("topics", "pending")).collect()}
    assert got == {(1, "topics", "t", ("a",), "json"), (1, "pending", "p", (), "json"), (2, None, "", (), "text"), (3, None, "", (), "text"), (4, "topics", "u", (), "json")}


def test_chapters_have_no_gaps(spark):
    mods = digest.modules(spark.createDataFrame([(0, "results", None, True), (1, "plans", "Plans", True), (2, "results", "again", True), (3, "issues", "x", True), (4, "Bad key", "x", True)], "place int, key string, title string, enabled boolean"))
    bodies = spark.createDataFrame([("overview", "o", ["d"]), ("plans", "p", ["d"]), ("results", "r", [])], "key string, markdown string, ids array<string>")
    assert [(r.number, r.key, r.title) for r in digest.chapters(mods, bodies).orderBy("number").collect()] == [(1, "overview", "1、概览"), (2, "progress", "2、进展"), (3, "plans", "3、Plans"), (4, "issues", "4、问题与求助")]


def test_stored_digests(spark):
    m = spark.createDataFrame([("1", "2024-01-01", "f", [("topics", "s", "old")]), ("2", "2024-02-01", "f", [("topics", "s", "new")]), (" ", "2025-01-01", "f", [])], "digest_id string, created_at string, fingerprint string, sections array<struct<key:string,fingerprint:string,markdown:string>>")
    assert digest.newest_match(m, "f").first().digest_id == "2" and digest.newest_section(m, "topics", "s").first().markdown == "new" and digest.newest_match(m, "g").count() == 0


def test_range_statistics_of_nothing(spark):
    slot = "struct<value:string,source:string,confidence:string,evidence:string,manual:boolean>"
    docs = spark.createDataFrame([], f"document_id string, created_at string, current_markdown string, topics array<string>, tags array<string>, metadata struct<document_time:{slot},capture_time:{slot},import_time:{slot}>")
    items = spark.createDataFrame([], "document_id string, day date")
    r = digest.range_stats(items, docs, "2024-01-01", "2024-01-31").first()
    assert r.document_count == 0 and r.parse_success_rate is None and r.topic_count == 0
    assert "无材料" in digest.overview_text(digest.range_stats(items, docs, "2024-01-01", "2024-01-31")).first()[0]


def test_hamming_segments_lose_no_pair(spark):
    import random

    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(20)]
    rows = [(i, x) for i, x in enumerate(b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 9))) for b in base for _ in range(5))]
    df = spark.createDataFrame([(i, x >> 32, x & 0xFFFFFFFF) for i, x in rows], "key int, hi long, lo long")
    want = {(a, b, (x ^ y).bit_count()) for a, x in rows for b, y in rows if a < b and (x ^ y).bit_count() <= 12}
    assert {tuple(r) for r in similarity.hamming_pairs(df, 12).collect()} == want
    for joined in (1, 2, 3):
        k = similarity.hamming_keys(df, 6, joined)
        assert {(r.a, r.b) for r in similarity._near(k, k, 6).where("a < b").collect()} == {(a, b) for a, b, n in want if n <= 6}
