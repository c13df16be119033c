"""Blocks, scopes, earlier answers, runs and prices: fixed cases, nulls, empty tables."""

import re

import pytest

from quire.operators import retrieval, search


def brute_blocks(text):
    blocks, current, heading = [], [], None

    def flush():
        if current:
            blocks.append(("\n".join(current), heading))

    for line in (text or "").replace("\r\n", "\n").split("\n"):
        if not line.strip():
            flush()
            current = []
            continue
        if re.match(r"#{1,6}\s", line):
            flush()
            current, heading = [], line.strip().lstrip("#").strip() or None
        current.append(line)
    flush()
    return blocks or [("", None)]


@pytest.mark.parametrize("text", ["a\nb\n\nc", "# H\nx\n## K\n\ny\n\n\n z\n", "\n \n", "", None, "one\r\n\r\ntwo", "p\n# Q\nr", "#no heading\n\n# Yes\n\ntail"])
def test_blocks(spark, text):
    df = spark.createDataFrame([("d", text)], "k string, body string")
    got = [(r.text, r.heading) for r in retrieval.split_blocks(df, "k", "body").orderBy("block").collect()]
    assert got == brute_blocks(text)


def test_scope_and_retrieval(spark):
    assert retrieval.scope([" a", None, "", "b", "a"]) == ["a", "b"] and retrieval.scope(None) == []
    pages = spark.createDataFrame([("1", "graph graph", "p", 0), ("2", "graph", "p", 0), ("3", "graph theory", "q", 4), ("4", None, "r", 1)], "key string, body string, pdf_id string, page_index int")
    index = retrieval.page_postings(pages)
    assert [r.key for r in retrieval.scoped_hits(index, pages, "graph", ["p"]).collect()] == ["1"]
    assert [r.key for r in retrieval.scoped_hits(index, pages, "graph", []).collect()] == ["1", "3"]
    assert retrieval.scoped_hits(index, pages, "", []).count() == 0 and retrieval.scoped_hits(index, pages.limit(0), "graph", ["p", "q"]).count() == 0
    docs = spark.createDataFrame([("1", "T", "graph graph"), ("3", "U", "")], "key string, title string, body string")
    assert {(r.key, r.snippet) for r in retrieval.document_hits(search.match(index, "graph", "any"), docs, ["graph"]).collect()} == {("1", "graph graph"), ("3", "U")}
    assert retrieval.search_message([], 1, 0) == "empty_query" and retrieval.search_message(["x"], 0, 0) == "empty_library" and retrieval.search_message(["x"], 1, 0) == "no_match"


def test_earlier_answers(spark):
    df = spark.createDataFrame([("see [1] and [7]",), ("plain",), (None,)], "t string")
    assert [r[0] for r in df.select(retrieval.history_answer("t", {1: 3})).collect()] == ["see （前文提到 第3页） and ", "plain（前文提到：第3页）", "（前文提到：第3页）"]


def test_prices_and_flags(spark):
    raw = '{"currency":"USD","models":{"m":{"prompt_per_million":"2","completion_per_million":-1},"n":{"x":1},"k":{"reasoning_per_million":0}}}'
    df = spark.createDataFrame([(raw,), ("nonsense",), (None,)], "t string")
    got = [[tuple(x) for x in r[0]] for r in df.select(retrieval.price_table("t")).collect()]
    assert got == [[("m", 2.0, None, None), ("k", None, None, 0.0)], [], []]
    flags = spark.createDataFrame([([None, False],), ([True, None],), ([None],), (None,)], "f array<boolean>")
    assert [r[0] for r in flags.select(retrieval.cached_state("f")).collect()] == [False, True, None, None]


def test_events_of_records_and_digests(spark):
    docs = spark.createDataFrame([("a", "2024"), ("b", "2025")], "document_id string, created_at string")
    versions = spark.createDataFrame([("a", "2024-01", "m"), ("a", "2024-02", "m"), ("zz", "2024", "m")], "document_id string, at string, model string")
    events = retrieval.document_events(docs, versions)
    assert sorted(map(str, events.collect())) == sorted(map(str, [*versions.where("document_id = 'a'").collect(), *docs.where("document_id = 'b'").selectExpr("document_id", "created_at as at", "cast(null as string) as model").collect()]))
    digests = spark.createDataFrame([("g", "2024", "m")], "digest_id string, at string, model string")
    assert retrieval.with_digest_events(events, digests).where("is_document").count() == 3
