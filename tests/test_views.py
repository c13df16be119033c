from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from quire.operators import details, governance, library, timeline, timestamps


def test_resolve_range():
    today = date(2024, 5, 15)
    assert governance.resolve_range("this_week", today) == (date(2024, 5, 13), date(2024, 5, 19))
    assert governance.resolve_range("previous_week", today) == (date(2024, 5, 6), date(2024, 5, 12))
    assert governance.resolve_range("custom", today, today, today) == (today, today)
    with pytest.raises(ValueError):
        governance.resolve_range("custom", today, today, date(2024, 1, 1))


def test_layers_with_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "x"), ("x", "y"), ("y", "x"), ("z", "z")], "source string, target string")
    got = {r.node: r.layer for r in governance.layers(e).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "x": 3, "y": 0}


def test_reply_tags(spark):
    rows = [(1, '```json\n{"tags": ["A_b", "a b"]}\n```'), (2, '{"tags": [null]}'), (3, "no json"), (4, None), (5, '{"tags": 3}')]
    got = {r.inference_id: (r.valid, r.keys) for r in governance.reply_tags(spark.createDataFrame(rows, "inference_id int, raw string")).collect()}
    assert got == {1: (True, ["a b"]), 2: (False, None), 3: (False, None), 4: (False, None), 5: (False, None)}


def test_relation_edges(spark):
    rows = [("d", "- a → b → c\nplain\n* a → b\n→ lone"), ("n", None)]
    got = {tuple(r) for r in governance.relation_edges(spark.createDataFrame(rows, "k string, t string"), "k", "t").collect()}
    assert got == {("d", "a", "b"), ("d", "b", "c")}


@pytest.mark.parametrize(("text", "blank"), [("本页为空白", True), ("整张图像为纯黑色", True), ("无法进行 Markdown 转录。", True), ("图中没有可识别的内容", True), (" ", True), (None, True), ("blank slate theory", False), ("空白是留给读者的", False)])
def test_blank_placeholder(spark, text, blank):
    assert spark.createDataFrame([(text,)], "x string").select(governance.blank_placeholder("x")).first()[0] is blank


def test_budget_guarantees_each_label(spark):
    rows = [(f"d{i:03d}", date(2024, 1, 1 + i % 28), ["common"], []) for i in range(40)] + [("old", date(2020, 1, 1), ["rare"], [])]
    items = spark.createDataFrame(rows, "document_id string, day date, topics array<string>, tags array<string>")
    got = {r.document_id: r.guaranteed for r in timeline.budget(items, 10, 2).collect()}
    assert len(got) == 10 and got["old"] and sum(got.values()) == 3


def test_current_keeps_the_latest(spark):
    rows = [("a", "old", None, datetime(2024, 1, 1)), ("a", "new", " ", datetime(2024, 1, 2)), ("b", "x", "a", datetime(2024, 1, 1))]
    df = spark.createDataFrame(rows, "document_id string, title string, merged_into string, received_at timestamp")
    assert {(r.document_id, r.title) for r in library.live(df).collect()} == {("a", "new")}


def test_effective_collections_keep_order(spark):
    docs = spark.createDataFrame([("d", ["m", "c1"], ["x", "c2"], ["t"])], "document_id string, manual_collections array<string>, auto_collections array<string>, topics array<string>")
    reg = spark.createDataFrame([("c1", "t"), ("c2", None), ("c3", "t")], "collection_id string, topic string")
    assert details.effective_collections(docs, reg).first().collections == ["m", "c1", "c2", "c3"]


def test_unregistered_source_learns_its_order(spark):
    rows = [(f"d{i}", "new", "document_time", f"0{1 + i % 9}/{13 + i}/2022") for i in range(12)] + [("q", "new", "document_time", "05/06/2022 10:00+00:00")]
    values = spark.createDataFrame(rows, "document_id string, device_id string, slot_name string, value string")
    scanners = spark.createDataFrame([("other", "Europe/London", "dmy")], "device_id string, zone_name string, date_order string")
    got = {r.document_id: (r.utc_text, r.order_posterior) for r in timestamps.normalise_timestamps(values, scanners).collect()}
    assert got["q"][0] == "2022-05-06T10:00:00.000000Z" and got["q"][1] > 0.9
    assert got["d0"][0] == "nozone"
    assert timestamps.normalise_timestamps(values, scanners).where(F.col("utc_text").isNull()).count() == 0
