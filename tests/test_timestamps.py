from datetime import datetime

import pytest

from quire.operators import timestamps as ts

W = {"dmy": 1.0, "mdy": 0.1, "ymd": 0.1}


@pytest.mark.parametrize(
    ("value", "zone", "want"),
    [
        ("2023-01-05T09:15:21+01:00", None, "2023-01-05T08:15:21.000000Z"),
        ("2021-04-02T16:59:07.141246752Z", None, "2021-04-02T16:59:07.141246Z"),
        ("20230102T210542Z", None, "2023-01-02T21:05:42.000000Z"),
        ("1672598690", None, "2023-01-01T18:44:50.000000Z"),
        ("1593049998834", None, "2020-06-25T01:53:18.834000Z"),
        ("2020-W03-3T04:51", "Europe/Berlin", "2020-01-15T03:51:00.000000Z"),
        ("2021-046", "Europe/London", "2021-02-15T00:00:00.000000Z"),
        ("Oct 18, 2021 23:28:02 CEST", "Europe/Berlin", "2021-10-18T21:28:02.000000Z"),
        ("19 January 2023, 12:30:28 AM", "Asia/Kolkata", "2023-01-18T19:00:28.000000Z"),
        ("03/04/2022 10:00", "Europe/Berlin", "2022-04-03T08:00:00.000000Z"),
        ("10/26/2023 10:44 PM", "Europe/Berlin", "2023-10-26T20:44:00.000000Z"),
        ("２０２３－０１－０６　１５：１０：１２", "Asia/Shanghai", "2023-01-06T07:10:12.000000Z"),
        ("2022-10-30 02:30", "Europe/Berlin", "ambiguous"),
        ("2022-03-27 02:30", "Europe/Berlin", "nonexistent"),
        ("2022-03-27 02:30", None, "nozone"),
        ("31.02.2022 10:00", "Europe/Berlin", "invalid"),
        ("2019-12", "Europe/Berlin", "invalid"),
        ("25:61", None, "invalid"),
        ("x" * 10_000, None, "invalid"),
    ],
)
def test_resolve(value, zone, want):
    assert ts.resolve(value, zone, W)[0] == want


def test_mixture_learns_from_clear_values():
    counts = {frozenset({"mdy"}): 40.0, frozenset({"dmy", "mdy"}): 60.0, frozenset({"dmy"}): 1.0}
    w = ts.expectation_maximisation(counts, {})
    assert w["mdy"] > 0.9 and abs(sum(w.values()) - 1) < 1e-6


def test_found_handles_nulls_repeats_and_empty(spark):
    slot = "struct<value string, source string, confidence string, evidence string, manual boolean>"
    schema = f"document_id string, device_id string, metadata struct<document_time {slot}, capture_time {slot}, import_time {slot}>, received_at timestamp, zone_name string"
    v = lambda x: (x, None, None, None, None)
    rows = [
        ("a", "d1", (v("05/06/2022"), None, v("2022-01-01T00:00:00.000000Z")), datetime(2022, 1, 1), "clash"),
        ("a", "d1", (v("05/06/2022"), None, v("2022-01-01T00:00:00.000000Z")), datetime(2022, 1, 2), "clash"),
        ("b", None, (v("2022-05-06"), v(" "), v(None)), datetime(2022, 1, 1), None),
        ("c", "d9", None, None, None),
    ]
    records = spark.createDataFrame(rows, schema)
    scanners = spark.createDataFrame([("d1", "Europe/London", "mdy")], "device_id string, zone_name string, date_order string")
    got = {tuple(r) for r in ts.found(records, scanners).collect()}
    assert got == {("a", "document_time", "2022-05-05T23:00:00.000000Z"), ("b", "document_time", "nozone")}
    assert ts.found(records.limit(0), scanners).count() == 0


def test_unregistered_sources_are_decided_by_the_mixture_or_marked(spark):
    days = [(f"2{i:02d}", "document_time", "us", f"0{1 + i % 9}/2{i % 8}/2021 10:00 +00:00") for i in range(40)]
    rows = [*days, ("x", "document_time", "us", "03/04/2021 10:00 +00:00"), ("y", "document_time", "new", "03/04/2021 10:00 +00:00"), ("z", "document_time", None, "03/04/2021 10:00 +00:00"), ("e", "document_time", "uk", "03/04/2021 10:00 +00:00")]
    values = spark.createDataFrame(rows, "document_id string, slot_name string, device_id string, value string")
    none = spark.createDataFrame([("uk", "Europe/London", "dmy")], "device_id string, zone_name string, date_order string")
    got = {r.document_id: (r.utc_text[:10], r.resolved) for r in ts.normalise_timestamps(values, none).collect()}
    assert got["x"] == ("2021-03-04", True) and got["z"] == ("2021-03-04", True) and got["e"] == ("2021-04-03", True)
    alone = {r.document_id: (r.order_posterior, r.resolved) for r in ts.normalise_timestamps(values.where("document_id in ('y', 'z')"), none.limit(0)).collect()}
    assert all(abs(p - 0.5) < 1e-6 and not ok for p, ok in alone.values())
    assert ts.normalise_timestamps(values.limit(0), none).count() == 0
