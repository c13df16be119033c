"""Dates of document metadata (DATE-03, DATE-07..12, DATE-14, DATE-15).

All are column expressions. Null and blank values give null; a date that the calendar lacks gives
null; repeated spellings of a date in a text count by their first place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import values as V
from quire.functions.text import _c, stripped, text

# How a date is written, the fields that name one, and the grades of confidence.
DATE = r"(?<!\d)(19\d{2}|20\d{2})\s*[-/.年]\s*(\d{1,2})\s*[-/.月]\s*(\d{1,2})\s*日?"
FIELD = r"(?im)^\s*(?:date|document_date|document_time|created|created_at|手稿日期)\s*:\s*([^#\n]+)"
CONFIDENCES = ("high", "medium", "low")
EDITABLE = ("document_time", "capture_time")
_ISO = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?(Z|[+-]\d{2}:\d{2})?)?$"
_AROUND = 48


def _made(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def flexible_date(c: str | Column) -> Column:
    """DATE-07: the first date of a text, with - / . or 年月日 between its parts, or eight digits alone."""
    t = stripped(text(c))
    written = t.rlike(DATE)
    parts = [F.regexp_extract(t, DATE, i) for i in (1, 2, 3)]
    packed = F.when(t.rlike(r"^(?:19|20)\d{6}$"), _made(F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2)))
    return F.when(written, _made(*parts)).otherwise(packed)


def exif_timestamp(c: str | Column) -> Column:
    """DATE-09: a camera's timestamp in its three forms, as ``yyyy-MM-ddTHH:mm:ss``."""
    t = F.trim(text(c))
    form = r"^(\d{4})([:-])(\d{2})\2(\d{2})([ T])(\d{2}):(\d{2}):(\d{2})$"
    g = {i: F.regexp_extract(t, form, i) for i in range(1, 9)}
    day = _made(g[1], g[3], g[4])
    fits = t.rlike(form) & ~((g[2] == ":") & (g[5] == "T")) & (g[6] < "24") & (g[7] < "60") & (g[8] < "60") & day.isNotNull()
    return F.when(fits, F.concat(F.concat_ws("-", g[1], g[3], g[4]), F.lit("T"), F.concat_ws(":", g[6], g[7], g[8])))


def normal_timestamp(c: str | Column, field: str) -> Column:
    """DATE-10: a date for ``document_time``; else ISO seconds, midnight for a bare ISO date, and dates of other forms as dates."""
    day = F.date_format(flexible_date(c), "yyyy-MM-dd")
    if field == "document_time":
        return day
    t = stripped(text(c))
    g = {i: F.regexp_extract(t, _ISO, i) for i in range(1, 6)}
    real = F.try_to_date(g[1], "yyyy-MM-dd").isNotNull() & (g[2] < "24") & (g[3] < "60") & (g[4] < "60")
    clock = F.when(g[2] == "", "00:00:00").otherwise(F.concat_ws(":", g[2], g[3], F.when(g[4] == "", "00").otherwise(g[4])))
    zone = F.when(g[5] == "Z", "+00:00").otherwise(g[5])
    return F.when(t.rlike(_ISO) & real, F.concat(g[1], F.lit("T"), clock, zone)).otherwise(day)


def local_time(c: str | Column, zone: str = "Asia/Shanghai") -> Column:
    """DATE-11: wall-clock time in ``zone``; a value without zone is taken as such a time already."""
    t = normal_timestamp(c, "import_time")
    wall = F.to_timestamp_ntz(F.substring(F.when(F.length(t) == 10, F.concat(t, F.lit("T00:00:00"))).otherwise(t), 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    sign = F.when(F.substring(t, 20, 1) == "-", -1).otherwise(1)
    minutes = sign * (F.substring(t, 21, 2).try_cast("int") * 60 + F.substring(t, 24, 2).try_cast("int"))
    utc = wall - F.make_dt_interval(mins=minutes)
    return F.when(F.length(t) > 19, F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)).otherwise(wall)


def inferred_date(c: str | Column) -> Column:
    """DATE-08: (date, confidence, evidence) of a document's own date.

    A named field wins, then the first eight lines and headings among the first twelve, both with
    high confidence, then the first date anywhere with medium. Evidence is the text around it.
    """
    body = text(c)
    blank = F.struct(F.lit(None).cast("date").alias("date"), F.lit(None).cast("string").alias("confidence"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("found"))

    def in_line(line: Column, before: Column) -> Column:
        """All dates of a line; the first that the calendar has counts."""
        return F.transform(
            F.regexp_extract_all(line, F.lit(DATE), F.lit(0)),
            lambda d: F.struct(flexible_date(d).alias("date"), F.lit("high").alias("confidence"), (before + F.instr(line, d)).alias("place"), d.alias("found")),
        )

    fields = F.transform(
        F.regexp_extract_all(body, F.lit(FIELD), F.lit(0)),
        lambda whole: F.struct(
            flexible_date(F.regexp_extract(F.regexp_extract(whole, FIELD, 1), DATE, 0)).alias("date"), F.lit("high").alias("confidence"),
            (F.instr(body, whole) + F.instr(whole, F.regexp_extract(F.regexp_extract(whole, FIELD, 1), DATE, 0)) - 1).alias("place"),
            F.regexp_extract(F.regexp_extract(whole, FIELD, 1), DATE, 0).alias("found"),
        ),
    )
    lines = F.slice(F.split(body, "\n"), 1, 12)
    early = F.flatten(F.transform(lines, lambda line, i: F.when(
        (stripped(line) != "") & ((i < 8) | stripped(line).startswith("#")),
        in_line(line, F.aggregate(F.slice(lines, F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x) + 1)),
    ).otherwise(F.array().cast("array<struct<date:date,confidence:string,place:int,found:string>>"))))
    first = F.regexp_extract(body, DATE, 0)
    anywhere = F.struct(flexible_date(first).alias("date"), F.lit("medium").alias("confidence"), F.instr(body, first).alias("place"), first.alias("found"))
    real = lambda a: F.try_element_at(F.filter(a, lambda x: x["date"].isNotNull()), F.lit(1))
    best = F.coalesce(real(fields), real(early), F.when(anywhere["date"].isNotNull(), anywhere), blank)
    start = F.greatest(best["place"] - _AROUND, F.lit(1))
    end = best["place"] + F.length(best["found"]) + _AROUND
    evidence = F.trim(F.regexp_replace(F.substring(body, start, end - start), r"\s+", " "))
    return F.struct(best["date"].alias("date"), best["confidence"].alias("confidence"), F.when(best["date"].isNotNull(), evidence).alias("evidence"))


def normal_slot(c: Column, field: str) -> Column:
    """DATE-12: a slot in its public form; unknown confidences become null, a manual source sets the mark."""
    source = F.coalesce(F.when(c["source"] != "", c["source"]), F.when(c["manual"], F.lit("manual")).otherwise("none"))
    return F.struct(
        normal_timestamp(c["value"], field).alias("value"), source.alias("source"),
        F.when(c["confidence"].isin(*CONFIDENCES), c["confidence"]).alias("confidence"), F.when(c["evidence"] != "", c["evidence"]).alias("evidence"),
        (F.coalesce(c["manual"], F.lit(False)) | (source == "manual")).alias("manual"),
    )


def normal_metadata(docs: DataFrame) -> DataFrame:
    """DATE-12: one row a document and slot."""
    slots = F.array(*(F.struct(F.lit(s).alias("slot_name"), normal_slot(F.col(f"metadata.{s}"), s).alias("s")) for s in V.SLOTS))
    return docs.select("document_id", F.explode(slots).alias("x")).select("document_id", "x.slot_name", "x.s.*")


def effective_metadata(docs: DataFrame) -> DataFrame:
    """DATE-03: the first slot with a normal value, of document, capture and import time."""
    tries = []
    for s in V.SLOTS:
        n = normal_slot(F.col(f"metadata.{s}"), s)
        tries.append(F.when(n["value"].isNotNull(), F.struct(F.lit(s).alias("field"), n["value"].alias("value"), n["source"].alias("source"), n["confidence"].alias("confidence"))))
    return docs.select("document_id", F.coalesce(*tries).alias("e")).select("document_id", "e.*")


def guarded_updates(updates: DataFrame) -> DataFrame:
    """DATE-14: what becomes of edits (document_id, field, value): set, cleared, or the rule they break."""
    value = F.coalesce(*(F.when(F.col("field") == f, normal_timestamp("value", f)) for f in EDITABLE))
    empty = F.coalesce(F.col("value") == "", F.lit(True))
    status = F.when(~F.col("field").isin(*EDITABLE), "system_field").when(empty, "cleared").when(value.isNull(), "no_time").otherwise("set")
    return updates.select("document_id", "field", F.when(status == "set", value).alias("value"), status.alias("status"))


def checked_inference(replies: DataFrame) -> DataFrame:
    """DATE-15: replies (document_id, date, confidence, evidence) that may be stored; others give a null value."""
    day = F.when(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date("date", "yyyy-MM-dd"))
    good = day.isNotNull() & F.coalesce(F.col("confidence").isin(*CONFIDENCES), F.lit(False)) & F.coalesce(F.length("evidence").between(1, 400), F.lit(False))
    return replies.select(
        "document_id", F.when(good, F.date_format(day, "yyyy-MM-dd")).alias("value"), F.when(good, "inferred").alias("source"),
        F.when(good, F.col("confidence")).alias("confidence"), F.when(good, stripped(_c("evidence"))).alias("evidence"),
    )
