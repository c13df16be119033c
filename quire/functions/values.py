"""Column functions over arrays, maps, dates and numbers (ARR-*, DATE-*, MATH-*, SET-*)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import _c, stripped, text

SLOTS = ("document_time", "capture_time", "import_time")


def ordered_distinct(c: str | Column) -> Column:
    """ARR-01, SET-09: trimmed, without blanks and repeats, first places kept; null as empty."""
    a = F.coalesce(_c(c), F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(a, lambda x: stripped(text(x))), lambda x: x != ""))


def union_ordered(a: str | Column, b: str | Column) -> Column:
    """SET-04: the first list's order, then what the second adds."""
    return F.array_distinct(F.concat(ordered_distinct(a), ordered_distinct(b)))


def labels(topics: str | Column, tags: str | Column) -> Column:
    """SET-06: sorted labels of both kinds."""
    return F.array_sort(union_ordered(topics, tags))


def memberships(manual: str | Column, auto: str | Column) -> Column:
    """ARR-03: collections of a record, those chosen by hand first."""
    return union_ordered(manual, auto)


def tag_provenance(tags: str | Column, provenance: str | Column) -> Column:
    """ARR-09: one entry per tag, ``manual`` where nothing is known, orphans dropped."""
    p = F.coalesce(_c(provenance), F.create_map().cast("map<string,string>"))
    return F.transform(ordered_distinct(tags), lambda t: F.struct(t.alias("tag"), F.coalesce(F.try_element_at(p, t), F.lit("manual")).alias("source")))


def slot_value(slot: str) -> Column:
    v = F.col(f"metadata.{slot}.value")
    return F.when(v != "", v)


def effective_time(fallback: str | None = None) -> Column:
    """DATE-01, DATE-02: first filled slot, with its value and source.

    With ``fallback`` (a column name) a record without slots takes that value.
    """
    tries = [
        F.when(
            slot_value(s).isNotNull(),
            F.struct(F.lit(s).alias("field"), slot_value(s).alias("value"), F.coalesce(F.when(F.col(f"metadata.{s}.source") != "", F.col(f"metadata.{s}.source")), F.lit(s)).alias("source")),
        )
        for s in SLOTS
    ]
    if fallback:
        tries.append(F.when(F.length(fallback) > 0, F.struct(F.lit("import_time").alias("field"), F.col(fallback).alias("value"), F.lit("import_fallback").alias("source"))))
    return F.coalesce(*tries)


def day_of(c: str | Column) -> Column:
    """DATE-06: date in the first ten characters, null where it is none."""
    head = F.substring(_c(c), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd"))


def iso_week(day: str | Column) -> Column:
    """WIN-03: ISO year and week, as 2024-W05."""
    d = _c(day)
    thursday = F.date_add(d, F.lit(3) - F.weekday(d))
    return F.concat(F.year(thursday).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def week_start(day: str | Column) -> Column:
    return F.date_sub(_c(day), F.weekday(_c(day)))


def hamming(a_hi: Column, a_lo: Column, b_hi: Column, b_lo: Column) -> Column:
    """MATH-03: differing bits of two hashes held as 32-bit halves."""
    return F.bit_count(a_hi.bitwiseXOR(b_hi)) + F.bit_count(a_lo.bitwiseXOR(b_lo))


def hash_similarity(distance: str | Column, bits: int = 64) -> Column:
    """MATH-04, MATH-05: share of equal bits, at least 0."""
    return F.greatest(F.lit(0.0), 1 - F.greatest(_c(distance), F.lit(0)) / F.lit(bits)) if bits else F.lit(1.0)


def edit_rate(pred: str | Column, gold: str | Column) -> Column:
    """MATH-02: edits per character of the right text."""
    return F.levenshtein(text(pred), text(gold)) / F.greatest(F.length(text(gold)), F.lit(1))


def verdict(changed: str | Column, total: str | Column, minor: float = 0.25) -> Column:
    """MATH-12: unchanged, minor or major."""
    density = _c(changed) / F.greatest(_c(total), F.lit(1))
    return F.when(_c(changed) == 0, "unchanged").when(density <= minor, "minor").otherwise("major")
