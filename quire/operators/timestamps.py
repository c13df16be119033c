"""Normalisation of mixed timestamp spellings to one UTC form.

A value is read under every format that fits it. Where a numeric date fits several orders, the
order is chosen by a mixture model per source: the weights of ``dmy``, ``mdy`` and ``ymd`` are
estimated by expectation-maximisation over the counts of readable-order sets of that source (an
aggregate of at most seven rows a source), starting from the order the source is registered with,
which wins wherever the value can be read that way. A source without one starts from the mixture of
all values, which also stands for values without a source. ``order_posterior`` is the posterior of the
reading taken, ``resolved`` is false where it is below ``RESOLVED``: such values stay ambiguous.

Defined results: null and blank values give no row; ``invalid`` has no complete real date or an
impossible time; ``nozone`` needs a zone but has no registered source; ``ambiguous`` is a
wall-clock time that occurred twice; ``nonexistent`` one that was skipped. An empty table gives an
empty result. Repeated rows of one key count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from datetime import UTC, date, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import cut

SLOTS = ("document_time", "capture_time", "import_time")
ORDERS = ("dmy", "mdy", "ymd")
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}Z$"
#: Weights of up to this many sources are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 200_000
#: Pseudo-counts of a registered order, and of the mixture of all values for an unregistered source.
PRIOR_WEIGHT, POOLED_WEIGHT = 50.0, 2.0
RESOLVED = 0.9

_MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
_MONTH_NAMES = ("january february march april may june july august september october november december").split()
_TIME = r"(?P<h>\d{1,2})[:.](?P<mi>\d{2})(?:[:.](?P<s>\d{2})(?:[.,](?P<f>\d+))?)?\s*(?P<ap>[AaPp]\.?[Mm]\.?)?"
_ZONE = r"\s*(?P<z>Z|[+-]\d{2}(?::?\d{2})?|[A-Za-z]{2,5})?"
_TAIL = rf"(?:[T ,]+{_TIME}{_ZONE})?"
_FORMS = [
    ("ymd", re.compile(rf"(?P<y>\d{{4}})(?P<sep>[-/.:])(?P<m>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}}){_TAIL}")),
    ("num", re.compile(rf"(?P<p>\d{{1,2}})(?P<sep>[-/.])(?P<q>\d{{1,2}})(?P=sep)(?P<r>\d{{4}}|\d{{2}}){_TAIL}")),
    ("ymd", re.compile(rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})T(?P<h>\d{{2}})(?P<mi>\d{{2}})(?P<s>\d{{2}})?(?:[.,](?P<f>\d+))?{_ZONE}")),
    ("ymd", re.compile(r"(?P<y>\d{4})\s*年\s*(?P<m>\d{1,2})\s*月\s*(?P<d>\d{1,2})\s*日(?:\s*(?P<h>\d{1,2})\s*[时時点](?:\s*(?P<mi>\d{1,2})\s*分)?(?:\s*(?P<s>\d{1,2})\s*秒)?)?")),
    ("week", re.compile(rf"(?P<y>\d{{4}})-?W(?P<w>\d{{2}})-?(?P<wd>\d){_TAIL}")),
    ("ordinal", re.compile(rf"(?P<y>\d{{4}})-(?P<n>\d{{3}}){_TAIL}")),
    ("ymd", re.compile(rf"(?:[A-Za-z]{{3,9}},?\s+)?(?P<d>\d{{1,2}})(?:st|nd|rd|th)?[ .-]+(?P<mn>[A-Za-z]{{3,9}})\.?,?[ -]+(?P<y>\d{{4}}){_TAIL}")),
    ("ymd", re.compile(rf"(?:[A-Za-z]{{3,9}},?\s+)?(?P<mn>[A-Za-z]{{3,9}})\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}}){_TAIL}")),
]
_EPOCH = datetime(1970, 1, 1)


def _month(name: str) -> int | None:
    n = name.lower()
    k = _MONTHS.get(n[:3])
    return k if k and (_MONTH_NAMES[k - 1].startswith(n) or n == "sept") else None


def _date(y: int, m: int, d: int) -> date | None:
    try:
        return date(y, m, d)
    except ValueError:
        return None


def _micros(digits: str | None) -> int:
    return int((digits or "0")[:6].ljust(6, "0"))


def read(value: str) -> tuple[dict[str, date], tuple[int, int, int, int], str | None] | datetime | None:
    """All readings of a value: dates by order, time of day and zone text; or an instant; or None."""
    s = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", value)).strip().replace("−", "-")
    if m := re.fullmatch(r"(\d{4})(\d{2})(\d{2})(?:(\d{2})(\d{2})(?:(\d{2}))?)?", s):
        if len(s) in (8, 12, 14) and (d := _date(int(m[1]), int(m[2]), int(m[3]))) and 1900 <= d.year < 2100:
            t = tuple(int(x or 0) for x in (m[4], m[5], m[6]))
            if t[0] < 24 and t[1] < 60 and t[2] < 60:
                return {"ymd": d}, (*t, 0), None
            return None
    if m := re.fullmatch(r"(-?)(\d+)(?:\.(\d+))?", s):
        n = len(m[2])
        if n < 5:
            return None
        scale = 1 if n <= 11 else 10**3 if n <= 14 else 10**6 if n <= 17 else 10**9
        micros = int(m[2]) * 10**6 // scale + (_micros(m[3]) if scale == 1 else 0)
        try:
            return _EPOCH + timedelta(microseconds=-micros if m[1] else micros)
        except OverflowError:
            return None
    for kind, form in _FORMS:
        m = form.fullmatch(s)
        if not m:
            continue
        g = m.groupdict()
        h, mi, sec = (int(g.get(k) or 0) for k in ("h", "mi", "s"))
        if ap := (g.get("ap") or "").lower().replace(".", ""):
            if not 1 <= h <= 12:
                return None
            h = h % 12 + 12 * (ap == "pm")
        if h > 23 or mi > 59 or sec > 59:
            return None
        dates: dict[str, date | None]
        if kind == "num":
            p, q, r = int(g["p"]), int(g["q"]), int(g["r"])
            long = len(g["r"]) == 4
            y = r if long else 2000 + r
            dates = {"dmy": _date(y, q, p), "mdy": _date(y, p, q)}
            if not long and len(g["p"]) == 2:
                dates["ymd"] = _date(2000 + p, q, r)
        elif kind == "week":
            try:
                dates = {"ymd": date.fromisocalendar(int(g["y"]), int(g["w"]), int(g["wd"]))}
            except ValueError:
                return None
        elif kind == "ordinal":
            d = _date(int(g["y"]), 1, 1)
            d = d and int(g["n"]) > 0 and d + timedelta(days=int(g["n"]) - 1)
            dates = {"ymd": d if d and d.year == int(g["y"]) else None}
        else:
            mo = _month(g["mn"]) if g.get("mn") else int(g["m"])
            dates = {"ymd": _date(int(g["y"]), mo, int(g["d"])) if mo else None}
        good = {k: v for k, v in dates.items() if v}
        return (good, (h, mi, sec, _micros(g.get("f"))), g.get("z")) if good else None
    return None


@lru_cache(maxsize=4096)
def abbreviations(zone: str) -> dict[str, int]:
    """Offsets in seconds by the abbreviations a zone has used since 1990."""
    z, out = ZoneInfo(zone), {}
    for y in range(1990, datetime.now(UTC).year + 2):
        for mth in range(1, 13):
            t = datetime(y, mth, 2, 12, tzinfo=z)
            out[t.tzname()] = int(t.utcoffset().total_seconds())
    return out


@lru_cache(maxsize=4096)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None


# Abbreviations with one usual meaning, for devices in another zone.
_COMMON = {"CET": 1, "CEST": 2, "EST": -5, "EDT": -4, "AEST": 10, "AEDT": 11, "BST": 1, "WET": 0, "WEST": 1, "EET": 2, "EEST": 3, "PST": -8, "PDT": -7, "MST": -7, "MDT": -6, "CDT": -5, "JST": 9, "KST": 9}


def resolve(value: str, zone: str | None, weights: dict[str, float]) -> tuple[str, float]:
    """UTC text or the reason why there is none, and the posterior of the reading chosen."""
    got = read(value)
    if got is None:
        return "invalid", 1.0
    if isinstance(got, datetime):
        return got.strftime("%Y-%m-%dT%H:%M:%S.%fZ").rjust(27, "0"), 1.0
    dates, (h, mi, s, us), ztext = got
    post = 1.0
    if len(set(dates.values())) == 1:
        day = next(iter(dates.values()))
    else:
        # orders that give one day are one reading
        by_day: dict[date, float] = {}
        for k, v in dates.items():
            by_day[v] = by_day.get(v, 0.0) + weights.get(k, 1e-6)
        day = max(by_day, key=lambda v: (by_day[v], v))
        post = by_day[day] / sum(by_day.values())
    wall = datetime(day.year, day.month, day.day, h, mi, s, us)
    off: int | None = None
    if ztext:
        up = ztext.upper()
        if up in ("Z", "UTC", "GMT", "UT"):
            off = 0
        elif ztext[0] in "+-":
            hh, mm = int(ztext[1:3]), int(ztext[3:].lstrip(":") or 0)
            if hh > 18 or mm > 59:
                return "invalid", post
            off = (hh * 3600 + mm * 60) * (-1 if ztext[0] == "-" else 1)
        else:
            known = abbreviations(zone) if zone and _zone(zone) else None
            if known is None:
                return ("nozone" if up.isalpha() else "invalid"), post
            if up in known:
                off = known[up]
            elif up in _COMMON:
                off = _COMMON[up] * 3600
            else:
                return "invalid", post
    if off is None:
        z = _zone(zone) if zone else None
        if z is None:
            return "nozone", post
        a = wall.replace(tzinfo=z).utcoffset()
        b = wall.replace(tzinfo=z, fold=1).utcoffset()
        if a != b:
            return ("ambiguous" if a > b else "nonexistent"), post
        off = int(a.total_seconds())
    try:
        return (wall - timedelta(seconds=off)).strftime("%Y-%m-%dT%H:%M:%S.%fZ").rjust(27, "0"), post
    except OverflowError:
        return "invalid", post


def expectation_maximisation(
    counts: dict[frozenset[str], float], prior: dict[str, float], rounds: int = 50
) -> dict[str, float]:
    """Mixture weights of the orders, from counts of readable-order sets and pseudo-counts."""
    w = {k: prior.get(k, 0.0) + 1e-3 for k in ORDERS}
    for _ in range(rounds):
        n = {k: prior.get(k, 0.0) + 1e-3 for k in ORDERS}
        for s, c in counts.items():
            total = sum(w[k] for k in s)
            for k in s:
                n[k] += c * w[k] / total
        total = sum(n.values())
        new = {k: v / total for k, v in n.items()}
        if max(abs(new[k] - w[k]) for k in ORDERS) < 1e-9:
            return new
        w = new
    return w


def slot_values(records: DataFrame) -> DataFrame:
    """(document_id, slot_name, device_id, value) of every slot value that is not null or blank."""
    one = records.select("document_id", "device_id", "metadata").dropDuplicates(["document_id"])
    return one.select(
        "document_id",
        "device_id",
        F.explode(
            F.array(*(F.struct(F.lit(s).alias("slot_name"), F.col(f"metadata.{s}.value").alias("value")) for s in SLOTS))
        ).alias("s"),
    ).select("document_id", "s.slot_name", "device_id", "s.value").where(
        F.length(F.regexp_replace("value", r"(?U)\s+", "")) > 0
    )


def _readable() -> tuple[Column, Column, Column, Column]:
    part = [F.regexp_extract("value", r"^\s*(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})(?!\d)", i) for i in (1, 2, 3)]
    p, q, r = (F.when(x != "", x.cast("int")) for x in part)
    short = F.length(part[2]) == 2
    return p.isNotNull(), (p <= 31) & (q <= 12), (p <= 12) & (q <= 31), short & (q <= 12) & (r <= 31)


def order_weights(values: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per source: zone_name and the weights w_dmy, w_mdy, w_ymd; device_id is null for the mixture of all values."""
    numeric, dmy, mdy, ymd = _readable()
    counts = cut(
        values.where(numeric)
        .select("device_id", dmy.alias("dmy"), mdy.alias("mdy"), ymd.alias("ymd"))
        .groupBy("device_id", "dmy", "mdy", "ymd")
        .agg(F.count("*").alias("n"))
    )
    # three marks make eight rows at most
    every = counts.groupBy("dmy", "mdy", "ymd").agg(F.sum("n").alias("n")).collect()

    def sets_of(rows) -> dict[frozenset[str], float]:
        out: dict[frozenset[str], float] = {}
        for x in rows:
            key = frozenset(k for k in ORDERS if x[k])
            if key:
                out[key] = out.get(key, 0) + x["n"]
        return out

    pooled = expectation_maximisation(sets_of(every), {})
    sets = counts.where("device_id is not null").groupBy("device_id").agg(F.collect_list(F.struct("dmy", "mdy", "ymd", "n")).alias("sets"))
    registered = sources.select("device_id", "zone_name", "date_order").where(F.col("device_id").isNotNull()).dropDuplicates(["device_id"])
    both = registered.join(sets, "device_id", "full_outer")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for dev, zone, order, seen in pdf[["device_id", "zone_name", "date_order", "sets"]].itertuples(index=False):
                prior = {order: PRIOR_WEIGHT} if order in ORDERS else {k: POOLED_WEIGHT * v for k, v in pooled.items()}
                w = expectation_maximisation(sets_of(seen if isinstance(seen, (list, np.ndarray)) else []), prior)
                if order in ORDERS:  # the registered order wins wherever it can be read
                    w = {k: 1.0 if k == order else 1e-6 * v for k, v in w.items()}
                rows.append((dev, zone, *(w[k] for k in ORDERS)))
            yield pd.DataFrame(rows, columns=["device_id", "zone_name", "w_dmy", "w_mdy", "w_ymd"])

    schema = "device_id string, zone_name string, w_dmy double, w_mdy double, w_ymd double"
    one = values.sparkSession.createDataFrame([(None, None, *(pooled[k] for k in ORDERS))], schema)
    return both.mapInPandas(fit, schema).unionByName(one)


def normalise_timestamps(values: DataFrame, sources: DataFrame) -> DataFrame:
    """``values`` (document_id, slot_name, device_id, value) with utc_text, order_posterior and resolved."""
    weights = cut(order_weights(values, sources))
    pooled = dict(zip(ORDERS, weights.where("device_id is null").select("w_dmy", "w_mdy", "w_ymd").first()))
    weights = weights.where("device_id is not null")
    if weights.count() <= BROADCAST_SOURCES:
        weights = F.broadcast(weights)
    joined = values.join(weights, "device_id", "left").select("document_id", "slot_name", "value", "zone_name", "w_dmy", "w_mdy", "w_ymd")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple, tuple[str, float]] = {}
        for pdf in batches:
            out = []
            for v, z, a, b, c in zip(pdf["value"], pdf["zone_name"], pdf["w_dmy"], pdf["w_mdy"], pdf["w_ymd"]):
                key = (v, z, a, b, c) if a == a else (v, z)
                r = seen.get(key)
                if r is None:
                    if len(seen) > 100_000:
                        seen.clear()
                    w = {"dmy": a, "mdy": b, "ymd": c} if a == a and a is not None else pooled
                    r = seen[key] = resolve(v, z, w)
                out.append(r)
            yield pd.DataFrame({
                "document_id": pdf["document_id"], "slot_name": pdf["slot_name"], "value": pdf["value"],
                "utc_text": [x[0] for x in out], "order_posterior": [x[1] for x in out], "resolved": [x[1] >= RESOLVED for x in out],
            })

    return joined.mapInPandas(parse, "document_id string, slot_name string, value string, utc_text string, order_posterior double, resolved boolean")


def found(records: DataFrame, scanners: DataFrame) -> DataFrame:
    """Every slot value not yet in the target form, with its instant in UTC or the reason."""
    values = slot_values(records).where(~F.col("value").rlike(CANONICAL))
    return normalise_timestamps(values, scanners).select("document_id", "slot_name", "utc_text").distinct()
