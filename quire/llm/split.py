"""Splitting of oversized texts at natural boundaries, with overlap.

The least number of pieces is computed from the limit and the overlap, equal-length targets are
placed, and each target is moved to the strongest boundary near it. If a piece then exceeds the
limit, or a cut finds no natural boundary and one more piece would, one more piece is used and the
targets are placed anew; without any boundary the targets themselves are cut, so a solution always
exists.

Lengths are Unicode code points. Consecutive pieces share exactly the stated overlap. Defined
results: null texts give no piece; texts within the limit, the empty text included, come out as one
piece; an item kind without a limit, or with a limit below 1, isn't split; a negative overlap is 0
and one above half of the limit is half of it; repeated rows of one key count once; an empty table
gives an empty result. Extra columns are left out, so their names cannot clash.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strength of the boundary before a position, strongest first.
_BOUNDARIES = (
    (6.0, re.compile(r"\n+(?=#{1,6} |\d{1,2} [A-Z一-鿿][^\n.。]{2,60}\n)")),
    (5.0, re.compile(r"\n[ \t]*\n+")),
    (3.0, re.compile(r"(?<=[.!?。！？])[\"'”’)]*\n")),
    (2.5, re.compile(r"(?<=[.!?])[\"'”’)]* +(?=[\"'“(]?[A-Z一-鿿])|(?<=[。！？])(?=[^\n\"'”’)])")),
    (1.5, re.compile(r"\n")),
    (1.0, re.compile(r"(?<=[;:,])\s|(?<=[，；：、])")),
    (0.5, re.compile(r"\s+")),
)
_FENCE = re.compile(r"^```.*?(?:^```|\Z)|^\$\$.*?\$\$", re.M | re.S)


def boundaries(text: str, lo: int, hi: int) -> list[tuple[int, float]]:
    """(position, strength) of cuts within ``lo`` .. ``hi``; a piece ends before the position."""
    out: dict[int, float] = {}
    for strength, form in _BOUNDARIES:
        for m in form.finditer(text, max(0, lo - 2), min(len(text), hi + 80)):
            if lo <= m.end() <= hi and m.end() not in out:
                out[m.end()] = strength
    return sorted(out.items())


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int, float]]:
    """(start, end, strength of the boundary at the end) of each piece."""
    n = len(text)
    if n <= limit:
        return [(0, n, 9.0)]
    fenced = [(m.start(), m.end()) for m in _FENCE.finditer(text)]
    starts = [a for a, _ in fenced]

    def inside(p: int) -> bool:
        k = bisect_right(starts, p) - 1
        return k >= 0 and fenced[k][0] < p < fenced[k][1]

    least = -(-(n - overlap) // (limit - overlap))
    best: tuple[float, list[tuple[int, float]]] | None = None
    for count in range(least, least + 8):
        step = (n - overlap) / count
        reach = max(1, int(step * 0.45))
        ends: list[tuple[int, float]] = []
        start = 0
        for k in range(1, count):
            target = int(k * step) + overlap
            # what is left must fit into the pieces that are left
            lowest = max(n - (count - k) * (limit - overlap), start + overlap + 1, target - reach)
            highest = min(start + limit, n - 1, target + reach)
            if lowest > highest:
                break
            pick, top = (min(max(target, lowest), highest), 0.0), -1.0
            for p, s in boundaries(text, lowest, highest):
                if inside(p):
                    s *= 0.1
                score = s - 2.0 * abs(p - target) / reach
                if score > top or (score == top and p < pick[0]):
                    pick, top = (p, s), score
            ends.append(pick)
            start = pick[0] - overlap
        else:
            weakest = min((s for _, s in ends), default=9.0)
            if best is None or weakest > best[0]:
                had, best = best, (weakest, ends)
                if weakest >= 1.5 or had is not None:
                    break  # a sentence, a line or more everywhere; or one more piece did better
            else:
                break  # one more piece doesn't help where there is nothing to cut at
    if best is None:
        step = (n - overlap) / least
        best = (0.0, [(int(k * step) + overlap, 0.0) for k in range(1, least)])
    out, start = [], 0
    for e, s in best[1]:
        out.append((start, e, s))
        start = e - overlap
    return [*out, (start, n, 9.0)]


def split(items: DataFrame, limits: DataFrame, with_text: bool = True) -> DataFrame:
    """Pieces (item_kind, item_id, piece, start, end, strength[, text]) of items (item_kind, item_id, text).

    ``limits`` has item_kind, max_chars and overlap_chars; it holds one row a kind and is broadcast
    after its size was checked.
    """
    lim = limits.groupBy("item_kind").agg(F.min("max_chars").alias("max_chars"), F.max("overlap_chars").alias("overlap_chars"))
    if lim.count() > 10_000:
        raise ValueError("more item kinds than a broadcast may hold")
    rows = items.select("item_kind", "item_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(lim), "item_kind", "left")
    over = (F.col("max_chars") >= 1) & (F.length("text") > F.col("max_chars"))
    whole = rows.where(~F.coalesce(over, F.lit(False))).select(
        "item_kind", "item_id", F.lit(0).alias("piece"), F.lit(0).alias("start"), F.length("text").alias("end"), F.lit(9.0).alias("strength"), *(["text"] if with_text else [])
    )
    schema = "item_kind string, item_id string, piece int, start int, end int, strength double" + ", text string" * with_text

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for kind, item, text, limit, overlap in pdf[["item_kind", "item_id", "text", "max_chars", "overlap_chars"]].itertuples(index=False):
                limit = int(limit)
                ov = 0 if overlap is None or overlap != overlap else min(max(0, int(overlap)), limit // 2)
                for k, (a, b, s) in enumerate(cuts(text, limit, ov)):
                    out.append((kind, item, k, a, b, s, *([text[a:b]] if with_text else [])))
            yield pd.DataFrame(out, columns=["item_kind", "item_id", "piece", "start", "end", "strength", *(["text"] if with_text else [])])

    return whole.unionByName(rows.where(over).mapInPandas(work, schema))


def library_items(jobs: DataFrame, papers: DataFrame) -> DataFrame:
    """(item_kind, item_id, text) of the jobs and papers, once per key."""
    j = jobs.select(F.lit("job").alias("item_kind"), F.col("job_id").alias("item_id"), F.col("markdown").alias("text"))
    p = papers.select(F.lit("paper").alias("item_kind"), F.col("document_id").alias("item_id"), F.col("full_text").alias("text"))
    return j.unionByName(p).where(F.col("item_id").isNotNull())


def found(jobs: DataFrame, papers: DataFrame, limits: DataFrame) -> DataFrame:
    """Items that came out in more than one piece."""
    pieces = split(library_items(jobs, papers), limits, with_text=False)
    return pieces.where(F.col("piece") > 0).select("item_kind", "item_id").distinct()
