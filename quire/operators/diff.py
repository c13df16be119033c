"""Block parsing and diffs of text versions.

A text is a list of blocks (heading, list, table, code, formula, quote, paragraph). Two versions are
compared block by block: identical contents are paired by nearest index, the rest greedily by Dice
similarity of their tokens; pairs outside the longest rising sequence have moved. Null texts are
empty; two empty texts don't differ.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FENCE = re.compile(r"^```")


def blocks(text: str | None) -> list[tuple[str, str]]:
    """STR-66: (type, text) of each block."""
    out: list[tuple[str, str]] = []
    lines, i = (text or "").split("\n"), 0
    while i < len(lines):
        x = lines[i]
        if not x.strip():
            i += 1
        elif _FENCE.match(x):
            j = i + 1
            while j < len(lines) and not _FENCE.match(lines[j]):
                j += 1
            out.append(("code", "\n".join(lines[i + 1 : j])))
            i = j + 1
        elif m := re.match(r"(#{1,6})\s+(.*)", x):
            out.append(("heading", m[2].strip()))
            i += 1
        else:
            kind = "table" if x.startswith("|") else "quote" if x.startswith(">") else "formula" if x.startswith("$$") else "list" if re.match(r"\s*(?:[-*+]|\d+[.)])\s", x) else "image" if x.startswith("![") else "paragraph"
            j = i + 1
            while j < len(lines) and lines[j].strip() and not _FENCE.match(lines[j]) and not re.match(r"#{1,6}\s", lines[j]):
                j += 1
            out.append((kind, "\n".join(lines[i:j])))
            i = j
    return out


def form(text: str) -> str:
    """STR-27"""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text)).strip().lower()


def tokens(text: str) -> list[str]:
    """STR-28: words, and single and paired Han characters."""
    n = form(text)
    out = re.findall(r"[a-z0-9_]+", n)
    for run in re.findall(r"[㐀-䶿一-鿿豈-﫿]+", n):
        out += [*run, *(run[i : i + 2] for i in range(len(run) - 1))]
    return out


def dice(a: list[str], b: list[str]) -> float:
    """SET-03"""
    if not a or not b:
        return float(not a and not b)
    return 2 * (Counter(a) & Counter(b)).total() / (len(a) + len(b))


def rising(seq: list[int]) -> set[int]:
    """WIN-19: places of a longest strictly rising subsequence."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(seq):
        k = bisect_left(tails, v)
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
        back.append(at[k - 1] if k else -1)
    out, i = set(), at[-1] if at else -1
    while i >= 0:
        out.add(i)
        i = back[i]
    return out


def compare(a: list[tuple[str, str]], b: list[tuple[str, str]], modified: float = 0.5) -> list[tuple[str, str, int | None, int | None, float]]:
    """DIFF-01, DIFF-02: (op, type, index in a, index in b, similarity)."""
    ka, kb = [(t, form(x)) for t, x in a], [(t, form(x)) for t, x in b]
    free: dict[tuple, list[int]] = {}
    for j, k in enumerate(kb):
        free.setdefault(k, []).append(j)
    pairs: dict[int, tuple[int, float]] = {}
    for i, k in enumerate(ka):
        if free.get(k):
            j = min(free[k], key=lambda j: (abs(i - j), j))
            free[k].remove(j)
            pairs[i] = (j, 1.0)
    used = {j for j, _ in pairs.values()}
    ta = {i: tokens(a[i][1]) for i in range(len(a)) if i not in pairs}
    tb = {j: tokens(b[j][1]) for j in range(len(b)) if j not in used}
    cand = sorted((-s, i, j) for i, x in ta.items() for j, y in tb.items() if a[i][0] == b[j][0] and (s := dice(x, y)) >= modified)
    for s, i, j in cand:
        if i not in pairs and j not in used:
            pairs[i] = (j, -s)
            used.add(j)
    same = [i for i in sorted(pairs) if pairs[i][1] == 1.0]
    stay = {same[k] for k in rising([pairs[i][0] for i in same])}
    out = []
    for i in range(len(a)):
        if i in pairs:
            j, s = pairs[i]
            op = "modified" if s < 1 else "unchanged" if i in stay else "moved"
            out.append((op, a[i][0], i, j, round(s, 4)))
        else:
            out.append(("removed", a[i][0], i, None, 0.0))
    out += [("added", b[j][0], None, j, 0.0) for j in range(len(b)) if j not in used]
    return sorted(out, key=lambda c: (c[3] if c[3] is not None else c[2], c[2] if c[2] is not None else -1, c[0]))


def edit_ops(pred: str, gold: str) -> tuple[int, int, int]:
    """MATH-01: inserted, deleted and substituted characters that turn gold into pred."""
    n, m = len(gold), len(pred)
    row = [(j, j, 0, 0) for j in range(m + 1)]
    for i in range(1, n + 1):
        new = [(i, 0, i, 0)]
        for j in range(1, m + 1):
            if gold[i - 1] == pred[j - 1]:
                new.append(row[j - 1])
                continue
            s, d, x = row[j - 1], row[j], new[j - 1]
            low = min(s[0], d[0], x[0])
            if s[0] == low:
                new.append((low + 1, s[1], s[2], s[3] + 1))
            elif d[0] == low:
                new.append((low + 1, d[1], d[2] + 1, d[3]))
            else:
                new.append((low + 1, x[1] + 1, x[2], x[3]))
        row = new
    return row[m][1:]


def overlap(a: list[tuple[str, str]], b: list[tuple[str, str]], reach: int = 8) -> int:
    """MATH-11: largest number of blocks at the end of a that are the first of b."""
    ka, kb = [(t, form(x)) for t, x in a], [(t, form(x)) for t, x in b]
    return next((k for k in range(min(reach, len(ka), len(kb)), 0, -1) if ka[-k:] == kb[:k]), 0)


def diff_versions(pairs: DataFrame) -> DataFrame:
    """Changes of version pairs (pair_id, text_a, text_b)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *c) for p, x, y in zip(pdf["pair_id"], pdf["text_a"], pdf["text_b"]) for c in compare(blocks(x), blocks(y))]
            out = pd.DataFrame(rows, columns=["pair_id", "op", "block_type", "index_a", "index_b", "similarity"])
            yield out.astype({"index_a": "Int32", "index_b": "Int32"})

    return pairs.select("pair_id", "text_a", "text_b").mapInPandas(work, "pair_id string, op string, block_type string, index_a int, index_b int, similarity double")


def summary(changes: DataFrame, minor: float = 0.25) -> DataFrame:
    """AGG-26, MATH-12: counts by op, density of changes and verdict of each pair."""
    ops = [F.count_if(F.col("op") == o).alias(f"n_{o}") for o in ("unchanged", "moved", "modified", "removed", "added")]
    s = changes.groupBy("pair_id").agg(*ops)
    changed = F.col("n_modified") * 2 + F.col("n_moved") * 2 + F.col("n_removed") + F.col("n_added")
    total = 2 * (F.col("n_unchanged") + F.col("n_moved") + F.col("n_modified")) + F.col("n_removed") + F.col("n_added")
    density = F.round(changed / F.greatest(total, F.lit(1)), 4)
    return s.withColumn("density", density).withColumn("verdict", F.when(changed == 0, "unchanged").when(density <= minor, "minor").otherwise("major"))


def block_rows(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(key, block, block_type, text) of every block."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, t, x) for k, s in zip(pdf["key"], pdf["body"]) for i, (t, x) in enumerate(blocks(s))]
            yield pd.DataFrame(rows, columns=["key", "block", "block_type", "text"])

    return docs.select(F.col(key).cast("string").alias("key"), F.col(body).alias("body")).mapInPandas(work, "key string, block int, block_type string, text string")


def edit_operations(pairs: DataFrame) -> DataFrame:
    """MATH-01, MATH-02: edit operations and rate of (pair_id, pred, gold)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, x, y in zip(pdf["pair_id"], pdf["pred"], pdf["gold"]):
                i, d, s = edit_ops(x or "", y or "")
                rows.append((p, i, d, s, (i + d + s) / max(len(y or ""), 1)))
            yield pd.DataFrame(rows, columns=["pair_id", "inserted", "deleted", "substituted", "edit_rate"])

    return pairs.select("pair_id", "pred", "gold").mapInPandas(work, "pair_id string, inserted int, deleted int, substituted int, edit_rate double")


def likeness(a: str, b: str) -> float:
    """STR-33: matching blocks of two texts without blanks, as a share of their length."""
    from difflib import SequenceMatcher

    x, y = re.sub(r"\s+", "", a).lower(), re.sub(r"\s+", "", b).lower()
    return 1.0 if x == y else SequenceMatcher(None, x, y, autojunk=False).ratio()


def align(a: list[tuple[str, str]], b: list[tuple[str, str]], gap: float = -0.55, least: float = 0.55) -> list[tuple[int | None, int | None, float]]:
    """JOIN-23: global alignment; blocks below ``least`` are never paired."""
    n, m = len(a), len(b)
    sim = [[likeness(x[1], y[1]) if x[0] == y[0] else 0.0 for y in b] for x in a]
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        best[i][0] = i * gap
    for j in range(1, m + 1):
        best[0][j] = j * gap
    pair = lambda i, j: 0.95 if sim[i][j] >= 0.95 else 0.3 if sim[i][j] >= least else -9.0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best[i][j] = max(best[i - 1][j - 1] + pair(i - 1, j - 1), best[i - 1][j] + gap, best[i][j - 1] + gap)
    out, i, j = [], n, m
    while i or j:
        if i and j and best[i][j] == best[i - 1][j - 1] + pair(i - 1, j - 1):
            i, j = i - 1, j - 1
            out.append((i, j, sim[i][j]))
        elif i and (not j or best[i][j] == best[i - 1][j] + gap):
            i -= 1
            out.append((i, None, 0.0))
        else:
            j -= 1
            out.append((None, j, 0.0))
    return out[::-1]


def verify(a: list[tuple[str, str]], b: list[tuple[str, str]], sure: float = 0.95) -> tuple[int, int, int, bool]:
    """DIFF-03, WIN-20: blocks that agree, stand on one side only, or conflict; and whether the order changed."""
    ka = [(t, re.sub(r"\s+", "", x).lower()) for t, x in a]
    free: dict[tuple, list[int]] = {}
    for j, (t, x) in enumerate(b):
        free.setdefault((t, re.sub(r"\s+", "", x).lower()), []).append(j)
    exact = {}
    for i, k in enumerate(ka):
        if free.get(k):
            exact[i] = free[k].pop(0)
    flipped = any(x >= y for x, y in zip(list(exact.values()), list(exact.values())[1:]))
    ra = [x for i, x in enumerate(a) if i not in exact]
    rb = [x for j, x in enumerate(b) if j not in set(exact.values())]
    agree, one, conflict = len(exact), 0, 0
    for i, j, s in align(ra, rb):
        if i is None or j is None:
            one += 1
        elif s >= sure:
            agree += 1
        else:
            conflict += 1
    return agree, one, conflict, flipped


def cross_validate(pairs: DataFrame) -> DataFrame:
    """DIFF-03, AGG-38 over (pair_id, text_a, text_b): counts and the share of blocks in doubt."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, x, y in zip(pdf["pair_id"], pdf["text_a"], pdf["text_b"]):
                agree, one, conflict, flipped = verify(blocks(x), blocks(y))
                rows.append((p, agree, one, conflict, flipped, round((one + conflict) / max(agree + one + conflict, 1), 4)))
            yield pd.DataFrame(rows, columns=["pair_id", "consistent", "one_side", "conflict", "order_changed", "divergence"])

    return pairs.select("pair_id", "text_a", "text_b").mapInPandas(work, "pair_id string, consistent int, one_side int, conflict int, order_changed boolean, divergence double")


def repeated_blocks(docs: DataFrame, key: str, body: str, least: float = 0.85) -> DataFrame:
    """DIFF-04: groups of like blocks within one text: their number and least similarity of a linked pair."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, text in zip(pdf["key"], pdf["body"]):
                bl = [(t, x) for t, x in blocks(text) if len(x) >= 20]
                tk = [tokens(x) for _, x in bl]
                root = list(range(len(bl)))

                def find(i: int, root=root) -> int:
                    while root[i] != i:
                        root[i] = root[root[i]]
                        i = root[i]
                    return i

                low: dict[int, float] = {}
                links = [(dice(tk[i], tk[j]), i, j) for i in range(len(bl)) for j in range(i + 1, len(bl)) if bl[i][0] == bl[j][0] and min(len(tk[i]), len(tk[j])) * 2 >= least * (len(tk[i]) + len(tk[j]))]
                links = [x for x in links if x[0] >= least]
                for _, i, j in links:
                    root[find(j)] = find(i)
                for s, i, _ in links:
                    low[find(i)] = min(s, low.get(find(i), 1.0))
                for r, s in sorted(low.items()):
                    rows.append((k, sum(find(i) == r for i in range(len(bl))), round(s, 4)))
            yield pd.DataFrame(rows, columns=["key", "n_blocks", "least_similarity"])

    return docs.select(F.col(key).cast("string").alias("key"), F.col(body).alias("body")).mapInPandas(work, "key string, n_blocks int, least_similarity double")


def continuity(pairs: DataFrame, reach: int = 8, least: float = 0.5) -> DataFrame:
    """JOIN-13 second tier, MATH-10/11, DIFF-06: pairs whose end and beginning overlap, and the merged length.

    Both directions are tried; the larger overlap wins, ties go to (a, b).
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, x, y in zip(pdf["pair_id"], pdf["text_a"], pdf["text_b"]):
                a, b = blocks(x), blocks(y)
                ab, ba = overlap(a, b, reach), overlap(b, a, reach)
                k, way = (ab, "a-b") if ab >= ba else (ba, "b-a")
                ratio = k / max(1, min(reach, len(a), len(b)))
                if k and ratio >= least:
                    rows.append((p, way, k, round(ratio, 4), len(a) + len(b) - k))
            yield pd.DataFrame(rows, columns=["pair_id", "direction", "overlap", "ratio", "merged_blocks"])

    return pairs.select("pair_id", "text_a", "text_b").mapInPandas(work, "pair_id string, direction string, overlap int, ratio double, merged_blocks int")
