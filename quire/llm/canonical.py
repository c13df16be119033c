"""Mapping of freely typed values to the entries of a reference list.

Reference spellings (names, aliases, word rotations, abbreviated words) are indexed in a BK-tree
under the unrestricted Damerau-Levenshtein distance, which obeys the triangle inequality, so a
probe with radius ``r`` visits only children whose edge is within ``r`` of the node's distance and
still returns every entry in reach. The list is broadcast in shards of at most ``shard_entries``
spellings; each shard is searched whole and the shard winners are merged.

Equal spellings are searched once and joined back. Defined results: null and blank values give no
tag (and no occurrence); a value without an entry in reach gives
``(none)``; equal distances go to the smallest name; an empty reference list gives ``(none)``
for every value; repeated rows of one key count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut, spread

NONE = "(none)"
SHARD_ENTRIES = 200_000
#: Searched spellings are broadcast up to this many, else joined by shuffle.
BROADCAST_VALUES = 500_000

# Wrappings that people put around a tag without changing what it means.
BEFORE = ("my", "about", "intro to", "introduction to", "notes on", "关于")
AFTER = ("draft", "homework", "ch", "chapter", "part", "v", "vol", "no")


def distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance (a metric)."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if not n or not m:
        return n or m
    inf = n + m
    last: dict[str, int] = {}
    h = [[inf] * (m + 2) for _ in range(n + 2)]
    for i in range(n + 1):
        h[i + 1][1] = i
    for j in range(m + 1):
        h[1][j + 1] = j
    for i in range(1, n + 1):
        col = 0
        row, up = h[i + 1], h[i]
        ca = a[i - 1]
        for j in range(1, m + 1):
            k, q = last.get(b[j - 1], 0), col
            if ca == b[j - 1]:
                cost, col = 0, j
            else:
                cost = 1
            row[j + 1] = min(
                up[j] + cost, row[j] + 1, up[j + 1] + 1, h[k][q] + (i - k - 1) + 1 + (j - q - 1)
            )
        last[ca] = i
    return h[n + 1][m + 1]


class BKTree:
    """Entries by edit distance; ``within`` returns all of them in reach."""

    def __init__(self, words: Iterable[str]):
        self.root: tuple[str, dict] | None = None
        for w in words:
            self.add(w)

    def add(self, word: str) -> None:
        if self.root is None:
            self.root = (word, {})
            return
        node = self.root
        while True:
            d = distance(word, node[0])
            if d == 0:
                return
            nxt = node[1].get(d)
            if nxt is None:
                node[1][d] = (word, {})
                return
            node = nxt

    def within(self, word: str, radius: int) -> list[tuple[int, str]]:
        out, todo = [], [self.root] if self.root else []
        while todo:
            w, kids = todo.pop()
            d = distance(word, w)
            if d <= radius:
                out.append((d, w))
            todo.extend(kid for e, kid in kids.items() if d - radius <= e <= d + radius)
        return out


def words_of(value: str) -> list[str]:
    """Folded words: compatibility forms, no accents, camel case and separators split."""
    s = unicodedata.normalize("NFKC", value)
    s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))
    s = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", s).casefold()
    return re.findall(r"[^\W_]+", re.sub(r"(?<=\w)[’'](?=s\b)", "", s))


def cores(words: list[str]) -> list[str]:
    """Compact spellings of a value, first as written, then without each wrapping."""
    full = "".join(words)
    out = [full]
    for b in ("", *(x.replace(" ", "") for x in BEFORE)):
        if not full.startswith(b) or len(full) <= len(b):
            continue
        rest = full[len(b):]
        out.append(rest)
        m = re.fullmatch(rf"(.+?)({'|'.join(AFTER)})?(\d*)", rest)
        if m and (m[2] or m[3]):
            out.append(m[1])
            if m[3] and m[2]:
                out.append(m[1] + m[2])
    return list(dict.fromkeys(x for x in out if x))


def radius(core: str) -> int:
    """Edits allowed: none for codes and ideographs, more with length."""
    if not core.isascii():
        return 0
    n = len(core)
    return 0 if n < 5 else 1 if n < 9 else 2 if n < 18 else 3


def spellings(name: str) -> tuple[list[str], list[str]]:
    """Compact spellings of a reference entry: whole words in each rotation, and abbreviated."""
    w = words_of(name)
    turns = [w[i:] + w[:i] for i in range(len(w))] or [[]]
    whole = ["".join(t) for t in turns]
    short = []
    if len(w) > 1:
        for i, x in enumerate(w):
            for n in range(3, min(6, len(x) - 1) + 1):
                y = [*w[:i], x[:n], *w[i + 1:]]
                short += ["".join(y[j:] + y[:j]) for j in range(len(y))]
    return [x for x in whole if x], short


class Index:
    """Two BK-trees, of whole and of abbreviated spellings, with the names behind them."""

    def __init__(self, entries: list[tuple[str, str]]):
        self.exact = {tag for _, tag in entries}
        self.whole: dict[str, set[str]] = {}
        self.short: dict[str, set[str]] = {}
        for spelling, tag in entries:
            whole, short = spellings(spelling)
            for x in whole:
                self.whole.setdefault(x, set()).add(tag)
            for x in short:
                self.short.setdefault(x, set()).add(tag)
        self.tree, self.short_tree = BKTree(sorted(self.whole)), BKTree(sorted(self.short))
        self.seen: dict[str, tuple[str, float]] = {}

    def find(self, value: str) -> tuple[str, float]:
        """The name meant and its cost; lower is better, ``(none)`` at infinity."""
        if value in self.exact:
            return value, 0.0
        got = self.seen.get(value)
        if got is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            got = self.seen[value] = self._find(value)
        return got

    def _find(self, value: str) -> tuple[str, float]:
        best: tuple[float, str] = (float("inf"), NONE)
        forms = cores(words_of(value))
        for k, core in enumerate(forms):
            if core in self.whole:
                best = min(best, (0.01 * k, min(self.whole[core])))
        if best[1] != NONE:
            return best[1], best[0]
        dotted = "." in unicodedata.normalize("NFKC", value)
        for k, core in enumerate(forms):
            for d, w in self.tree.within(core, radius(core)):
                best = min(best, (d + 0.01 * k, min(self.whole[w])))
            if dotted:
                r = min(1, radius(core)) if len(core) > 7 else 0
                for d, w in self.short_tree.within(core, r):
                    best = min(best, (d + 0.5 + 0.01 * k, min(self.short[w])))
        return best[1], best[0]


def reference_entries(vocabulary: DataFrame, tag: str = "tag", aliases: str = "aliases") -> DataFrame:
    """(spelling, tag) of every name and alias."""
    v = vocabulary.where(F.col(tag).isNotNull())
    return (
        v.select(F.explode(F.concat(F.array(tag), F.coalesce(F.col(aliases), F.array().cast("array<string>")))).alias("spelling"), F.col(tag).alias("tag"))
        .where(F.length(F.trim("spelling")) > 0)
        .distinct()
    )


def canonicalise(
    values: DataFrame,
    value: str,
    entries: DataFrame,
    shard_entries: int = SHARD_ENTRIES,
) -> DataFrame:
    """``values`` with the columns ``canonical`` and ``canonical_cost`` (null without a match).

    ``values`` must not have columns of these names. Reference lists beyond ``shard_entries``
    spellings are searched shard by shard, so that no broadcast exceeds that many.
    """
    spark = values.sparkSession
    shards = max(1, -(-entries.count() // shard_entries))
    parts = entries.withColumn("_shard", F.pmod(F.xxhash64("spelling"), F.lit(shards)))
    schema = "value string, canonical string, canonical_cost double"
    # each spelling is searched once, however often it is written
    out = spread(values.select(F.col(value).alias("value")).where(F.length(F.regexp_replace("value", r"(?U)\s+", "")) > 0).distinct())
    for i in range(shards):
        rows = [(r[0], r[1]) for r in parts.where(F.col("_shard") == i).select("spelling", "tag").collect()]
        box = spark.sparkContext.broadcast(rows)

        def search(batches: Iterator[pd.DataFrame], box=box) -> Iterator[pd.DataFrame]:
            index = Index(box.value)
            for pdf in batches:
                names, costs = [], []
                had = zip(pdf["canonical"], pdf["canonical_cost"]) if "canonical" in pdf else ((None, None) for _ in range(len(pdf)))
                for v, (old, cost) in zip(pdf["value"], had):
                    tag, c = index.find(v)
                    if old is not None and old != NONE and (tag == NONE or (cost, old) <= (c, tag)):
                        tag, c = old, cost
                    names.append(tag)
                    costs.append(None if tag == NONE else c)
                yield pd.DataFrame({"value": pdf["value"], "canonical": names, "canonical_cost": pd.array(costs, dtype="Float64")})

        out = out.mapInPandas(search, schema)
    found = cut(out)
    # the mapping has a row a spelling; beyond the bound it is joined by shuffle, where AQE splits hot spellings
    if found.count() <= BROADCAST_VALUES:
        found = F.broadcast(found)
    found = found.withColumnRenamed("value", "_value")
    return values.join(found, values[value] == found["_value"], "left").drop("_value")


def tag_occurrences(inferences: DataFrame, merges: DataFrame) -> DataFrame:
    """(field_name, record_id, pos, value) of every tag written in either table, once per key."""
    tags = (
        inferences.dropDuplicates(["inference_id"])
        .select(F.lit("tags").alias("field_name"), F.col("inference_id").alias("record_id"), F.posexplode("tags").alias("pos", "value"))
    )
    ends = merges.dropDuplicates(["suggestion_id"]).select(
        F.col("suggestion_id").alias("record_id"),
        F.explode(F.array(*(F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in ("source", "target")))).alias("s"),
    )
    ends = ends.select("s.field_name", "record_id", F.lit(0).alias("pos"), "s.value")
    return tags.unionByName(ends).where(F.length(F.regexp_replace("value", r"(?U)\s+", "")) > 0)
