"""Near-duplicate texts: exact similarity join over distinct runs of consecutive tokens.

A text is a sparse bit vector over runs. Its bits are grouped into bands by how frequent they are
in the corpus, and the bits of a band into partitions: a partition holds the runs of a cell of the
hash space, which are as many for every text of a size (``CELL`` on average). For a partner of a
given size, a text may miss only ``M`` of its own bits, so over any set of partitions with
thresholds ``t`` and a sum of ``t + 1`` of at least ``M + k``, at least ``k`` signatures are shared
(generalised pigeonhole). A partition of ``g`` bits is skipped (``t = -1``) or probed by all sets
of ``w`` of its bits (``t = g - w``), ``w`` being 1, 2 or 3. Which band gets which threshold is
allocated by dynamic programming on estimated candidate counts; the estimates come from the counts
of the runs of all texts, in a table of fixed size. The steps are taken in one order for every
text until their sum is reached, so both sides of a similar pair emit the signatures they share.
Candidates are verified with the exact Jaccard similarity: no link is lost.

The cells depend on the power of two below the number of runs. A pair meets at that of its larger
text, so every text emits at its own and, as far as its bits may be missing in so much larger a
partner, at the next. Each signature carries the largest partner it may lead to, so a signature
that only matters for small partners meets only those. Signatures travel in blocks of one bucket
and are joined there by sorted arrays; counts of shared signatures travel in blocks too.

Texts with equal tokens are joined once, as a class. Defined results: null texts and texts
below ``min_chars`` have no links; a text with fewer tokens than a run has all its tokens as its
one run; a text without tokens has no runs and no links; repeated rows of one key count once; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut

# The characters that are tokens by themselves.
SINGLE = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x3040, 0x30FF), (0xAC00, 0xD7A3), (0x20000, 0x2FA1F))
TOKEN = re.compile("[0-9a-z]+|[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in SINGLE) + "]")
#: Cells of the table of run frequencies.
RUN_CELLS = 1 << 22
#: Row numbers of copies, and of texts to verify, are broadcast up to this many, else joined by shuffle.
BROADCAST_ROWS = 1_000_000
CLASSES = 16
#: Least share of all bits in a band.
BAND_SHARE = 1 / 8
#: Bits of a partition on average.
CELL = 2.0
#: Most bits of a partition that a signature joins.
WIDEST = 3
#: What a signature costs, in candidates.
ROW_COST = 3.0
#: Signatures that a candidate must share. Texts emit as many more units, so a similar pair does.
SHARED = 8
#: Signatures of a bucket on average, which one task joins.
BUCKET_ROWS = 1_250_000
#: Texts and characters that are worked on at once.
CHUNK_TEXTS, CHUNK_CHARS = 1 << 10, 2_000_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * _M1
    x = (x ^ (x >> U(29))) * _M2
    return x ^ (x >> U(32))


class Reader:
    """Texts to 64-bit token hashes, all texts of a chunk at once.

    A token's hash is a polynomial over random values of its characters, taken as the difference
    of two prefix sums.
    """

    def __init__(self):
        points = np.arange(0x110000, dtype=U)
        self.value = _mix(points + U(1))
        self.kind = np.zeros(0x110000, np.uint8)
        for a, b in ((0x30, 0x39), (0x61, 0x7A)):
            self.kind[a : b + 1] = 1
        for a, b in SINGLE:
            self.kind[a : b + 1] = 2
        self.power, self.inverse = np.ones(1, U), np.ones(1, U)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            self.power = np.cumprod(np.r_[U(1), np.full(n, _BASE, U)])
            self.inverse = np.cumprod(np.r_[U(1), np.full(n, _INVERSE, U)])

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token hashes of all texts one after another, and the bounds of each text."""
        low = [t.lower() for t in texts]
        at = np.cumsum([0, *(len(t) + 1 for t in low)])
        chars = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        self._powers(len(chars))
        kind = self.kind[chars]
        word = kind == 1
        single = kind == 2
        first = word.copy()
        first[1:] &= ~word[:-1]
        last = word.copy()
        last[:-1] &= ~word[1:]
        begin, end = np.flatnonzero(first | single), np.flatnonzero(last | single)
        with np.errstate(over="ignore"):
            total = np.cumsum(self.value[chars] * self.power[: len(chars)])
            before = np.where(begin > 0, total[begin - 1], U(0)) if len(begin) else np.empty(0, U)
            tokens = _mix((total[end] - before) * self.inverse[begin])
        return tokens, np.searchsorted(begin, at)


def runs(tokens: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of up to 1,024 texts: 54-bit hashes sorted by text, their text, and counts."""
    n = np.diff(off)
    doc = np.repeat(np.arange(len(n)), n)
    k = min(size, len(tokens))
    with np.errstate(over="ignore"):
        h = np.zeros(max(len(tokens) - size + 1, 0), U)
        for i in range(size):
            h = h * _M1 + tokens[i : i + len(h)] if len(h) else h
        whole = doc[: len(h)] == doc[size - 1 :][: len(h)] if len(h) else np.empty(0, bool)
        parts = [(U(0x3FF) & doc[: len(h)][whole].astype(U)) << U(54) | _mix(h[whole]) >> U(10)]
        for d in np.flatnonzero((n > 0) & (n < size)) if k else ():
            x = U(n[d])
            for t in tokens[off[d] : off[d + 1]]:
                x = x * _M1 + t
            parts.append((U(d) << U(54) | _mix(np.array([x], U)) >> U(10)))
    key = np.sort(np.concatenate(parts))
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    doc = (key >> U(54)).astype(np.int64)
    return key & U((1 << 54) - 1), doc, np.bincount(doc, minlength=len(n))


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    a = chars = 0
    for b, t in enumerate(texts):
        if b > a and (b - a >= CHUNK_TEXTS or chars + len(t) > CHUNK_CHARS):
            yield a, b
            a, chars = b, 0
        chars += len(t)
    if a < len(texts):
        yield a, len(texts)


def _subsets(h: np.ndarray, salt: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all ``width`` bits of each partition, and their partition's number."""
    out, num = [], []
    with np.errstate(over="ignore"):
        for g in np.unique(size):
            which = np.flatnonzero(size == g)
            block = h[start[which][:, None] + np.arange(g)[None, :]]
            idx = np.array(list(combinations(range(int(g)), width)))
            sig = block[:, idx[:, 0]] + salt[which][:, None]
            for k in range(1, width):
                sig = sig * _M2 + block[:, idx[:, k]]
            out.append(_mix(sig).ravel())
            num.append(np.repeat(which, len(idx)))
    if not out:
        return np.empty(0, U), np.empty(0, np.int64)
    return np.concatenate(out), np.concatenate(num)


def allocate(cost: np.ndarray, units: np.ndarray, need: float, parts: int = 6, scale: int = 2) -> list[tuple[int, int]]:
    """Order of steps (band, width) from costs and units of the average text.

    ``cost[c, w - 1]`` and ``units[c, w - 1]`` belong to probing the partitions of band ``c`` by
    ``w`` of their bits, thus to the threshold ``g - w`` of a partition of ``g`` bits. Dynamic
    programming over the bands, each in ``parts`` portions, finds the thresholds that reach
    ``need`` at the least estimated number of candidates. Other steps follow by cost per unit, and
    end with single bits, so every text gets there.
    """
    goal = max(1, int(np.ceil(need * scale)))
    best = np.full(goal + 1, np.inf)
    best[0] = 0.0
    trail: list[tuple[int, np.ndarray, np.ndarray]] = []
    for c in range(len(cost)):
        if not units[c].any():
            continue
        for _ in range(parts):
            new, mode, back = best.copy(), np.zeros(goal + 1, np.int64), np.arange(goal + 1)
            for w in range(1, cost.shape[1] + 1):
                gain = int(round(units[c, w - 1] * scale / parts))
                if gain <= 0:
                    continue
                for x in np.flatnonzero(np.isfinite(best)):
                    to, v = min(goal, x + gain), best[x] + cost[c, w - 1] / parts
                    if v < new[to]:
                        new[to], mode[to], back[to] = v, w, x
            trail.append((c, mode, back))
            best = new
    y = int(np.max(np.flatnonzero(np.isfinite(best))))
    chosen: dict[int, dict[int, int]] = {}
    for c, mode, back in reversed(trail):
        if mode[y]:
            by = chosen.setdefault(c, {})
            by[int(mode[y])] = by.get(int(mode[y]), 0) + 1
        y = int(back[y])
    picked = {(c, max(by, key=lambda w: (by[w], w))) for c, by in chosen.items()}

    steps: list[tuple[int, int]] = []
    had = np.zeros(len(cost))

    def rate(step: tuple[int, int]) -> tuple[float, tuple[int, int]]:
        c, w = step
        return (cost[c, w - 1] + 1) / max(units[c, w - 1] - had[c], 1e-6), step

    for c, w in sorted(picked, key=rate):
        steps.append((c, w))
    for c, w in picked:
        had[c] = units[c, w - 1]
    narrower = {(c, v) for c, w in picked for v in range(w, cost.shape[1] + 1)}
    rest = {(c, w) for c in range(len(cost)) for w in range(1, cost.shape[1] + 1)} - narrower
    while rest:
        c, w = min(rest, key=rate)
        steps.append((c, w))
        had[c] = units[c, w - 1]
        rest -= {(c, v) for v in range(w, cost.shape[1] + 1)}
    return steps


def _expected(width: int, mean: float) -> tuple[float, float]:
    """Units and signatures a bit, of partitions with ``mean`` bits on average (Poisson)."""
    p, units, rows = math.exp(-mean), 0.0, 0.0
    for g in range(1, 60):
        p *= mean / g
        if g >= width:
            units, rows = units + p * (g - width + 1), rows + p * math.comb(g, width)
    return units / mean, rows / mean


class Plan:
    """Bands of the runs, cells a band and size, and the order of the steps."""

    def __init__(self, classes: np.ndarray, stats: np.ndarray, total: int, need: float):
        """``stats``: for each class the sums of counts and of squared counts."""
        share = stats[:, 0] / max(stats[:, 0].sum(), 1)
        band, self.count, have = np.zeros(CLASSES, np.uint8), 0, 0.0
        for c in range(CLASSES):
            band[c] = self.count
            have += share[c]
            if have >= BAND_SHARE and share[c + 1 :].sum() >= BAND_SHARE:
                self.count, have = self.count + 1, 0.0
        self.count += 1
        self.bands = band[classes]
        each = stats[:, 0].sum() / total
        sums = np.array([[stats[band == b, k].sum() for k in (0, 1)] for b in range(self.count)])
        part = sums[:, 0] / max(sums[:, 0].sum(), 1)
        #: cells for each run of a text; texts are 1.44 times their power of two on average
        self.per_run = 1.44 * np.maximum(part, BAND_SHARE) / CELL
        mean = sums[:, 1] / np.maximum(sums[:, 0], 1)
        cost, units = np.zeros((self.count, WIDEST)), np.zeros((self.count, WIDEST))
        for w in range(1, WIDEST + 1):
            u, r = (1.0, 1.0) if w == 1 else _expected(w, CELL)
            units[:, w - 1] = u * part * each
            rows = r * part * each * total
            cost[:, w - 1] = rows * (np.maximum(mean - 1, 0) * (mean / total) ** (w - 1) / 2 + ROW_COST)
        self.steps = allocate(cost, units, need)
        self.free = next((i for i, (_, w) in enumerate(self.steps) if w > 1), len(self.steps))


def emit(h: np.ndarray, doc: np.ndarray, n: np.ndarray, plan: Plan, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of each text: signature, text, units before, and whether only for larger partners.

    A partition of ``g`` bits probed by ``w`` of them brings ``g - w + 1`` units, less what it
    brought in an earlier step. Within a step, partitions go by cell. Steps of single bits that come
    first need no cells.
    """
    some = np.maximum(n, 1)
    least = -(-some * num // den)
    need = some - -(-(some + least) * num // (num + den)) + SHARED
    had = np.zeros(len(n), np.int64)
    band = plan.bands[(h & U(RUN_CELLS - 1)).astype(np.int64)]
    sigs, docs, before, only = [], [], [], []
    first = {c for c, _ in plan.steps[: plan.free]}
    with np.errstate(over="ignore"):
        for c, _ in plan.steps[: plan.free]:
            m = np.flatnonzero(band == c)
            d = doc[m]
            count = np.bincount(d, minlength=len(n))
            u = had[d] + np.arange(len(m)) - (np.cumsum(count) - count)[d]
            k = u < need[d]
            sigs.append(_mix(h[m[k]] + U(c + 1) * _M2))
            docs.append(d[k])
            before.append(u[k])
            only.append(np.zeros(len(sigs[-1]), bool))
            had += count
        rest = np.flatnonzero(~np.isin(band, list(first)))
        level = np.frexp(some)[1] - 1
        for up in range(math.ceil(math.log2(den / num)) + 1):
            at = level + up
            if up:
                partner = 2.0**at
                here = np.where(partner <= some * den / num, some - np.ceil((some + partner) * num / (num + den) - 1e-9).astype(np.int64) + SHARED, 0)
            else:
                here = need
            m = rest[(had < here)[doc[rest]]]
            if not len(m):
                continue
            cells = np.clip(np.rint(plan.per_run[band[m]] * 2.0 ** at[doc[m]]), 1, 1 << 20).astype(U)
            cell = (h[m] >> U(22)) * cells >> U(32)
            key = np.sort(doc[m].astype(U) << U(54) | band[m].astype(U) << U(50) | cell << U(30) | h[m] & U((1 << 30) - 1))
            bits, part = key & U((1 << 30) - 1), key >> U(30)
            start = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            size = np.diff(np.r_[start, len(part)])
            part = part[start]
            gdoc, gband = (part >> U(24)).astype(np.int64), (part >> U(20) & U(15)).astype(np.int64)
            salt = _mix((part & U((1 << 24) - 1)) << U(8) | at[gdoc].astype(U))
            got = np.zeros(len(start), np.int64)
            groups, gains, widths = [], [], []
            for c, w in plan.steps[plan.free :]:
                g = np.flatnonzero((gband == c) & (size >= w))
                groups.append(g)
                gains.append(size[g] - w + 1 - got[g])
                widths.append(np.full(len(g), w))
                got[g] = size[g] - w + 1
            g, gain, width = np.concatenate(groups), np.concatenate(gains), np.concatenate(widths)
            o = np.argsort(gdoc[g], kind="stable")
            g, gain, width = g[o], gain[o], width[o]
            d = gdoc[g]
            u = np.cumsum(gain) - gain
            lead = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            u = had[d] + u - np.repeat(u[lead], np.diff(np.r_[lead, len(u)]))
            take = u < here[d]
            g, width, u = g[take], width[take], u[take]
            for w in np.unique(width):
                k = width == w
                sig, which = _subsets(bits, salt[g[k]] + U(w), start[g[k]], size[g[k]], int(w))
                sigs.append(sig)
                docs.append(gdoc[g[k]][which])
                before.append(u[k][which])
                only.append(np.full(len(sig), up > 0))
    if not sigs:
        return np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    return np.concatenate(sigs), np.concatenate(docs), np.concatenate(before), np.concatenate(only)


def reach(n: np.ndarray, u: np.ndarray, num: int, den: int) -> np.ndarray:
    """Runs of the largest partner for which a signature after ``u`` units counts."""
    return np.minimum((n - u + SHARED - 1) * (num + den) // num - n, n * den // num)


def pack(ids: np.ndarray, n: np.ndarray, sig: np.ndarray, doc: np.ndarray, u: np.ndarray, only: np.ndarray, buckets: int, num: int, den: int) -> Iterator[tuple[int, bytes]]:
    """Blocks of signatures by bucket. The reach is kept in 127 steps, rounded up."""
    low, high = n * num // den, np.maximum(n * den // num, n * num // den + 1)
    most = reach(n[doc], u, num, den)
    step = np.clip(-(-(most - low[doc]) * 127 // (high - low)[doc]), 0, 127)
    k = most >= low[doc]
    sig, doc = sig[k], doc[k]
    q = (step[k] << 1 | only[k]).astype(U)
    bucket = (sig >> U(32)) * U(buckets) >> U(32)
    x = np.sort(bucket << U(48) | doc.astype(U) << U(38) | q << U(30) | sig & U((1 << 30) - 1))
    edge = np.searchsorted(x, np.arange(buckets + 1, dtype=U) << U(48)) if buckets < 1 << 16 else np.r_[np.searchsorted(x, np.arange(buckets, dtype=U) << U(48)), len(x)]
    for b in np.flatnonzero(np.diff(edge)):
        y = x[edge[b] : edge[b + 1]]
        d = (y >> U(38) & U(1023)).astype(np.int64)
        lead = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        count = np.diff(np.r_[lead, len(d)]).astype(np.uint32)
        own = d[lead]
        yield int(b), b"".join((
            np.array([len(own), len(y)], np.uint32).tobytes(), ids[own].tobytes(), n[own].astype(np.uint32).tobytes(), count.tobytes(),
            (y >> U(30) & U(255)).astype(np.uint8).tobytes(), (y & U((1 << 30) - 1)).astype(np.uint32).tobytes(),
        ))


def unpack(blocks: list[bytes], kind: type, num: int, den: int) -> tuple[np.ndarray, ...]:
    """Signatures, ids, sizes, reaches and marks of the blocks of a bucket."""
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    width = np.dtype(kind).itemsize
    for x in blocks:
        m, k = (int(v) for v in np.frombuffer(x, np.uint32, 2))
        at = 8
        ids = np.frombuffer(x, kind, m, at)
        n = np.frombuffer(x, np.uint32, m, at := at + m * width).astype(np.int64)
        count = np.frombuffer(x, np.uint32, m, at := at + 4 * m)
        q = np.frombuffer(x, np.uint8, k, at := at + 4 * m)
        sig = np.frombuffer(x, np.uint32, k, at + k)
        nn = np.repeat(n, count)
        low, high = nn * num // den, np.maximum(nn * den // num, nn * num // den + 1)
        for o, v in zip(out, (sig, np.repeat(ids, count), nn, low + -(-(q >> 1).astype(np.int64) * (high - low) // 127), (q & 1).astype(bool))):
            o.append(v)
    return tuple(np.concatenate(o) for o in out)


def meet(sig: np.ndarray, ids: np.ndarray, n: np.ndarray, most: np.ndarray, only: np.ndarray, num: int, den: int, block: int = 4_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a bucket that meet in a signature: smaller text, larger text, weight of what they share."""
    _, local = np.unique(ids, return_inverse=True)
    o = np.argsort(sig.astype(U) << U(34) | np.minimum(n, (1 << 34) - 1).astype(U))
    sig, n, most, only, local = sig[o], n[o], most[o], only[o], local[o].astype(U)
    group = np.cumsum(np.r_[False, sig[1:] != sig[:-1]]).astype(np.int64)
    place = group << 33 | n
    small = np.flatnonzero(most >= n)
    large = np.flatnonzero(~only)
    at, top = place[small], np.minimum(n, most)[large]
    lo = np.searchsorted(at, group[large] << 33 | -(-n[large] * num // den))
    hi = np.searchsorted(at, group[large] << 33 | top, side="right")
    count = np.maximum(hi - lo, 0)
    k = count > 0
    large, lo, count = large[k], lo[k], count[k]
    done = np.cumsum(count)
    keys, i = [], 0
    while i < len(count):
        j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + block)))
        c = count[i:j]
        b = np.repeat(large[i:j], c)
        a = small[np.repeat(lo[i:j] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))]
        k = (n[b] <= most[a]) & (local[a] != local[b])
        k &= (n[a] < n[b]) | (local[a] < local[b])
        keys.append(local[a[k]] << U(32) | local[b[k]])
        i = j
        if len(keys) > 24:
            keys = [*_counted(keys)]
    if not keys:
        return np.empty(0, ids.dtype), np.empty(0, ids.dtype), np.empty(0, np.uint8)
    key, times = _counts(keys)
    names, first = np.unique(local, return_index=True)
    every, size = np.unique(ids), np.zeros(len(names), np.int64)
    size[names.astype(np.int64)] = n[first]
    a, b = (key >> U(32)).astype(np.int64), (key & U(0xFFFFFFFF)).astype(np.int64)
    # a pair that must share fewer runs than SHARED needs no more signatures than those
    must = np.minimum(SHARED, -(-(size[a] + size[b]) * num // (num + den)))
    return every[a], every[b], np.minimum(times * -(-SHARED // np.maximum(must, 1)), SHARED).astype(np.uint8)


def _counts(keys: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each occurs; an item is an array of keys or (keys, times)."""
    flat = np.concatenate([x[0] if isinstance(x, tuple) else x for x in keys])
    if any(isinstance(x, tuple) for x in keys):
        times = np.concatenate([x[1] if isinstance(x, tuple) else np.ones(len(x), np.int64) for x in keys])
        o = np.argsort(flat)
        flat, times = flat[o], times[o]
    else:
        flat.sort()
        times = None
    lead = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.empty(0, np.int64)
    if times is None:
        return flat[lead], np.diff(np.r_[lead, len(flat)])
    return flat[lead], np.add.reduceat(times, lead) if len(lead) else times


def _counted(keys: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    yield _counts(keys)


def links(
    texts: DataFrame, key: str, text: str, size: int = 3, threshold: tuple[int, int] = (1, 2), min_chars: int = 200
) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes (class_a, class_b, similarity) and membership (key, class_id).

    A class holds the texts with the same tokens. ``threshold`` is a fraction (numerator,
    denominator). Similarities are exact.
    """
    num, den = threshold
    base = texts.where(F.length(text) >= min_chars).select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where(F.col("key").isNotNull())
    spark = base.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        reader, counts = Reader(), np.zeros(RUN_CELLS, np.uint32)
        names = ["key", "class_id", "n", "text", "sketch"]
        for rb in batches:
            keys, texts = rb.column(0), rb.column(1).to_pylist()
            classes, sizes = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int32)
            cells = []
            for a, b in _chunks(texts):
                tokens, off = reader.tokens(texts[a:b])
                h, _, n = runs(tokens, off, size)
                sizes[a:b] = n
                cells.append((h & U(RUN_CELLS - 1)).astype(np.int64))
                raw = tokens.tobytes()
                classes[a:b] = [xxhash.xxh64_intdigest(raw[8 * p : 8 * q]) - 2**63 for p, q in zip(off, off[1:])]
            if cells:
                counts += np.bincount(np.concatenate(cells), minlength=RUN_CELLS).astype(np.uint32)
            full = pa.array(sizes > 0)
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(classes), pa.array(sizes), rb.column(1), pa.nulls(len(texts), pa.binary())], names=names
            ).filter(full)
        packed = zstandard.ZstdCompressor(1).compress(counts.tobytes())
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.string()), pa.array([packed], pa.binary())], names=names)

    table = cut(base.mapInArrow(read, "key string, class_id long, n int, text string, sketch binary").withColumn("row", F.monotonically_increasing_id()))
    rows = table.where("key is not null").select("key", "class_id", "row", "n")
    # repeated rows of a key are equal; of different texts under one key, one counts
    members = cut(rows.groupBy("key").agg(F.min("class_id").alias("class_id")))
    # rows of a class other than its first are dropped by their number, so that texts aren't moved
    again = cut(rows.join(rows.groupBy("class_id").agg(F.min("row").alias("first"), F.count("*").alias("c")).where("c > 1"), "class_id").where("row <> first").select("row"))
    few = again.count() <= BROADCAST_ROWS
    once = lambda df: df.join(F.broadcast(again) if few else again, "row", "left_anti")
    slack = F.col("n") - F.ceil((F.col("n") + F.ceil(F.col("n") * num / den)) * num / (num + den)) + SHARED
    total, mean_need, all_runs = once(rows).agg(F.count("*"), F.avg((F.col("n") * (den - num)) / (num + den) + SHARED), F.sum(F.least(slack, F.col("n")))).first()
    if total < 2:
        return spark.createDataFrame([], "class_a long, class_b long, similarity double"), members

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Class of each cell by the power of two of the share of texts that have its runs, and sums."""
        import zstandard

        counts = np.zeros(RUN_CELLS, np.int64)
        for rb in batches:
            for x in rb.column(0):
                counts += np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_py()), np.uint32)
        cls = np.clip(CLASSES + np.floor(np.log2(np.maximum(counts / total, 1e-12))), 0, CLASSES - 1).astype(np.uint8)
        stats = np.stack([np.bincount(cls, weights=w, minlength=CLASSES) for w in (counts, counts.astype(float) ** 2)], 1)
        yield pa.RecordBatch.from_arrays([pa.array([cls.tobytes()], pa.binary()), pa.array([stats.tobytes()], pa.binary())], names=["classes", "stats"])

    summed = table.where("sketch is not null").select("sketch").repartition(1).mapInArrow(add, "classes binary, stats binary").collect()[0]
    plan = Plan(np.frombuffer(summed["classes"], np.uint8), np.frombuffer(summed["stats"]).reshape(CLASSES, 2), total, mean_need)
    # numbers of texts without gaps take less room than row numbers
    spans = {r[0]: r[1] for r in rows.groupBy(F.shiftright("row", 33).alias("p")).agg((F.max(F.col("row").bitwiseAND((1 << 33) - 1)) + 1).alias("c")).collect()}
    parts = np.array(sorted(spans), np.int64)
    bounds = np.cumsum([0, *(spans[p] for p in parts)])
    kind = np.uint32 if bounds[-1] < 1 << 32 else np.uint64
    buckets = int(min(max(2 * spark.sparkContext.defaultParallelism, -(-int(1.6 * all_runs) // BUCKET_ROWS)), 1 << 16))
    box = spark.sparkContext.broadcast((plan, parts, bounds))

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, (plan, parts, bounds) = Reader(), box.value
        for rb in batches:
            row, texts = rb.column(0).to_numpy(), rb.column(1).to_pylist()
            ids = (bounds[np.searchsorted(parts, row >> 33)] + (row & ((1 << 33) - 1))).astype(kind)
            for a, b in _chunks(texts):
                h, doc, n = runs(*reader.tokens(texts[a:b]), size)
                sig, doc, u, only = emit(h, doc, n, plan, num, den)
                out = list(pack(ids[a:b], n, sig, doc, u, only, buckets, num, den))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["bucket", "block"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [x for rb in batches for x in rb.column(1).to_pylist()]
        if not blocks:
            return
        a, b, weight = meet(*unpack(blocks, kind, num, den), num, den)
        if not len(a):
            return
        place = (_mix(a.astype(U)) >> U(32)) * U(buckets) >> U(32)
        o = np.lexsort((b, a, place))
        a, b, weight, place = a[o], b[o], weight[o], place[o]
        edge = np.searchsorted(place, np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(edge)):
            s = slice(edge[k], edge[k + 1])
            x = a[s]
            lead = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
            block = b"".join((np.array([len(lead), len(x)], np.uint32).tobytes(), x[lead].tobytes(), np.diff(np.r_[lead, len(x)]).astype(np.uint32).tobytes(), b[s].tobytes(), weight[s].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([block], pa.binary())], names=["bucket", "block"])

    def total_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, parts, bounds = box.value
        w = np.dtype(kind).itemsize
        xs, ys, ws = [], [], []
        for rb in batches:
            for x in rb.column(1).to_pylist():
                m, k = (int(v) for v in np.frombuffer(x, np.uint32, 2))
                xs.append(np.repeat(np.frombuffer(x, kind, m, 8), np.frombuffer(x, np.uint32, m, 8 + m * w)))
                ys.append(np.frombuffer(x, kind, k, 8 + m * (w + 4)))
                ws.append(np.frombuffer(x, np.uint8, k, 8 + m * (w + 4) + k * w))
        if not xs:
            return
        a, b, weight = np.concatenate(xs), np.concatenate(ys), np.concatenate(ws).astype(np.int64)
        names = np.unique(np.concatenate([np.unique(a), np.unique(b)]))
        key, share = _counts([(np.searchsorted(names, a).astype(U) << U(32) | np.searchsorted(names, b).astype(U), weight)])
        key = key[share >= SHARED]
        back = lambda i: (parts[(p := np.searchsorted(bounds, i, side="right") - 1)] << 33) + (i - bounds[p])
        ids = [back(names[(k).astype(np.int64)].astype(np.int64)) for k in (key >> U(32), key & U(0xFFFFFFFF))]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in ids], names=["id_a", "id_b"])

    # one bucket a partition: rows go straight to the partition of their bucket's number
    kept = once(table.where("key is not null").select("row", "text"))
    sigs = kept.select("row", "text").mapInArrow(signatures, "bucket int, block binary").repartitionById(buckets, "bucket")
    shares = sigs.mapInArrow(join, "bucket int, block binary").repartitionById(buckets, "bucket")
    candidates = cut(shares.mapInArrow(total_up, "id_a long, id_b long"))
    return _verify(candidates, table.where("key is not null").select("row", "class_id", "text"), size, num, den), members


def _verify(candidates: DataFrame, table: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Candidates whose exact similarity reaches the threshold."""
    wanted = cut(candidates.select(F.explode(F.array("id_a", "id_b")).alias("row")).distinct())
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = table.join(wanted, "row", "left_semi").select("row", "class_id", "text")

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(6)
        for rb in batches:
            packed = pa.array([z.compress(t.encode("utf-8", "surrogatepass")) for t in rb.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), packed], names=["row", "class_id", "packed"])

    texts = cut(texts.mapInArrow(shrink, "row long, class_id long, packed binary"))
    x = texts.select(F.col("row").alias("id_a"), F.col("class_id").alias("class_a"), F.col("packed").alias("packed_a"))
    y = texts.select(F.col("row").alias("id_b"), F.col("class_id").alias("class_b"), F.col("packed").alias("packed_b"))
    both = candidates.join(x, "id_a").join(y, "id_b").select("class_a", "class_b", "packed_a", "packed_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z, reader = zstandard.ZstdDecompressor(), Reader()
        known: dict[int, np.ndarray] = {}
        for rb in batches:
            ia, ib = rb.column(0).to_pylist(), rb.column(1).to_pylist()
            for i in range(0, len(ia), 512):
                new: dict[int, bytes] = {}
                for ids, column in ((ia, 2), (ib, 3)):
                    for k in range(i, min(i + 512, len(ids))):
                        if ids[k] not in known and ids[k] not in new:
                            new[ids[k]] = rb.column(column)[k].as_py()
                if len(known) > 4000:
                    wanted = {*ia[i : i + 512], *ib[i : i + 512]}
                    known = {k: v for k, v in known.items() if k in wanted}
                names = list(new)
                plain = [z.decompress(v).decode("utf-8", "surrogatepass") for v in new.values()]
                for a, b in _chunks(plain):
                    h, _, n = runs(*reader.tokens(plain[a:b]), size)
                    known.update(zip(names[a:b], np.split(h, np.cumsum(n)[:-1])))
                keep = []
                for p, q in zip(ia[i : i + 512], ib[i : i + 512]):
                    g, h = known[p], known[q]
                    both = np.concatenate([g, h])
                    both.sort()
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                    if common * den >= (len(both) - common) * num:
                        keep.append((p, q, common / (len(both) - common)))
                cols = list(zip(*keep)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["class_a", "class_b", "similarity"]
                )

    return both.mapInArrow(check, "class_a long, class_b long, similarity double")


def found_pairs(texts: DataFrame, key: str, text: str, **params) -> DataFrame:
    """All pairs (a, b) of keys with a < b whose texts are similar enough, copies included."""
    pairs, members = links(texts, key, text, **params)
    both = pairs.select("class_a", "class_b").unionByName(pairs.select(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b")))
    same = members.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("class_id").alias("class_a"), F.col("class_id").alias("class_b"))
    m = members.select(F.col("class_id").alias("class_a"), F.col("key").alias("a"))
    n = members.select(F.col("class_id").alias("class_b"), F.col("key").alias("b"))
    return both.unionByName(same).join(m, "class_a").join(n, "class_b").where("a < b").select("a", "b").distinct()


def classes(texts: DataFrame, key: str, text: str, **params) -> DataFrame:
    """One row per text: its class, the size of the class and its links to other classes."""
    pairs, members = links(texts, key, text, **params)
    ends = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class_id"), "similarity")
    counts = ends.groupBy("class_id").agg(F.count("*").alias("n_links"), F.max("similarity").alias("best_similarity"))
    sizes = members.groupBy("class_id").agg(F.count("*").alias("class_size"))
    return members.join(sizes, "class_id").join(counts, "class_id", "left").select(
        "key", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("best_similarity", F.lit(0.0)).alias("best_similarity")
    )
