"""Repair of text from scanned pages by a noisy channel.

Running headers and page numbers are told by their place and form, divided words by joining them,
misread characters by a channel model: the probability that a character was misread times the
n-gram likelihood of the corpus, decoded by Viterbi over the candidate words of a line. How probable
each confusion is, is estimated from the corpus by expectation-maximisation over the spellings that
are no words. The language model (word and bigram counts, Han character bigrams, intact compounds) is counted over all
texts; only entries above a share of all tokens are kept, so its size has a bound.

Defined results: null and blank texts have no defects and stay as they are; repeated rows of one key
count once; texts of any length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut

#: Log probability of a confusion on average, how far a frequent or rare one may lie from it, and rounds of its estimation.
MISREAD_LOG, MISREAD_SPREAD, ROUNDS = -5.0, 1.5, 2
#: A model entry must make up one of so many tokens, which bounds the model's size.
WORD_SHARE, PAIR_SHARE = 150_000, 400_000

# What a scanner reads (left) for what is printed (right).
MISREAD: tuple[tuple[str, str], ...] = (
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("|", "l"), ("|", "i"), ("@", "a"), ("ı", "r"), ("ı", "i"), ("(", "c"), ("é", "e"), ("è", "e"), ("l", "i"), ("i", "l"), ("c", "e"), ("e", "c"),
    ("f", "t"), ("t", "f"), ("b", "h"), ("h", "b"), ("rn", "m"), ("m", "rn"), ("nn", "m"), ("ii", "u"), ("li", "h"), ("vv", "w"), ("cl", "d"), ("d", "cl"), ("n", "u"), ("u", "n"), ("8", "b"), ("6", "b"),
    ("9", "g"), ("q", "g"), ("g", "q"), ("!", "l"), ("$", "s"), ("j", "i"), ("o", "c"), ("c", "o"), ("a", "o"), ("o", "a"), ("y", "v"), ("v", "y"), ("ri", "n"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("tl", "d"), ("lc", "k"),
)
HAN_MISREAD = dict(zip("耍末闽木素巳槁曰倍光钱袁敉柡问力阪觧旳", "要未阈本索己稿日信先线表数标间为版解的"))

_HYPHENS = "\u2010\u2011\u00ad\u00ac-"
_NUM = r"[0-9lIOoSı|]{1,4}"
_ROMAN = r"(?=[ivxl])(?:xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
#: A running header on a line of its own, perhaps with the page number beside it.
_SIDE_L, _SIDE_R = rf"(?:(?P<nl>{_NUM})[ ]{{2,}})?", rf"(?:[ ]{{2,}}(?P<nr>{_NUM}))?"
_HEAD_LINE = re.compile(
    rf"^[ \t]*{_SIDE_L}(?P<h>\S+ et al\.[ ]{{2,}}\S.*?|[A-Z]\S{{5,7}} {_NUM}[ ]{{2,}}\S.*?|[^|#\n][^|\n]*? · [VY]\S{{1,3}} {_NUM}|[A-Z]{{3}}\S{{1,2}} [0-9lOo|S]{{4}} — \S+|[^|#\n>][^\n]*? \| [^\n]{{3,60}}?|(?![^\n]*[a-z]{{2}})(?!\d{{1,2}} [A-Z])(?=[^\n]*[A-Z]{{3}})[^\n#>*`$_{{}}|=\\一-鿿]{{5,}}?){_SIDE_R}[ \t\r]*$",
    re.M,
)
_SIDED_LINE = re.compile(rf"^[ \t]*(?:{_NUM}[ ]{{3,}}[^\d\W].*|[^\n#|>*`$ ][^\n|]*?[ ]{{3,}}{_NUM})[ \t\r]*$", re.M)
_PAGE_LINE = re.compile(rf"^[ \t]*(?:[-—–] ?{_NUM} ?[-—–]|[pP]\. ?{_NUM}|第 ?{_NUM} ?页|P\w{{2,3}} {_NUM} of {_NUM}|\[{_NUM}\]|(?P<bare>{_NUM})|(?P<rom>{_ROMAN}))[ \t\r]*$", re.M)
_FENCED = re.compile(r"^```[\s\S]*?(?:^```[^\n]*$|\Z)|\$\$[\s\S]*?\$\$|^\|[^\n]*$|!?\[[^\]\n]*\]\([^)\n]*\)|https?://\S+", re.M)
#: The same inside a line, where line ends were turned into spaces.
_HEAD_IN = re.compile(
    rf"(?:(?<!\S){_NUM}[ ]{{3,}})?(?:\S+ et al\.[ ]{{2,}}|(?<!\S)[A-Z]\S{{5,7}} {_NUM}[ ]{{3,}}| · [VY]\S{{1,3}} {_NUM}|[A-Z]{{2}}\S{{2,3}} [0-9lOo|S]{{4}} — \S+| \| [A-Z]\S+ \S+|(?<![\w.])(?=[^\s]*[A-Z]{{3}})[A-Zl10:@]{{4,}}(?![\w])(?: (?=\S*[A-Z0-9])[A-Zl0-9:@]{{1,}}(?![a-z]))*)"
)
_PAGE_IN = re.compile(
    rf"(?<!\S)(?:[-—–] {_NUM} [-—–]|[pP]\. {_NUM}(?!\S)|第 {_NUM} 页|P\w{{2,3}} {_NUM} of {_NUM}(?!\S)|\[{_NUM}\])(?!\S)|(?<=[ ]{{3}}){_NUM}(?= )|(?<![^ …]){_NUM}(?=[ ]{{3}}\S)|(?<=[ ]){_ROMAN}(?=[ ])"
)
_BARE_IN = re.compile(r"(?<=\S )\d{1,4}(?= \S)")
_DIVIDED = re.compile(rf"(?<=[^\W\d_])[{_HYPHENS}][ \t\r]*(?:\n[ \t\r]*)+([^\W\d_]+)")
_BEFORE = re.compile(r"[^\W\d_]+\Z")
_DIVIDED_IN = re.compile(rf"([^\W\d_]+)[{_HYPHENS}](?: +([^\W\d_]+)?|…?$)")
_WORD = re.compile(r"(?:[A-Za-zéèıﬁﬂ0-9|@!$]*[A-Za-zéèıﬁﬂ]\((?=[a-z]))?[A-Za-zéèıﬁﬂ0-9|@!$]*[A-Za-zéèıﬁﬂ][A-Za-zéèıﬁﬂ0-9|@!$]*")
_PLAIN = re.compile(r"[a-z]+")
_TOKENS = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)?|[.!?:;,]")
_COMPOUND = re.compile(rf"(?<![\w{_HYPHENS}])([a-z]+)-([a-z]+)(?![\w-])")
_HAN_ODD = re.compile("[" + "".join(HAN_MISREAD) + "]")
_HAN = re.compile("[一-鿿]{2,}")
_MIXED = re.compile(r"[0-9|@!$(éèıﬁﬂ]")
_SETTING = re.compile(r"[A-Za-z]\d{1,2}")
_NUMBER_LIKE = re.compile(r"(?=.*\d)(?=.*[lIOoSB])[\dlIOoSB]+")


class Model:
    """Counts of words, pairs, Han pairs and compounds."""

    def __init__(self, words: dict[str, int], pairs: dict[str, int], han: dict[str, int], compounds: set[str], total: int, channel: dict[tuple[str, str], float] | None = None):
        self.channel = channel or {}
        self.pairs, self.han, self.compounds, self.total = pairs, han, compounds, max(total, 1)
        self.heads = {c.split("-")[0] for c in compounds}
        self.words = words
        self.seen: dict[str, list[tuple[str, float]]] = {}
        # spellings that are a frequent misreading of a far more frequent word aren't words
        self.words = {w: n for w, n in words.items() if not any(words[c] > 40 * n for c, _ in self.candidates(w))}
        self.seen.clear()

    def candidates(self, w: str) -> list[tuple[str, float]]:
        """Known words that may have been misread as ``w``, with the log probability of that."""
        got = self.seen.get(w)
        if got is not None:
            return got
        if len(self.seen) > 300_000:
            self.seen.clear()
        out: dict[str, float] = {}
        level = {w: 0.0}
        for depth in (1, 2):
            new: dict[str, float] = {}
            for x, p in level.items():
                for read, real in MISREAD:
                    i = x.find(read)
                    if i < 0:
                        continue
                    q = p + self.channel.get((read, real), MISREAD_LOG)
                    while i >= 0:
                        y = x[:i] + real + x[i + len(read):]
                        if y != w and q > new.get(y, -99.0):
                            new[y] = q
                        i = x.find(read, i + 1)
            for y, q in new.items():
                if y in self.words and y not in out:
                    out[y] = q
            if out or len(new) > 400:
                break
            level = new
        got = self.seen[w] = sorted(out.items())
        return got

    def confusions(self, w: str) -> dict[tuple[str, str], float]:
        """Expected number of each confusion in an unknown spelling: posteriors of the words it may stand for."""
        found: dict[tuple[str, str], float] = {}
        for read, real in MISREAD:
            i = w.find(read)
            while i >= 0:
                n = self.words.get(w[:i] + real + w[i + len(read) :])
                if n:
                    found[read, real] = found.get((read, real), 0.0) + n * math.exp(self.channel.get((read, real), MISREAD_LOG))
                i = w.find(read, i + 1)
        all_ = sum(found.values()) + self.total * math.exp(-19.0)
        return {k: v / all_ for k, v in found.items()}

    def log(self, w: str, before: str) -> float:
        """Log likelihood of a word after another, interpolated."""
        uni = self.words.get(w, 0) / self.total
        pair = self.pairs.get(before + " " + w, 0) / max(self.words.get(before, 0), 1)
        return math.log(0.7 * min(pair, 1.0) + 0.3 * uni + 1e-12)

    def decode(self, line: list[str]) -> list[str]:
        """Most likely words of a line."""
        states: list[tuple[float, list[str]]] = [(0.0, [])]
        for w in line:
            low = w.lower()
            # an unknown word stands for itself with the probability of a new name or word
            keep = self.log(low, "") if low in self.words else (-14.0 if w[:1].isupper() and not _MIXED.search(w) else -19.0)
            options = [(low, None)] + ([] if low in self.words else self.candidates(low))
            new = []
            for c, channel in options:
                best = max(
                    ((s + (max(keep, self.log(c, t[-1] if t else "")) if channel is None else channel + self.log(c, t[-1] if t else "")), t) for s, t in states),
                    key=lambda x: x[0],
                )
                new.append((best[0], [*best[1], c]))
            states = sorted(new, key=lambda x: -x[0])[:8]
        return states[0][1]


def _blank(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with spans replaced by nothing, and their line ends by one."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a < at:
            continue
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]])


def _mask(text: str) -> str:
    return _FENCED.sub(lambda m: re.sub(r"[^\n]", "\x00", m[0]), text)


_MARK_LEFT = re.compile(r" · [VY]\S{1,3} | \| ")
_MARK_RIGHT = re.compile(rf"\S+ et al\.[ ]{{2,}}\Z|\b\S{{6,8}} {_NUM}[ ]{{3,}}\Z")
_SPAN = re.compile(r"\S+")


def _extent(text: str, a: int, b: int, model: Model) -> tuple[int, int]:
    """The whole of a running header of which a .. b is the sure part.

    The title stands before or behind that part; it ends where the words around the header make the
    likeliest pair, as the sentence goes on there.
    """
    sure = text[a:b]
    flat = lambda w: re.sub(r"[^a-z0-9]", "", w.lower())
    count = lambda x, y: model.pairs.get(("#" if x[:1].isdigit() else flat(x)) + " " + ("#" if y[:1].isdigit() else flat(y)), 0)
    if _MARK_RIGHT.search(sure):
        before = text[:a].split()[-1:] or [""]
        words = list(_SPAN.finditer(text, b))[:8]
        mark = _PAGE_IN.search(text, b)
        if mark and words and mark.start() <= words[-1].start():
            return a, mark.start()  # a page number ends the header
        ends = [(count(before[0], words[k][0]), -k) for k in range(1, len(words))]
        if ends and max(ends)[0] > 0:
            k = -max(ends)[1]
        else:
            k = min(2, len(words))
        return a, words[k - 1].end() if words else b
    if _MARK_LEFT.search(sure):
        if m := re.match(r" Group\b| Gr\S{3}\b", text[b:]):
            b += m.end()
        after = text[b:].split()[:1] or [""]
        words = [m for m in _SPAN.finditer(text, max(0, a - 70), a)][-8:]
        han = [m for m in words if re.search("[一-鿿]", m[0])]
        starts = [(count(words[k - 1][0], after[0]), k) for k in range(1, len(words)) if words[k][0][:1].isupper() or words[k] in han]
        if starts:
            a = words[max(starts)[1]].start()
        elif words and words[0].start() == 0:
            a = 0
    return a, b


def structure(text: str, inline: bool, model: Model | None) -> tuple[list[tuple[int, int]], bool, bool]:
    """Spans of headers and page numbers, and which of both occur."""
    spans: list[tuple[int, int]] = []
    header = page = False
    if inline:
        sure: list[tuple[int, int]] = []
        for m in _HEAD_IN.finditer(text):
            header = True
            if any(a <= m.start() < b for a, b in spans):
                continue
            sure.append(m.span())
            spans.append(m.span() if model is None else _extent(text, *m.span(), model))
            if re.match(rf"{_NUM}[ ]{{3}}", m[0]):
                page = True
        for m in _PAGE_IN.finditer(text):
            if m[0] and not any(a <= m.start() < b for a, b in sure):
                page = True
                spans.append(m.span())
        if model is not None:
            for m in _BARE_IN.finditer(text):
                if any(a <= m.start() < b for a, b in spans):
                    continue
                left, right = text[: m.start() - 1], text[m.end() + 1 :]
                if "一" <= left[-1:] <= "鿿" or left[-1:] in "，。、；：" and "一" <= right[:1] <= "鿿":
                    page = True
                    spans.append(m.span())
                    continue
                before, after = re.search(r"[a-z]+$|[.,!?:;]$", left.lower()), re.match(r"[a-z]+", right.lower())
                if not before or not after or left[: before.start()].strip(" ") in ("", "…") and (left[:1] == "…" or before[0].isalpha()):
                    continue
                p, q = model.pairs.get(before[0] + " #", 0), model.pairs.get("# " + after[0], 0)
                base = 20 * model.total / PAIR_SHARE
                if (p < base and q < base) or p + q < base:
                    page = True
                    spans.append(m.span())
        return spans, header, page
    for m in _HEAD_LINE.finditer(text):
        if "\x00" in m[0]:
            continue
        header = True
        spans.append((m.start(), min(len(text), m.end() + 1)))
        if m["nl"] or m["nr"]:
            page = True
    for m in _SIDED_LINE.finditer(text):
        if "\x00" not in m[0] and not any(a <= m.start() < b for a, b in spans):
            header = page = True
            spans.append((m.start(), min(len(text), m.end() + 1)))
    for m in _PAGE_LINE.finditer(text):
        if not m[0].strip():
            continue
        if m["bare"]:
            prev = text[: m.start()].rstrip().rsplit("\n", 1)[-1].strip()
            rest = text[m.end() :].lstrip("\r\n \t").split("\n", 1)[0].strip()
            listed = prev.endswith((":", "：")) or (re.fullmatch(r"[0-9lIOo|]{1,4}", prev) and not prev.isalpha()) or (re.fullmatch(r"[0-9lIOo|]{1,4}", rest) and not rest.isalpha())
            if listed or not re.search(r"\d", m["bare"]):
                continue
        page = True
        spans.append((m.start(), min(len(text), m.end() + 1)))
    return spans, header, page


def _join(text: str, model: Model, inline: bool) -> tuple[str, bool]:
    """The text with divided words joined, and whether there were any."""
    had = False

    def joined(a: str, b: str, inner: bool, as_is: str) -> str:
        """The word of two parts, a compound, or what was written."""
        nonlocal had
        if (a + b).lower() not in model.words and a.lower() in model.heads and (not b or f"{a}-{b}".lower() in model.compounds):
            return f"{a}-{b}" if b else as_is
        if inner and not b:
            return as_is
        had = True
        return a + b

    if inline:
        out = _DIVIDED_IN.sub(lambda m: joined(m[1], m[2] or "", not m[0].endswith("…") and m.end() < len(text), m[0]), text)
        return out, had
    parts, at = [], 0
    for m in _DIVIDED.finditer(text):
        a = _BEFORE.search(text, max(at, m.start() - 60), m.start())
        if a:
            parts += [text[at : a.start()], joined(a[0], m[1], False, m[0])]
            at = m.end()
    return "".join([*parts, text[at:]]), had


def _glyphs(body: str, model: Model, inline: bool) -> list[tuple[int, int, str]]:
    """(start, end, correction) of misread words and characters of a body text."""
    out = []
    odd = {w for w in set(_WORD.findall(body)) if w.lower() not in model.words}
    suspects = set()
    for w in odd:
        low = w.lower()
        if _SETTING.fullmatch(w) or not 1 < len(w) < 30:
            continue
        if _NUMBER_LIKE.fullmatch(w) or (_MIXED.search(w) and len(w) > 2 and re.search(r"[a-z]", w)) or model.candidates(low):
            suspects.add(w)
    if suspects:
        for m in _WORD.finditer(body):
            w = m[0]
            if w not in suspects:
                continue
            a, b = m.span()
            if inline and (a == 0 or body[a - 1] == "…" or b >= len(body) or body[b] == "…" or body[:a].strip("… ") == ""):
                if not _MIXED.search(w):
                    continue
            if body[a - 1 : a] in ("_", "{", "^", "\\", "'", "=") or body[b : b + 1] in ("_", "{", "^", "(", "="):
                continue
            core = w.strip("|!$@")
            if not core or (core != w and core.lower() in model.words and not re.search(r"[|@$!]", core) and w[-1] in "!$"):
                continue
            if _NUMBER_LIKE.fullmatch(w):
                out.append((a, b, w.translate(str.maketrans("lIOoSB", "110058"))))
                continue
            left = re.findall(r"[A-Za-z]+", body[max(0, a - 40) : a])[-2:]
            right = re.findall(r"[A-Za-z]+", body[b : b + 40])[:1]
            line = model.decode([*left, w, *right])
            best = line[len(left)]
            if best != w.lower():
                out.append((a, b, best.capitalize() if w[0].isupper() else best))
            elif _MIXED.search(w) and re.search(r"[a-zA-Z][0-9|@!$éèıﬁﬂ]+[a-z]|[|@éèıﬁﬂ]", w) and w[0] not in "0123456789":
                fixed = w
                for read, real in MISREAD:
                    if read in "0 1 5 | @ ı é è 8 6 9 ! $ ﬁ ﬂ".split():
                        fixed = fixed.replace(read, real)
                out.append((a, b, fixed))
    for m in _HAN_ODD.finditer(body):
        i = m.start()
        real = HAN_MISREAD[m[0]]
        p, n = body[i - 1 : i], body[i + 1 : i + 2]
        get = model.han.get
        as_is = get(p + m[0], 0) + get(m[0] + n, 0)
        if get(p + real, 0) + get(real + n, 0) > 8 * as_is:
            out.append((i, i + 1, real))
    return out


def analyse(text: str, inline: bool, model: Model) -> tuple[set[str], str]:
    """Kinds of scanning traces in a text, and the text without them."""
    defects: set[str] = set()
    masked = text if inline else _mask(text)
    spans, header, page = structure(masked, inline, model)
    if header:
        defects.add("header")
    if page:
        defects.add("pageno")
    body = masked
    if spans:
        body = _blank(masked, spans)
    joined, divided = _join(body, model, inline)
    if divided:
        defects.add("hyphen")
    fixes = _glyphs(joined, model, inline)
    if fixes:
        defects.add("glyph")
    return defects, joined if not fixes else _replace(joined, fixes)


def _replace(text: str, fixes: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, new in sorted(fixes):
        if a >= at:
            out += [text[at:a], new]
            at = b
    return "".join([*out, text[at:]])


def repaired(text: str, inline: bool, model: Model) -> str:
    """Continuous paragraphs without traces; fenced blocks, tables and lists keep their lines."""
    if inline:
        return re.sub(r" {2,}", " ", analyse(text, True, model)[1])
    kept: list[str] = []

    def put(m: re.Match) -> str:
        kept.append(m[0])
        return f"\x01{len(kept) - 1}\x01"

    body = analyse(_FENCED.sub(put, text), False, model)[1]
    out = []
    for part in re.split(r"\n[ \t\r]*\n+", body):
        lines = [x.strip(" \r\t") for x in part.split("\n")]
        glued = lines[0]
        for x in lines[1:]:
            if re.match(r"[#>|*+\-]|\d+[.)] |\x01", x) or glued.startswith(("#", "|", "\x01")) or glued.endswith((":", "：")):
                glued += "\n" + x
            else:
                glued += ("" if re.search("[⺀-￯]$", glued) and re.match("[⺀-￯]", x) else " ") + x
        out.append(glued)
    # a paragraph that a page break cut goes on in the next one
    text2 = re.sub(r"(?<=[a-z,])\n\n(?=[a-z])", " ", "\n\n".join(out))
    return re.sub(r"\x01(\d+)\x01", lambda m: kept[int(m[1])], text2)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts, one row per entry and batch."""
    for pdf in batches:
        n: Counter[str] = Counter()
        pairs: Counter[tuple[str, str]] = Counter()
        han: Counter[str] = Counter()
        for t in pdf["text"]:
            low = t.lower()
            words = ["#" if w[0].isdigit() else w for w in _TOKENS.findall(low)]
            n.update(words)
            pairs.update(zip(words, words[1:]))
            n.update(f"\x02{a}-{b}" for a, b in set(_COMPOUND.findall(low)))
            for run in _HAN.findall(t):
                han.update(map("".join, zip(run, run[1:])))
        keys = [*n, *(f"{a} {b}" for a, b in pairs), *("\x03" + h for h in han)]
        vals = [*n.values(), *pairs.values(), *han.values()]
        yield pd.DataFrame({"entry": keys, "n": vals})


def fit(texts: DataFrame) -> Model:
    """Language model of all texts (column ``text``)."""
    counts = texts.where(F.length("text") > 0).select("text").mapInPandas(_count, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))
    counts = cut(counts.where("n > 2"))
    plain = ~F.col("entry").rlike("[ \x02\x03]")
    total = counts.where(plain).agg(F.sum("n")).first()[0] or 0
    words: dict[str, int] = {}
    pairs: dict[str, int] = {}
    han: dict[str, int] = {}
    compounds: set[str] = set()
    keep = (plain & (F.col("n") * WORD_SHARE >= total)) | (F.col("entry").contains(" ") & (F.col("n") * PAIR_SHARE >= total)) | (F.col("entry").rlike("^[\x02\x03]") & (F.col("n") * PAIR_SHARE >= total))
    for e, n in counts.where(keep).toLocalIterator():
        if e[0] == "\x02":
            compounds.add(e[1:])
        elif e[0] == "\x03":
            han[e[1:]] = n
        elif " " in e:
            pairs[e] = n
        else:
            words[e] = n
    model = Model({w: n for w, n in words.items() if n > 4}, pairs, han, compounds, total)
    known = model.words  # without frequent misreadings
    channel: dict[tuple[str, str], float] = {}
    spellings = counts.where(plain & F.col("entry").rlike("^[a-z]{3,29}$"))
    for _ in range(ROUNDS):
        box = texts.sparkSession.sparkContext.broadcast((known, total, channel))

        def expect(batches: Iterator[pd.DataFrame], box=box) -> Iterator[pd.DataFrame]:
            words_, total_, channel_ = box.value
            m = Model.__new__(Model)
            m.words, m.total, m.channel = words_, max(total_, 1), channel_
            for pdf in batches:
                sums: Counter[tuple[str, str]] = Counter()
                for w, n in zip(pdf["entry"], pdf["n"]):
                    if w not in words_:
                        for k, v in m.confusions(w).items():
                            sums[k] += n * v
                yield pd.DataFrame([(*k, v) for k, v in sums.items()], columns=["seen", "meant", "n"])

        # one row a confusion
        got = {(r[0], r[1]): r[2] for r in spellings.mapInPandas(expect, "seen string, meant string, n double").groupBy("seen", "meant").agg(F.sum("n")).collect()}
        # the counts hold spellings of letters; confusions with digits and signs keep the average
        plain_ = [k for k in MISREAD if _PLAIN.fullmatch(k[0])]
        all_ = sum(got.values()) + len(plain_)
        share = {k: (got.get(k, 0.0) + 1) / all_ * len(plain_) for k in plain_}
        channel = {k: MISREAD_LOG + max(-MISREAD_SPREAD, min(MISREAD_SPREAD, math.log(v))) for k, v in share.items()}
    model.channel = channel
    model.seen.clear()
    return model


def library_texts(jobs: DataFrame, sources: DataFrame, papers: DataFrame) -> DataFrame:
    """(item_kind, item_id, text) of all texts that may come from scans, once per key."""
    j = jobs.select(F.lit("job").alias("item_kind"), F.col("job_id").alias("item_id"), F.col("markdown").alias("text"))
    s = sources.select(F.lit("snippet").alias("item_kind"), F.col("source_id").cast("string").alias("item_id"), F.col("snippet").alias("text"))
    p = papers.select(F.lit("paper").alias("item_kind"), F.col("document_id").alias("item_id"), F.col("full_text").alias("text"))
    return j.unionByName(s).unionByName(p).where(F.length(F.trim("text")) > 0).where(F.col("item_id").isNotNull()).dropDuplicates(["item_kind", "item_id"])


def repair(texts: DataFrame, model: Model | None = None, with_text: bool = True) -> DataFrame:
    """(item_kind, item_id, defects[, repaired]) of texts (item_kind, item_id, text).

    Texts of the kind ``snippet`` are windows on one line.
    """
    box = texts.sparkSession.sparkContext.broadcast(model or fit(texts))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = box.value
        for pdf in batches:
            rows = []
            for kind, item, text in pdf[["item_kind", "item_id", "text"]].itertuples(index=False):
                d, _ = analyse(text, kind == "snippet", m)
                rows.append((kind, item, sorted(d), *([repaired(text, kind == "snippet", m)] if with_text else [])))
            yield pd.DataFrame(rows, columns=["item_kind", "item_id", "defects", *(["repaired"] if with_text else [])])

    return texts.select("item_kind", "item_id", "text").mapInPandas(work, "item_kind string, item_id string, defects array<string>" + ", repaired string" * with_text)


def found(jobs: DataFrame, sources: DataFrame, papers: DataFrame) -> DataFrame:
    """One row per text and kind of trace."""
    # each text is moved once; the fit and the repair both read the table
    texts = cut(library_texts(jobs, sources, papers))
    return repair(texts, with_text=False).select("item_kind", "item_id", F.explode("defects").alias("defect")).distinct()
