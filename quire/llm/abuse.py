"""Scores for abusive, hateful, threatening and sexually explicit language.

A lexicon of words is held as a trie of letters. Unusual tokens run a Levenshtein automaton against
the trie (its states are rows of the edit matrix, cut off beyond the allowed distance), most of them
only against the words that are equal to them once both have lost as many characters as edits are
allowed. In the automaton, digits and signs that look like a letter, masks and stretched letters cost nothing, so
disguises and misspellings are caught by one search; zero-width and separating characters are
undone before. Each sentence gets a score from its terms, weighted by a window of words around
them: address and insult frames raise it, reports, quotation and technical senses lower it. A
document's score is that of its strongest sentence.

What the lexicon lacks is learned: runs of up to four words (or five Han characters) that occur in
labelled documents far more often with abuse than chance allows become terms, with a weight from
their rate. Runs around a lexicon term are tested apart from the others. The fit reads at most ``LABELLED`` judged documents, chosen by hash; every document is
scored.

A token is ordinary, and so no misspelling, if it is a word of its own in the vocabulary of a public
tokenizer (a parameter) or on a short fixed list. Every other token is matched, however frequent.
Defined results: null and empty texts score 0; repeated rows of one key count once; judgements that
are null or divided are left out; without judgements only the lexicon counts; an empty table gives
an empty result.
"""

from __future__ import annotations

import base64
import math
import os
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut

THRESHOLD = 0.5
#: Most judged documents that the fit reads.
LABELLED = 20_000
#: Chance that any learned term at all is due to luck, and the least rate of a term.
LUCK, LEAST_RATE, LEAST_TIMES = 0.05, 0.6, 3

# Ordinary words that are within one edit of a lexicon word by chance.
ORDINARY: frozenset[str] = frozenset(
    "whole whose price batch botch birch butch lower loses lover loner laser looser regard idiom thrash rotted rotter blood broody crown fifth filch sever sower skewer stint sting stick stunk stank slink "
    "sticking stinging sinking slinking stinting bread bleed brewed cases cakes caves cares canes capes cafes caged depot depart chose chore beater short shout shook shoots scoot strange straggle threat "
    "nicks finger boxes bonus bores bodes bonds boned parties pantries pasties patties nodes nukes nudges horns election ejection books booms boots blobs moated thigh named nuked breast locked liked linked "
    "lacked savage salvages bustard brains brawn braid drawn driver drives drivel manner manors horses house housed hoses clothe clothed laugh waits warts wands witch served serves server swerve".split()
)

# Words with their category and weight.
WORDS: dict[str, tuple[str, float]] = {
    **dict.fromkeys("fuck fucks fucked fucking fucker motherfucker asshole arsehole dumbass scumbag halfwit imbecile cretin moron shithead cunt wanker slut whore".split(), ("insult", 0.6)),
    **dict.fromkeys("shitty shit arse ass bullshit prick twat bitch douchebag dipshit retard nitwit dimwit".split(), ("insult", 0.45)),
    **dict.fromkeys("idiot bastard loser brainless stupid dumb moronic idiotic trash pathetic worthless".split(), ("insult", 0.3)),
    **dict.fromkeys("disgust disgusting stinking rotten bloody useless clown liar parasite filth scum vermin sewer slug ashamed thieves stink lie coward pig".split(), ("insult", 0.15)),
    **dict.fromkeys("inferior breed cockroaches savages rats cages deport halfbreeds".split(), ("hate", 0.15)),
    "subhuman": ("hate", 0.6), "subhumans": ("hate", 0.6), "goddamn": ("insult", 0.2),
    **dict.fromkeys("kill choke beaten hang shoot strangle stab burn throat necks fingers bones".split(), ("threat", 0.12)),
    **dict.fromkeys("nipples panties nudes horny porn blowjob handjob masturbate orgasm erection boobs tits cum".split(), ("sexual", 0.55)),
    **dict.fromkeys("moaned thighs naked nude breasts licked cock sex explicit".split(), ("sexual", 0.2)),
    "yourself": ("threat", 0.0),
}

# Set phrases over normalised words.
PHRASES: tuple[tuple[str, str, float], ...] = (
    ("insult", "piece of shit", 0.8), ("insult", "piece of trash", 0.6), ("insult", "shut up", 0.5), ("insult", "get lost", 0.35), ("insult", "kiss my ass", 0.7), ("insult", "kiss my arse", 0.7),
    ("insult", "you disgust me", 0.7), ("insult", "go to hell", 0.6), ("insult", "ashamed of yourself", 0.4), ("insult", "waste of space", 0.6),
    ("hate", "inferior race", 0.8), ("hate", "not real people", 0.8), ("hate", "half-breeds", 0.65), ("hate", "half breeds", 0.65), ("hate", "breed like rats", 0.8),
    ("threat", "kill yourself", 0.9), ("threat", "kill you", 0.8), ("threat", "hope you die", 0.8), ("threat", "hope you choke", 0.8), ("threat", "should be shot", 0.7), ("threat", "i know where you live", 0.8), ("threat", "break your neck", 0.8),
    ("sexual", "oral sex", 0.65), ("sexual", "send nudes", 0.8), ("sexual", "send me nudes", 0.8), ("sexual", "naked breasts", 0.6), ("sexual", "make you come", 0.6),
)

# Chinese terms.
CHINESE: tuple[tuple[str, str, float], ...] = (
    ("insult", "人渣", 0.6), ("insult", "蠢货", 0.6), ("insult", "白痴", 0.6), ("insult", "混蛋", 0.6), ("insult", "废物", 0.5), ("insult", "贱人", 0.7), ("insult", "他妈的", 0.6), ("insult", "你妈的", 0.7),
    ("insult", "猪脑子", 0.6), ("insult", "垃圾", 0.2), ("insult", "滚出去", 0.5), ("insult", "闭嘴", 0.4), ("insult", "傻逼", 0.8), ("insult", "王八蛋", 0.7), ("insult", "畜生", 0.5), ("insult", "白癡", 0.6), ("insult", "不配", 0.2),
    ("hate", "都是害虫", 0.7), ("hate", "赶走", 0.4), ("hate", "下贱", 0.6), ("hate", "别让他们", 0.3), ("hate", "劣等", 0.5),
    ("threat", "打断你的", 0.8), ("threat", "弄死你", 0.8), ("threat", "去死", 0.6), ("threat", "杀了你", 0.8), ("threat", "打死你", 0.8), ("threat", "砍死", 0.6),
    ("sexual", "做爱", 0.6), ("sexual", "脱光", 0.5), ("sexual", "裸照", 0.6), ("sexual", "口交", 0.6), ("sexual", "操你", 0.8), ("sexual", "色情视频", 0.4),
)

# Frames that turn a term into abuse, and frames that report it or use another sense.
ADDRESS = frozenset("you your you're yourself u ur whoever yours".split())
FRAMES = re.compile(r"\bonly an? \W*|\bwhat an? |\bis an? |\bare an? |\bpeople like\b|\bthey are all\b|\bthose \w+ are\b|\bhonestly\b|\bgod,|\bgo \w+ yourself\b|\bdeserves? to be\b|\b(?:ought|had better|need) to\b|\bthat \w+ \w+ (?:belongs?|should)\b|\bwe don't\b")
REPORT = re.compile(r"\b(?:policy|moderat\w+|dataset\w*|datasets|survey|interview|dictionary|glossary|the (?:word|term|phrase|insult|slur)|meant|apologi[sz]\w+|withdrew|remov(?:ed|es)|reported|reports|complain\w+|quot(?:ed|ation)|entry|etymology|lexicon|flagged|without repeating)\b|规定|举报|词条|一词")
QUOTED = re.compile(r"[\"“「『][^\"”」』]{0,160}[\"”」』]|['‘][^'’]{12,160}['’]")

_ZERO = re.compile("[­​-‏⁠﻿]")
_SPACED = re.compile(r"(?<![^\W_])[A-Za-z0-9@$!*](?:(?P<s>[ ._·*\-])[A-Za-z0-9@$!*])(?:(?P=s)[A-Za-z0-9@$!*])+(?![^\W_])")
_TOKEN = re.compile(r"[a-z]+(?:['’][a-z]+)?")
_MIXED = re.compile(r"(?<![^\W_])(?=[a-z]*[0-9@$!|*+])(?=[a-z0-9@$!|*+]*[a-z@$])[a-z0-9@$!|*+]{3,}(?![^\W_])")
#: A letter beside a sign, and the end of spaced letters: every match of the two holds one, which is found faster.
_MIXED_PART = re.compile(r"[0-9@$!|*+](?:(?=[a-z@$])|(?<=[a-z@$].))")
_SPACED_END = re.compile(r"([ ._·*\-])[A-Za-z0-9@$!*]\1[A-Za-z0-9@$!*](?![^\W_])")
_STRETCHED = re.compile(r"([^*])\1{2,}")
# The letters that a digit or sign may stand for.
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t"}
#: One letter for all that may stand for each other.
_ALIKE = str.maketrans({c: x[0] for x in LOOKS.values() for c in x} | {c: x[0] for c, x in LOOKS.items()})
#: Line ends inside a paragraph.
_HAN_WRAPPED = re.compile(r"(?<=[\u2e80-\uffef])\n(?=[\u2e80-\uffef])")
_WRAPPED = re.compile(r"(?<!\n)\n(?![\n#>|*+\-]|\d+[.)] )")
_SENTENCE = re.compile(r"[^.!?。！？\n]+[.!?。！？]*|\n")
_SENTENCE_WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
_HAN_RUN = re.compile("[一-鿿]{2,}")
_HAN_ONLY = re.compile("[一-鿿]+")
_HAN_PLAIN = re.compile("|".join(t for _, t, _ in CHINESE))
_HAN_HINT = re.compile("|".join(r"[\W_]{0,2}".join(map(re.escape, t)) for _, t, _ in CHINESE))
_HAN = [(c, re.compile(r"[\W_]{0,2}".join(map(re.escape, t))), w) for c, t, w in CHINESE]


# Letters and apostrophes stay, other bytes become blanks.
_LETTERS = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz'" else 32 for b in range(256))


def _tokens(low: str) -> set[str]:
    """The different tokens of a lower-cased text."""
    if "’" in low:
        return set(_TOKEN.findall(low))
    words = set(low.encode("ascii", "replace").translate(_LETTERS).decode("ascii").split())
    odd = [w for w in words if "'" in w]
    return words.difference(odd).union(*map(_TOKEN.findall, odd)) if odd else words


def _mixed(low: str) -> list[str]:
    """Tokens of letters with signs, of a lower-cased text."""
    out, end = [], 0
    for m in _MIXED_PART.finditer(low):
        if m.start() >= end:  # what stands between two blanks is searched once
            end = low.find(" ", m.start())
            end = len(low) if end < 0 else end
            out += _MIXED.findall(low, low.rfind(" ", 0, m.start()) + 1, end)
    return out


def _shortened(token: str, k: int) -> set[str]:
    """A token less up to ``k`` of its characters."""
    out = {token}
    for _ in range(k):
        out |= {x[:i] + x[i + 1 :] for x in out for i in range(len(x))}
    return out


class Trie:
    """Lexicon by letters; ``within`` intersects it with the Levenshtein automaton of a token."""

    def __init__(self, words):
        self.root: dict = {}
        self.words = list(words)
        self.longest = max(map(len, self.words), default=0)
        self.by_rest: dict[int, dict[str, list[str]]] = {}
        for w in self.words:
            node = self.root
            for ch in w:
                node = node.setdefault(ch, {})
            node[""] = w

    def within(self, token: str, k: int) -> list[tuple[int, str]]:
        """Words within ``k`` edits, an exchange of neighbours being one.

        A sign for a letter it looks like, ``*`` for any letter, and letters of a run of three or
        more beyond its first cost nothing.
        """
        n, out, root = len(token), [], self.root
        if "*" not in token and not _STRETCHED.search(token):
            if not (words := self._candidates(token, k)):
                return out
            root = Trie(words).root
        same = [1] * (n + 1)  # what it costs to drop a character of the token
        for m in _STRETCHED.finditer(token):
            same[m.start() + 2 : m.end() + 1] = [0] * (m.end() - m.start() - 1)
        looks = [LOOKS.get(c, c) for c in token]
        first = [0] * (n + 1)
        for j in range(1, n + 1):
            first[j] = first[j - 1] + same[j]
        todo = [(root, "", first, None)]
        while todo:
            node, last, row, before = todo.pop()
            if "" in node and row[n] <= k:
                out.append((row[n], node[""]))
            for ch, kid in node.items():
                if not ch:
                    continue
                new = [row[0] + 1]
                low = new[0]
                for j in range(1, n + 1):
                    c = looks[j - 1]
                    v = row[j - 1] if c == "*" or ch in c else row[j - 1] + 1
                    if (x := new[j - 1] + same[j]) < v:
                        v = x
                    if (x := row[j] + 1) < v:
                        v = x
                    if before is not None and j > 1 and token[j - 1] == last and token[j - 2] == ch and before[j - 2] + 1 < v:
                        v = before[j - 2] + 1
                    new.append(v)
                    if v < low:
                        low = v
                if low <= k:
                    todo.append((kid, ch, new, row))
        return out

    def _candidates(self, token: str, k: int) -> set[str]:
        """Words that can be within ``k`` edits of a token whose every character costs.

        Each edit spares one character on either side at most, so the two are equal once each has
        lost up to ``k`` characters.
        """
        rests = self.by_rest.get(k)
        if rests is None:
            rests = self.by_rest[k] = {}
            for w in self.words:
                for x in _shortened(w.translate(_ALIKE), k):
                    rests.setdefault(x, []).append(w)
        if len(token) > k + self.longest:
            return set()
        return {w for x in _shortened(token.translate(_ALIKE), k) if x in rests for w in rests[x]}


def ordinary_words(vocabulary: str | None = None) -> frozenset[str]:
    """Lower-case words that a public tokenizer's vocabulary holds whole, less the lexicon."""
    if vocabulary is None:
        from quire.llm.tokens import default_vocabulary

        vocabulary = default_vocabulary()
    if not os.path.exists(vocabulary):
        return ORDINARY
    out = set(ORDINARY)
    with open(vocabulary, "rb") as f:
        for line in f:
            word = base64.b64decode(line.split()[0])
            if word[:1] == b" " and len(word) > 3 and word[1:].isalpha() and word[1:].isascii():
                out.add(word[1:].decode().lower())
    return frozenset(out - WORDS.keys())


_TARGETS = frozenset(WORDS)
#: Words that make a sentence worth scoring.
_TRIGGERS = frozenset(w for w, (_, x) in WORDS.items() if x > 0)

#: Phrases without a trigger are worth scoring where all their words occur.
_UNTRIGGERED = [ws for ws in (frozenset(w for x in p.split() if x != "_" for w in re.split("['’-]", x)) for _, p, _ in PHRASES) if _TRIGGERS.isdisjoint(ws)]


def _phrase(p: str) -> re.Pattern:
    return re.compile(r"(?<!\w)" + r" ".join(r"(?:\S+ ){1,3}" if w == "_" else re.escape(w) for w in p.split()).replace("}) ", "})").replace("(?:\\S+ ){1,3} ", "(?:\\S+ ){1,3}") + r"(?!\w)")


_PHRASE_FORMS = [(c, _phrase(p), w) for c, p, w in PHRASES]


#: One word of each such phrase, by which it is looked for.
_PHRASE_MARKS = frozenset(max(ws, key=lambda w: (len(w), w)) for ws in _UNTRIGGERED)


def _has_phrase(words: set[str]) -> bool:
    """Whether all words of a phrase without triggers occur, as words or parts of them."""
    parts = words.union(*(re.split("['’-]", w) for w in words if not w.isalpha()))
    return not _PHRASE_MARKS.isdisjoint(parts) and any(ws <= parts for ws in _UNTRIGGERED)


class Reader:
    """Maps tokens to lexicon words; remembers what it has seen."""

    def __init__(self, ordinary: frozenset[str] = ORDINARY, terms: dict[str, tuple[float, str]] | None = None):
        """``terms``: learned runs, their weights, and the word by which each is looked for."""
        self.trie, self.long, self.ordinary = Trie(_TARGETS), Trie(w for w in _TARGETS if len(w) > 7), ordinary
        self.terms = {g: w for g, (w, _) in (terms or {}).items() if not _HAN_ONLY.fullmatch(g)}
        self.marks: dict[str, list[frozenset[str]]] = {}
        for g, (_, mark) in (terms or {}).items():
            if g in self.terms:
                self.marks.setdefault(mark, []).append(frozenset(g.split()))
        self.han = {g: w for g, (w, _) in (terms or {}).items() if g not in self.terms}
        self.han_marks = {g[:2] for g in self.han}
        self.seen: dict[str, str] = {}
        self.plain = set(_TARGETS | ordinary)

    def meant(self, token: str) -> str:
        """The lexicon word that a token stands for, or the token."""
        if token in self.plain:
            return token
        got = self.seen.get(token)
        if got is None:
            if len(self.seen) + len(self.plain) > 500_000 + len(self.ordinary):
                self.seen.clear()
                self.plain = set(_TARGETS | self.ordinary)
            got = self._meant(token)
            if got == token:
                self.plain.add(token)
            else:
                self.seen[token] = got
        return got

    def _meant(self, token: str) -> str:
        letters = len(re.sub(r"(.)\1{2,}", r"\1", token))
        plain = token.isalpha()
        hits = self.trie.within(token, 0) if not plain or letters < len(token) else []
        if not hits and letters > 3 and "*" not in token:
            hits = [x for x in self.trie.within(token, 1) if len(x[1]) > 3]
            if not hits and letters > 7:
                hits = self.long.within(token, 2)
        if not hits or plain and min(hits)[0] and any(token == w + end for _, w in hits for end in ("y", "ed", "ing", "er")):
            return token
        # a mask stands for the strongest word that fits
        return min(hits, key=lambda x: (x[0], -WORDS[x[1]][1] if "*" in token else 0.0, x[1]))[1]

    def worth(self, low: str) -> bool:
        """Whether a lower-cased text has anything to score."""
        tokens = _tokens(low)
        if not _TRIGGERS.isdisjoint(tokens) or any(ws <= tokens for mark in self.marks.keys() & tokens for ws in self.marks[mark]):
            return True
        meant = {self.meant(t) for t in (tokens - self.plain).union(_mixed(low))}
        if not _TRIGGERS.isdisjoint(meant) or _SPACED_END.search(low) and _SPACED.search(low):
            return True
        plain = low.isascii()
        if not plain and (_HAN_HINT.search(low) or _ZERO.search(low)):
            return True
        if self.han and not plain and any(g in self.han for x in _HAN_RUN.findall(low) if not self.han_marks.isdisjoint(map("".join, zip(x, x[1:]))) for g in han_runs(x)):
            return True
        return _has_phrase(tokens | meant)

    def undo(self, low: str) -> str:
        """The text with disguises undone."""
        s = _WRAPPED.sub(" ", _HAN_WRAPPED.sub("", _ZERO.sub("", low)))

        def joined(m: re.Match) -> str:
            sep = m["s"]
            word = m[0].replace(sep, "") if sep != "*" else m[0]
            w = self.meant(word)
            if w in _TARGETS:
                return w
            if sep == " ":  # several spaced words may stand together
                return self._cut(word) or m[0]
            return m[0]

        if _SPACED_END.search(s):
            s = _SPACED.sub(joined, s)
        if _MIXED_PART.search(s):
            s = _MIXED.sub(lambda m: self.meant(m[0]), s)
        if all(self.meant(t) == t for t in _tokens(s) - self.plain):
            return s
        return _TOKEN.sub(lambda m: self.meant(m[0]), s)

    @staticmethod
    def _cut(word: str) -> str:
        if word[0] in "aiu" and word[1:] in _TARGETS:
            return word[0] + " " + word[1:]
        for i in range(2, len(word) - 1):
            if word[:i] in _TARGETS and word[i:] in _TARGETS:
                return word[:i] + " " + word[i:]
        return ""

    def sentence(self, s: str) -> tuple[float, dict[str, float]]:
        """Score of a normalised sentence, and by category."""
        words = _SENTENCE_WORD.findall(s)
        learned = max((self.terms[g] for g in runs_of(words) if g in self.terms), default=0.0) if not self.marks.keys().isdisjoint(words) else 0.0
        if self.han and not s.isascii():
            learned = max(learned, max((self.han[g] for g in han_runs(s) if g in self.han), default=0.0))
        if not learned and _TRIGGERS.isdisjoint(words) and (s.isascii() or not _HAN_HINT.search(s)):
            joined = "-" in s or "'" in s or "’" in s
            if not (joined and any("-" in w and not _TRIGGERS.isdisjoint(w.split("-")) for w in words)) and not ((joined or not _PHRASE_MARKS.isdisjoint(words)) and _has_phrase(set(words))):
                return 0.0, {}
        flat = " ".join(words)
        found: list[tuple[str, float]] = [("learned", learned)] if learned else []
        strong = learned > 0.5
        for c, form, w in _PHRASE_FORMS:
            if form.search(flat):
                found.append((c, w))
                strong = True
        address = bool(ADDRESS.intersection(words))
        framed = address or bool(FRAMES.search(s))
        for i, word in enumerate(words):
            for part in (word, *word.split("-")) if "-" in word else (word,):
                if part in WORDS and WORDS[part][1]:
                    c, w = WORDS[part]
                    window = words[max(0, i - 8) : i + 9]
                    near = address and bool(ADDRESS.intersection(window))
                    backed = any(x in _TRIGGERS and x != part for x in window)
                    found.append((c, min(0.9, w * (1.8 if near else 1.5 if framed or backed else 1.0 if w >= 0.5 else 0.6))))
        for c, form, w in _HAN:
            if form.search(s):
                found.append((c, min(0.9, w * (1.3 if "你" in s else 1.0))))
        if not found:
            return 0.0, {}
        damp = 0.35 if REPORT.search(s) and not address else 0.6 if REPORT.search(s) and not strong else 1.0
        quotes = [m.span() for m in QUOTED.finditer(s)]
        if quotes and sum(b - a for a, b in quotes) > 0.5 * len(s) or (quotes and re.search(r"\b(?:says?|said|wrote|writes|reads?|reported|called|quotes?)\b", s[: quotes[0][0]])):
            damp = min(damp, 0.4)
        by: dict[str, float] = {}
        for c, w in found:
            by[c] = 1 - (1 - by.get(c, 0.0)) * (1 - w * damp)
        total = 1.0
        for v in by.values():
            total *= 1 - v
        return 1 - total, by

    def score(self, text: str | None) -> tuple[float, str | None]:
        """A document's score and the category that adds most."""
        if not text:
            return 0.0, None
        low = text.lower()
        if not self.worth(low):
            return 0.0, None
        best, kind = 0.0, None
        for m in _SENTENCE.finditer(self.undo(low)):
            v, by = self.sentence(m[0])
            if v > best:
                best, kind = v, max(sorted(by), key=by.get)
        return round(best, 6), kind


_kept: list = [None, None]


def reader_of(lexicon: tuple) -> Reader:
    """The reader of a broadcast lexicon; a worker keeps its last one, so that later tasks search no token again."""
    if _kept[0] is not lexicon:
        _kept[:] = lexicon, Reader(*lexicon)
    return _kept[1]


def runs_of(words: list[str]) -> Iterator[str]:
    """Runs of two to four words that hold no digits; runs of two need a lexicon word."""
    for k in (2, 3, 4):
        for i in range(len(words) - k + 1):
            run = words[i : i + k]
            if k == 2 and _TRIGGERS.isdisjoint(run):
                continue
            g = " ".join(run)
            if not any(c.isdigit() for c in g):
                yield g


def han_runs(s: str) -> Iterator[str]:
    """Runs of three to five Han characters; runs of three need a lexicon term."""
    for x in _HAN_RUN.findall(s):
        for k in (3, 4, 5):
            for i in range(len(x) - k + 1):
                g = x[i : i + k]
                if k > 3 or _HAN_PLAIN.search(g):
                    yield g


def _log_tail(k: int, n: int, p: float) -> float:
    """Log of the chance of at least ``k`` of ``n`` at rate ``p`` (Chernoff's bound)."""
    q = k / n
    if q <= p:
        return 0.0
    return -n * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0.0))


def fit(documents: DataFrame, labels: DataFrame, labelled: int = LABELLED, ordinary: frozenset[str] = ORDINARY) -> dict[str, tuple[float, str]]:
    """Learned terms: weight, and the rarest word of each (the first two characters of Han terms)."""
    spark = documents.sparkSession
    votes = labels.where(F.col("abusive").isNotNull() & F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "annotator"])
    judged = votes.groupBy("doc_id").agg(F.avg("abusive").alias("y")).where("y in (0.0, 1.0)").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    texts = documents.where(F.length("text") > 0).select("doc_id", "text").join(F.broadcast(judged), "doc_id").dropDuplicates(["doc_id"]).select("text", (F.col("y") > 0.5).alias("y"))
    texts = cut(texts)
    n, bad = texts.agg(F.count("*"), F.count_if("y")).first()
    if not bad or bad == n:
        return {}

    def grams(text: str, reader: Reader) -> set[str]:
        out: set[str] = set()
        for m in _SENTENCE.finditer(reader.undo(text.lower())):
            out.update(runs_of(_SENTENCE_WORD.findall(m[0])))
            out.update(han_runs(m[0]))
        return out

    def counter(only):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader, good, bad_ = Reader(ordinary), Counter(), Counter()
            wanted, single = only.value if only else (None, frozenset())
            for rb in batches:
                for t, y in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
                    g = grams(t, reader)
                    good.update("\0" + w for w in single.intersection(_TOKEN.findall(t.lower())))
                    (bad_ if y else good).update(g & wanted if wanted is not None else g)
            keys = sorted(good.keys() | bad_.keys())
            for i in range(0, len(keys), 100_000):
                part = keys[i : i + 100_000]
                columns = [pa.array(part, pa.string()), pa.array([good[k] for k in part], pa.int64()), pa.array([bad_[k] for k in part], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["gram", "good", "bad"])

        return work

    schema, sums = "gram string, good long, bad long", (F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    # only runs that enough abusive documents have are counted in the others
    often = texts.where("y").mapInArrow(counter(None), schema).groupBy("gram").agg(*sums).where(F.col("bad") >= LEAST_TIMES).select("gram").collect()
    wanted = frozenset(r[0] for r in often)
    box = spark.sparkContext.broadcast((wanted, frozenset(w for g in wanted for w in g.split())))
    counts = {r[0]: (r[1], r[2]) for r in texts.mapInArrow(counter(box), schema).groupBy("gram").agg(*sums).collect()}
    texts_with = {g[1:]: counts.pop(g)[0] for g in [g for g in counts if g[0] == "\0"]}
    # runs around a lexicon term are fewer, so that less evidence rules out luck
    near = {g for g in counts if not _TRIGGERS.isdisjoint(g.split()) or _HAN_PLAIN.search(g)}
    limits = [math.log(LUCK / max(m, 1)) for m in (len(counts) - len(near), len(near))]
    out: dict[str, tuple[float, str]] = {}
    for g in sorted(counts, key=lambda g: (len(g.split()), len(g), g)):
        good, bad_ = counts[g]
        if bad_ / (good + bad_) < LEAST_RATE or _log_tail(bad_, good + bad_, bad / n) > limits[g in near]:
            continue
        weight = min(0.9, bad_ / (good + bad_ + 1))
        parts = g.split()
        if len(parts) > 1:
            inner = [" ".join(parts[i:j]) for i in range(len(parts)) for j in range(i + 2, len(parts) + 1)]
        else:
            inner = [g[i:j] for i in range(len(g)) for j in range(i + 3, len(g) + 1)]
        if any(x != g and x in out and out[x][0] >= weight - 0.02 for x in inner):
            continue
        out[g] = weight, g[:2] if len(parts) == 1 else min(parts, key=lambda w: (texts_with.get(w, 0), w))
    return out


def score(documents: DataFrame, labels: DataFrame | None = None, vocabulary: str | None = None, labelled: int = LABELLED) -> DataFrame:
    """(doc_id, source, score, kind) of every document; ``labels`` has doc_id, annotator and abusive."""
    ordinary = ordinary_words(vocabulary)
    terms = fit(documents, labels, labelled, ordinary) if labels is not None else {}
    box = documents.sparkSession.sparkContext.broadcast((ordinary, terms))
    docs = documents.select("doc_id", "source", "text")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = reader_of(box.value)
        for pdf in batches:
            got = [reader.score(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "score": [x[0] for x in got], "kind": [x[1] for x in got]})

    return docs.mapInPandas(work, "doc_id long, source string, score double, kind string")


def rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents, cases and rate of each source; spellings of a source count as one."""
    name = F.coalesce(F.lower(F.trim("source")), F.lit("(none)"))
    return scored.dropDuplicates(["doc_id"]).groupBy(name.alias("source")).agg(
        F.count("*").alias("n_documents"),
        F.count_if(F.col("score") >= threshold).alias("n_cases"),
        (F.count_if(F.col("score") >= threshold) / F.count("*")).alias("rate"),
        F.avg("score").alias("mean_score"),
    )


def found(documents: DataFrame, labels: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that reach the threshold."""
    return score(documents, labels).where(F.col("score") >= threshold).select("doc_id").distinct()
