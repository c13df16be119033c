"""Column functions over text: tokens, keys, names, excerpts, hashes (STR-*)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}"
#: Full-width forms of ASCII and their plain ones, from the offset between the two blocks.
WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "　"
NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + " "


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: str | Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(_c(c), F.lit(""))


def stripped(c: str | Column) -> Column:
    """Without blanks of any script at both ends."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def fold_width(c: str | Column) -> Column:
    """Full-width forms as plain characters."""
    return F.translate(_c(c), WIDE, NARROW)


def search_tokens(c: str | Column) -> Column:
    """STR-01: lower-cased words, then pairs of neighbouring Han characters; repeats are kept."""
    t = text(c)
    words = F.transform(F.regexp_extract_all(t, F.lit("[A-Za-z0-9_]+"), F.lit(0)), F.lower)
    runs = F.regexp_extract_all(t, F.lit(f"[{HAN}]+"), F.lit(0))
    pairs = F.transform(
        runs,
        lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))
        ),
    )
    return F.concat(words, F.flatten(pairs))


def plain_markdown(c: str | Column) -> Column:
    """STR-03: without code and addresses; links keep their label, images their description."""
    t = F.regexp_replace(text(c), r"(?s)```.*?```", " ")
    t = F.regexp_replace(t, r"`[^`]*`", " ")
    t = F.regexp_replace(t, r"!\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return F.regexp_replace(t, r"https?://\S+", " ")


def similarity_tokens(c: str | Column, max_chars: int | None = 8000) -> Column:
    """STR-02: cut to ``max_chars`` first (None: whole texts), then words and single ideographs, kana and hangul."""
    t = F.lower(plain_markdown(text(c) if max_chars is None else F.substring(text(c), 1, max_chars)))
    return F.regexp_extract_all(t, F.lit(rf"[0-9a-z]+|[{HAN}\x{{3040}}-\x{{30ff}}\x{{ac00}}-\x{{d7af}}]"), F.lit(0))


def shingles(tokens: Column, width: int = 3) -> Column:
    """STR-04: distinct runs of ``width`` tokens; a shorter text has all its tokens as one run."""
    n = F.size(tokens)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - (width - 1), F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, width), " "))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def tag_key(c: str | Column) -> Column:
    """STR-05: one key for spellings that differ in width, case, # and separators; null if empty."""
    t = F.regexp_replace(stripped(fold_width(text(c))), r"^#+", "")
    t = F.lower(F.trim(F.regexp_replace(t, r"(?U)[\s_\-./|]+", " ")))
    return F.when((t != "") & (F.length(t) <= 80), t)


def alias_form(c: str | Column) -> Column:
    """STR-09: the spelling kept as an alias."""
    return stripped(F.regexp_replace(stripped(fold_width(text(c))), r"^#+", ""))


def slug(c: str | Column) -> Column:
    """STR-10: identifier of a collection name."""
    t = F.regexp_replace(stripped(fold_width(text(c))), r"(?U)\s+", "-")
    t = F.regexp_replace(t, rf"[^0-9A-Za-z_\-{HAN}]+", "-")
    return F.substring(F.lower(F.regexp_replace(F.regexp_replace(t, "-+", "-"), "^-|-$", "")), 1, 80)


def file_id(c: str | Column) -> Column:
    """STR-11: safe file name of an identifier."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(text(c), r"[^A-Za-z0-9._-]", "-"), "-+", "-"), "^-|-$", "")
    return F.when(t == "", F.lit("doc")).otherwise(t)


def vault_name(c: str | Column) -> Column:
    """STR-12: safe file name of a title."""
    t = F.regexp_replace(F.regexp_replace(text(c), rf"[^0-9A-Za-z_.\-{HAN}]+", "_"), "^_+|_+$", "")
    return F.when(t == "", F.lit("untitled")).otherwise(t)


def snippet(body: str | Column, tokens: list[str], half: int = 72) -> Column:
    """STR-13: window around the earliest hit, ends marked; the beginning where there is no hit."""
    t = text(body)
    low = F.lower(t)
    spots = F.filter(F.array(*(F.instr(low, x.lower()) for x in tokens)), lambda p: p > 0)
    at = F.array_min(spots)
    start = F.greatest(at - half, F.lit(1))
    end = F.least(at + half - 1, F.length(t))
    cut = stripped(F.regexp_replace(F.substring(t, start, end - start + 1), "\n", " "))
    window = F.concat(F.when(start > 1, "…").otherwise(""), cut, F.when(end < F.length(t), "…").otherwise(""))
    return F.when(at.isNull(), stripped(F.regexp_replace(F.substring(t, 1, 2 * half), "\n", " "))).otherwise(window)


def content_hash(c: str | Column) -> Column:
    """STR-14: first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text(c), 256), 1, 16)


def headline(c: str | Column) -> Column:
    """STR-21: first line with text outside fences, without heading marks, at most 200 characters."""
    t = F.regexp_replace(text(c), r"(?s)```.*?(```|$)", "\n")
    lines = F.filter(F.transform(F.split(t, "\n"), stripped), lambda x: x != "")
    first = F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))
    return F.substring(stripped(F.regexp_replace(F.regexp_replace(first, r"^#{1,6}\s+", ""), r"\s+#+$", "")), 1, 200)


def first_paragraph(c: str | Column, limit: int = 120) -> Column:
    """STR-22: first line with text after heading marks and images are dropped."""
    lines = F.transform(F.split(text(c), "\n"), lambda x: stripped(F.regexp_replace(F.regexp_replace(x, r"!\[[^\]]*\]\([^)]*\)", ""), r"^#+\s*", "")))
    first = F.coalesce(F.try_element_at(F.filter(lines, lambda x: x != ""), F.lit(1)), F.lit(""))
    return F.when(F.length(first) > limit, F.concat(F.substring(first, 1, limit), F.lit("…"))).otherwise(first)


def excerpt(c: str | Column, limit: int = 240) -> Column:
    """STR-24: at most ``limit`` characters, the last being an ellipsis if cut."""
    t = stripped(text(c))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit - 1), F.lit("…")))


def preview(c: str | Column, limit: int = 80) -> Column:
    """STR-35: one line, blanks made even, cut with an ellipsis."""
    return excerpt(F.regexp_replace(text(c), r"(?U)\s+", " "), limit)


def semantic_form(c: str | Column) -> Column:
    """STR-27: width, blanks and case made even."""
    return F.lower(stripped(F.regexp_replace(fold_width(text(c)), r"(?U)\s+", " ")))


def bare_form(c: str | Column) -> Column:
    """STR-34: without any blanks, lower-cased."""
    return F.lower(F.regexp_replace(text(c), r"(?U)\s+", ""))


def title_key(c: str | Column) -> Column:
    """STR-36: key of a title."""
    t = F.regexp_replace(F.lower(text(c)), "&", " and ")
    return F.trim(F.regexp_replace(t, rf"[^0-9a-z{HAN}]+", " "))


def doi_key(c: str | Column) -> Column:
    """STR-37: DOI without prefixes, brackets and trailing punctuation."""
    t = F.lower(F.trim(text(c)))
    t = F.regexp_replace(t, r"^(https?://[^/]*/|doi[:\s]\s*)+", "")
    return F.regexp_replace(F.regexp_replace(t, r"^[\[(<{]+", ""), r"[\])>}.,;:\s]+$", "")


def pair_key(a: str | Column, b: str | Column) -> Column:
    """STR-58: the same key for both orders of a pair."""
    return F.concat(F.least(_c(a), _c(b)), F.lit("|"), F.greatest(_c(a), _c(b)))


def label_fold(c: str | Column) -> Column:
    """STR-59: full-width forms as plain ones, blanks dropped."""
    return F.regexp_replace(fold_width(text(c)), r"(?U)\s+", "")


def prompt_tokens(c: str | Column) -> Column:
    """STR-62: estimated tokens of a prompt."""
    return F.ceil(F.length(text(c)) / F.lit(1.5))


def visible_chars(c: str | Column) -> Column:
    """STR-69: characters other than blanks."""
    return F.length(F.regexp_replace(text(c), r"(?U)\s+", ""))


def escape_markdown(c: str | Column) -> Column:
    """STR-56: special characters behind a backslash."""
    # The characters that have a meaning in Markdown text.
    return F.regexp_replace(text(c), r"([\\`*_{}\[\]<>#])", r"\\$1")


def reference_targets(c: str | Column) -> Column:
    """STR-57: targets of images and links, in order."""
    return F.regexp_extract_all(text(c), F.lit(r"\]\(([^)\s]+)\)"), F.lit(1))
