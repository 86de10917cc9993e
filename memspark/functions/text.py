"""Text functions as Spark columns. Nothing here runs Python per row."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space at the ends of a text, and word characters.
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_BREAK = "\\r\\n|[\\n\\r\\x0B\\f\\x1c-\\x1e\\x85\\u2028\\u2029]"
WORD = "[\\p{L}\\p{N}_]+"
CJK = "\\u3400-\\u4dbf\\u4e00-\\u9fff\\uf900-\\ufaff"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def lines(c: Column) -> Column:
    return F.split(c, LINE_BREAK)


def first_line(c: Column) -> Column:
    return F.split(c, LINE_BREAK, 2)[0]


def collapse_spaces(c: Column) -> Column:
    return strip(F.regexp_replace(c, "\\s+", " "))


def ngrams(c: Column, n: int) -> Column:
    """All overlapping character n-grams of a string, in order."""
    return F.regexp_extract_all(c, F.lit("(?s)(?=(" + "." * n + "))"), F.lit(1))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def tokens(c: Column) -> Column:
    """Search tokens: lower-case words; a run of CJK ideographs gives its characters and their pairs."""
    low = F.lower(text_or_empty(c))
    plain = F.regexp_extract_all(low, F.lit(WORD), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(f"[{CJK}]+|[\\p{{L}}\\p{{N}}_&&[^{CJK}]]+"), F.lit(0))
    split_runs = F.flatten(
        F.transform(
            runs,
            lambda r: F.when(r.rlike(f"^[{CJK}]"), F.concat(ngrams(r, 1), ngrams(r, 2))).otherwise(F.array(r)),
        )
    )
    return F.when(low.rlike(f"[{CJK}]"), split_runs).otherwise(plain)


def search_text(*parts: Column, tags: Column | None = None) -> Column:
    """Space-joined tokens of the non-empty parts and the tags."""
    pieces = [F.when(p != "", p) for p in parts]
    if tags is not None:
        pieces.append(F.when(F.size(tags) > 0, F.concat_ws(" ", tags)))
    return F.concat_ws(" ", tokens(F.concat_ws("\n", *pieces)))


def title(summary: Column, content: Column, id_: Column, limit: int = 100) -> Column:
    """First line of the summary, else of the content, else ``Memory <id>``."""

    def head(c: Column) -> Column:
        s = strip(text_or_empty(c))
        return F.when(s != "", F.substring(first_line(s), 1, limit))

    return F.coalesce(head(summary), head(content), F.concat(F.lit("Memory "), F.substring(id_, 1, 8)))


def slug(c: Column, limit: int = 60) -> Column:
    s = F.regexp_replace(F.lower(strip(text_or_empty(c))), "[^\\p{L}\\p{N}_]+", "-")
    s = F.btrim(s, F.lit("-"))
    s = F.regexp_replace(F.substring(s, 1, limit), "-+$", "")
    return F.when(s == "", F.lit("untitled")).otherwise(s)


# Rows of these types never give a headline; lines with these starts are skipped.
NOISE_TYPES = ("tool_result",)
JUNK_LINE_STARTS = ("[tool_result:", "confidence:", "evidence:", "recalls:", "status:", "source ", "source:")
BARE_LINES = ("", "{", "}", "[", "]", "```")


def clean_line(c: Column) -> Column:
    """Undo JSON escapes, cut at leaked machine data, collapse spaces; empty when no word is left."""
    s = F.replace(F.replace(F.replace(c, F.lit("\\n"), F.lit(" ")), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    s = F.split(s, '\\s*(?:\\[[a-z_]+\\]\\s*)?\\{"', 2)[0]
    s = F.split(s, "→\\s*session:", 2)[0]
    s = F.rtrim(collapse_spaces(s), F.lit(" -–—:;·|,"))
    return F.when(s.rlike("[\\p{L}\\p{N}_]"), s).otherwise(F.lit(""))


def headline(
    type_: Column, summary: Column, content: Column, junk: Sequence[str] = JUNK_LINE_STARTS, limit: int = 200
) -> Column:
    """One clean line that stands for a memory, or null."""
    from_summary = F.nullif(clean_line(strip(text_or_empty(summary))), F.lit(""))

    def body(raw: Column) -> Column:
        text = F.ltrim(strip(raw), F.lit("-*• "))
        return F.when(
            F.lower(text).startswith("candidate:"), F.substring(text, 11, 1_000_000_000)
        ).otherwise(text)

    def usable(b: Column) -> Column:
        low = F.lower(strip(b))
        bad = low == ""
        for start in junk:
            bad = bad | low.startswith(start)
        return ~bad

    candidates = F.filter(lines(text_or_empty(content)), lambda r: ~strip(r).isin(*BARE_LINES))
    bodies = F.filter(F.transform(candidates, body), usable)
    cleaned = F.filter(F.transform(bodies, clean_line), lambda s: s != "")
    from_content = F.get(cleaned, F.lit(0))
    noise = F.lower(text_or_empty(type_)).isin(*NOISE_TYPES)
    return F.when(~noise, F.substring(F.coalesce(from_summary, from_content), 1, limit))


def redact(c: Column) -> Column:
    """Remove role words, mask key-like strings, collapse white space."""
    s = F.regexp_replace(text_or_empty(c), "(?i)\\b(assistant|user|system|subagent)\\b", "")
    s = F.regexp_replace(s, "\\b(sk-[A-Za-z0-9]{16,}|[A-Za-z0-9_\\-]{32,})\\b", "***")
    return collapse_spaces(s)


def clean_control(c: Column, limit: int | None = None) -> Column:
    """Control characters as blanks, some removed; the first ``limit`` characters, or all."""
    s = F.regexp_replace(c, "[\\x00\\uffff]", "")
    s = F.regexp_replace(s, "[\\x01-\\x08\\x0B\\f\\x0E-\\x1F]", " ")
    return s if limit is None else F.substring(s, 1, limit)


def token_estimate(c: Column) -> Column:
    n = F.length(text_or_empty(c))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("int")


def bigram_set(c: Column) -> Column:
    s = strip(F.lower(text_or_empty(c)))
    return F.when(F.length(s) >= 2, F.array_distinct(ngrams(s, 2))).otherwise(F.array(s))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def split_tags(c: Column) -> Column:
    """Tags written as one string: separated by commas or white space."""
    return F.filter(F.split(strip(c), "[,\\s]+"), lambda t: t != "")


def iso_to_utc(c: Column) -> Column:
    """ISO-8601 text to a naive UTC timestamp; null when malformed."""
    s = F.regexp_replace(strip(c), "Z$", "+00:00")
    zoned = F.expr("true") & s.rlike("[+-]\\d{2}:?\\d{2}$")
    with_zone = F.try_to_timestamp(s).cast("timestamp_ntz")
    naive = s.try_cast("timestamp_ntz")
    return F.when(zoned, with_zone).otherwise(naive)


# How a consolidated entry lists the rows it was made from.
SOURCE_LINE = "来源记忆 \\((\\d+)\\): (.+)$"


def source_ids(c: Column) -> Column:
    """Ids listed on the source line of a consolidated entry; empty array when there is none."""
    found = F.regexp_extract(text_or_empty(c), "(?m)" + SOURCE_LINE, 2)
    return F.filter(F.transform(F.split(found, ","), strip), lambda x: x != "")


def graph_label(c: Column) -> Column:
    s = strip(F.translate(text_or_empty(c), '"[]|\n', "'()/ "))
    return F.when(s == "", F.lit("?")).otherwise(s)


def strip_prefixes(c: Column, prefixes: Sequence[str], limit: int = 120) -> Column:
    """Drop leading labels in the given order, at most once each, then cut."""
    s = collapse_spaces(c)
    for p in prefixes:
        s = F.regexp_replace(s, "^" + re.escape(p) + "\\s*", "")
    return F.nullif(F.substring(s, 1, limit), F.lit(""))


def opening(c: Column, chars: int | None) -> Column:
    """The first ``chars`` characters; the whole text where there is no such limit."""
    return c if chars is None else F.substring(c, 1, chars)


def fingerprint(c: Column, chars: int | None = None) -> Column:
    """What texts are compared by: lower case, without white space around; of the opening only, if ``chars`` is given."""
    return F.lower(strip(opening(text_or_empty(c), chars)))


def snippet(content: Column, query: Column, length: int = 240) -> Column:
    """Excerpt around the first hit of the query or one of its tokens; the head when nothing is found."""
    content = text_or_empty(content)
    low = F.lower(content)
    needles = F.filter(
        F.concat(F.array(F.lower(strip(text_or_empty(query)))), tokens(query)), lambda n: n != ""
    )
    hits = F.filter(F.transform(needles, lambda n: F.instr(low, n)), lambda p: p > 0)
    pos = F.coalesce(F.get(hits, F.lit(0)), F.lit(0))
    start = F.when(pos > 0, F.greatest(F.lit(1), pos - length // 3)).otherwise(F.lit(1))
    cut = strip(F.substring(content, start, F.lit(length)))
    return F.when(F.length(cut) < F.length(strip(content)), F.concat(cut, F.lit("…"))).otherwise(cut)


SYSTEM_TAG_STARTS = ("promoted:", "dream-cluster:", "auto-knowledge")


def strip_system_tags(tags: Column, starts: Sequence[str] = SYSTEM_TAG_STARTS) -> Column:
    def ordinary(t: Column) -> Column:
        keep = F.lit(True)
        for s in starts:
            keep = keep & ~t.startswith(s)
        return keep

    return F.filter(tags, ordinary)
