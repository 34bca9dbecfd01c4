"""Text functions, Column in and Column out, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry import constants as C

# Characters that count as blank when tokens are estimated (no-break spaces do not).
_BLANKS = "[\\t-\\r\\x1c-\\x20\\u1680\\u2000-\\u2006\\u2008-\\u200a\\u2028\\u2029\\u205f\\u3000]"
_NOT_CJK = "[^\\u4e00-\\u9fff\\u3400-\\u4dbf\\uf900-\\ufaff]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text: Column | str) -> Column:
    """Remove all characters up to U+0020 from both ends."""
    return F.regexp_replace(_col(text), "^[\\x00-\\x20]+|[\\x00-\\x20]+$", "")


def has_text(text: Column | str) -> Column:
    """True when there is a non-blank character; null is false."""
    return F.coalesce(_col(text).rlike("\\S"), F.lit(False))


def normalize_list(values: Column | str) -> Column:
    """Trim, drop blanks, keep the first of equals; null becomes empty."""
    empty = F.array().cast("array<string>")
    kept = F.filter(F.coalesce(_col(values), empty), has_text)
    return F.array_distinct(F.transform(kept, strip))


def utf16_length(text: Column | str) -> Column:
    """Length in 16-bit units, where a supplementary character counts twice."""
    return (F.octet_length(F.encode(_col(text), "UTF-16BE")) / 2).cast("int")


def token_estimate(text: Column | str) -> Column:
    """ceil(CJK / 1.5) + ceil(other non-blank / 4), at least 1; 0 for null or empty text."""
    c = _col(text)
    cjk = F.length(F.regexp_replace(c, _NOT_CJK, ""))
    other = utf16_length(F.regexp_replace(c, _BLANKS, "")) - cjk
    total = F.ceil(cjk / 1.5) + F.ceil(other / 4.0)
    return (F.when(c.isNull() | (c == ""), F.lit(0))
            .otherwise(F.greatest(F.lit(1).cast("long"), total)).cast("int"))


def sha256_hex(text: Column | str) -> Column:
    return F.sha2(F.coalesce(_col(text), F.lit("")), 256)


def tokenize(text: Column | str) -> Column:
    """Lexical terms: runs of a-z0-9, and adjacent pairs inside runs of Han characters (a lone one
    stays as it is)."""
    lowered = F.lower(_col(text))
    plain = F.array_remove(F.split(lowered, "[^a-z0-9]+"), "")
    runs = F.regexp_extract_all(lowered, F.lit("([a-z0-9]+|[\\u4e00-\\u9fff]+)"), 1)
    mixed = F.flatten(F.transform(runs, _run_terms))
    terms = F.when(lowered.rlike("[\\u4e00-\\u9fff]"), mixed).otherwise(plain)
    return F.coalesce(terms, F.array().cast("array<string>"))


def _run_terms(run: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, 2))
    return F.when((run < "\u4e00") | (F.length(run) == 1), F.array(run)).otherwise(pairs)


def keyword_terms(text: Column | str) -> Column:
    """Distinct letter/digit runs of two or more characters, and single Han characters."""
    pattern = "([\\p{L}\\p{Nd}&&[^\\p{IsHan}]]{2,}|\\p{IsHan})"
    return F.array_distinct(F.regexp_extract_all(F.lower(_col(text)), F.lit(pattern), 1))


def sentences(text: Column | str) -> Column:
    """Sentences end after 。！？!? or at a newline; marks stay, blanks go.

    Marks get a newline and lines are split: a regular expression would take most of the time of chunking.
    """
    marked = _col(text)
    for mark in "。！？!?":
        marked = F.replace(marked, F.lit(mark), F.lit(mark + "\n"))
    # trim looks at the ends only, while the pattern of strip is tried at every blank
    blanks = F.lit("".join(map(chr, range(0x21))))
    found = F.transform(F.split(marked, "\n", -1), lambda s: F.trim(s, blanks))
    return F.coalesce(F.filter(found, lambda s: s != ""), F.array().cast("array<string>"))


def limit_text(text: Column | str, n: int) -> Column:
    return F.substring(_col(text), 1, n)


def preview(text: Column | str) -> Column:
    return F.coalesce(limit_text(text, C.PREVIEW_CHARS), F.lit(""))


def snippet(text: Column | str) -> Column:
    c = _col(text)
    cut = F.concat(F.substring(c, 1, C.SNIPPET_CHARS), F.lit("..."))
    return F.when(F.length(c) > C.SNIPPET_CHARS, cut).otherwise(c)


def collapse_ws(text: Column | str, n: int = C.SUMMARY_CHARS) -> Column:
    return limit_text(strip(F.regexp_replace(_col(text), "[ \\t\\n\\x0B\\f\\r]+", " ")), n)


def order_id(text: Column | str) -> Column:
    """First identifier of 3 to 64 characters with _ or -, an ORD prefix or 3 digits in a row."""
    found = F.regexp_extract_all(_col(text), F.lit("\\b([A-Za-z0-9][A-Za-z0-9_-]{2,63})\\b"), 1)
    return F.get(F.filter(found, looks_like_order_id), F.lit(0))


def looks_like_order_id(candidate: Column) -> Column:
    return candidate.rlike("[_-]|^ORD|[0-9]{3}")


def clean_json(text: Column | str) -> Column:
    """Strip blanks, a leading ```json and a trailing ``` fence."""
    opened = strip(F.regexp_replace(strip(text), "^```json", ""))
    return strip(F.regexp_replace(opened, "```$", ""))


def file_basename(name: Column | str) -> Column:
    c = _col(name)
    base = F.regexp_replace(F.regexp_replace(c, "\\\\", "/"), "^.*/", "")
    return F.when(has_text(c), base).otherwise(F.lit("unknown"))


def content_type_norm(mime: Column | str) -> Column:
    c = _col(mime)
    return F.when(has_text(c), F.lower(c)).otherwise(F.lit("application/octet-stream"))


def iso_instant(text: Column | str) -> Column:
    """Timestamp of an ISO-8601 instant ending in Z; null when blank or invalid."""
    c = _col(text)
    shape = "^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}(:\\d{2}(\\.\\d{1,9})?)?Z$"
    return F.when(c.rlike(shape), F.try_to_timestamp(c))


def iso_instant_valid(text: Column | str) -> Column:
    """Blank is allowed (no bound given); anything else must parse."""
    return ~has_text(text) | iso_instant(text).isNotNull()


def input_too_long(text: Column | str, n: int = C.MAX_INPUT_CHARS) -> Column:
    return F.coalesce(utf16_length(text) > n, F.lit(False))


def prompt_text(question: Column | str, context: Column | str) -> Column:
    return F.concat(F.lit("问题：\n"), _col(question), F.lit("\n\n资料：\n"), _col(context))
