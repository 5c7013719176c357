"""Text, identity and token expressions. All are Catalyst expressions; lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the lexical search: common bigrams that carry no topic.
STOP_TERMS = ["什么", "哪些", "怎么", "如何", "一下", "介绍", "相关", "经验", "可以", "是否", "这个", "那个"]


def trim(c: Column) -> Column:
    """Drop all characters up to U+0020 at both ends, not just spaces."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def normalise(c: Column) -> Column:
    """No byte-order marks, line feeds only, no white space at line ends, trimmed; null is empty."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "﻿", "")
    c = F.regexp_replace(c, r"\r\n?", "\n")
    return trim(F.regexp_replace(c, r"[ \t\f\x0B]+(?=\n|$)", ""))


def normalise_bytes(c: Column) -> Column:
    """UTF-8 text without byte-order marks, line feeds only, trimmed; line ends stay as they are."""
    text = F.decode(c, "UTF-8")
    return trim(F.regexp_replace(F.regexp_replace(text, "﻿", ""), r"\r\n?", "\n"))


def name_uuid(c: Column) -> Column:
    """The version-3 UUID whose name is the string's UTF-8 bytes."""
    m = F.md5(c.cast("binary"))
    variant = F.lower(F.hex((F.conv(F.substring(m, 17, 2), 16, 10).cast("int").bitwiseAND(63)).bitwiseOR(128)))
    return F.concat(F.substring(m, 1, 8), F.lit("-"), F.substring(m, 9, 4), F.lit("-3"), F.substring(m, 14, 3), F.lit("-"), variant, F.substring(m, 19, 2), F.lit("-"), F.substring(m, 21, 12))


def prefixed_id(prefix: str, c: Column) -> Column:
    """The prefix and the first 48 hex digits of the SHA-256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(c, 256), 1, 48))


def half_up(c: Column, places: int = 4) -> Column:
    s = 10.0**places
    return F.floor(c * s + 0.5) / s


def snippet(c: Column, most: int = 180) -> Column:
    flat = trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def latin_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9+#.]{2,}"), F.lit(0))


def han_bigrams(c: Column) -> Column:
    """All pairs of neighbours in runs of Han characters, without stop terms; repeats stay."""
    runs = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[\p{IsHan}]{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: r.substr(i, F.lit(2)))))
    return F.filter(pairs, lambda p: ~p.isin(STOP_TERMS))


def tokens(c: Column) -> Column:
    """Terms of the lexical search, repeats included."""
    return F.concat(latin_tokens(c), han_bigrams(c))


def rerank_tokens(c: Column) -> Column:
    """Distinct lower-case terms of two characters or more; a term with Han characters adds its neighbour pairs."""
    terms = F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_.:/-]+"), F.lit(0)), lambda t: F.length(t) > 1)
    pairs = F.flatten(F.transform(F.filter(terms, lambda t: t.rlike(r"\p{IsHan}")), lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: r.substr(i, F.lit(2)))))
    return F.array_distinct(F.concat(terms, pairs))


def token_count(c: Column) -> Column:
    """Han characters one by one, and other words between white space: the default counter."""
    return F.size(F.filter(F.split(F.regexp_replace(c, r"([\p{IsHan}])", " $1 "), r"\s+"), lambda w: w != ""))


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def blank_to(c: Column, default: str) -> Column:
    return F.when(F.coalesce(trim(c), F.lit("")) == "", F.lit(default)).otherwise(trim(c))


def first_line(c: Column, most: int = 500) -> Column:
    return F.substring(trim(F.substring_index(c, "\n", 1)), 1, most)
