"""String functions shared by all jobs."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters counted as white space at the ends of a text.
WHITESPACE = (
    "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once, for expressions that use it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """White space, line breaks included, off both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def collapse(c: Column) -> Column:
    """Runs of white space to one blank, ends stripped."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def letters(c: Column) -> Column:
    """Number of letters of any script."""
    return F.length(F.regexp_replace(c, r"[^\p{L}]+", ""))


def starts_with_any(c: Column, prefixes) -> Column:
    """True when the text starts with one of a fixed list of prefixes, as one match."""
    return F.rlike(c, F.lit("^(?:" + "|".join(re.escape(p) for p in prefixes) + ")"))


def contains_any(c: Column, parts) -> Column:
    """True when the text holds one of a fixed list of substrings."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(p)) for p in parts])


def first_or_null(array: Column) -> Column:
    """First element, null for an empty array."""
    return F.get(array, F.lit(0))


def capitalise(c: Column) -> Column:
    """First letter up, all others down; blanks do not start a new word."""
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, 2, 2147483647)))


def normal_title(c: Column) -> Column:
    """The key text of a title: stripped, lower case."""
    return F.lower(strip(c))


def item_key(c: Column) -> Column:
    """md5 of the key text of a title."""
    return F.md5(normal_title(c))


def fallback(a: Column, b: Column, mode: str = "absent") -> Column:
    """`absent` falls back on null only, `empty` on null and on ''."""
    if mode == "absent":
        return F.coalesce(a, b)
    if mode == "empty":
        return F.coalesce(F.nullif(a, F.lit("")), b)
    raise ValueError(f"unknown mode {mode!r}")


def resolve_asset(img: Column, base: str) -> Column:
    """Absolute links stay, file names move under `base`/img, null stays null."""
    return F.when(F.startswith(img, F.lit("http")), img).otherwise(
        F.concat(F.lit(base.rstrip("/") + "/img/"), img)
    )


def strip_marks(comment: Column) -> Column:
    """The comment after its first `^^`, without leading `^` and blanks."""
    tail = F.element_at(F.split(comment, r"\^\^", 2), -1)
    return F.ltrim(tail, F.lit("^ "))


def display_comment(comment: Column, n: int, ellipsis: bool = False) -> Column:
    """Cleaned comment cut to `n` characters, optionally marked when cut."""
    text = strip_marks(comment)
    cut = F.left(text, F.lit(n))
    if not ellipsis:
        return cut
    return F.when(F.length(text) > n, F.concat(cut, F.lit("…"))).otherwise(cut)


def feed_guid(url: Column, doi: Column, title: Column) -> Column:
    """First of url, DOI and title that is not empty."""
    return F.coalesce(F.nullif(url, F.lit("")), F.nullif(doi, F.lit("")), title, F.lit(""))


def news_guid(title: Column, date_text: Column) -> Column:
    """H27 for news: title followed by the date text."""
    return F.concat(F.coalesce(title, F.lit("")), F.coalesce(date_text, F.lit("")))


def feed_description(comment: Column, journal: Column, n: int = 500) -> Column:
    """Comment cut at `n`, led by the journal in brackets when known."""
    text = F.coalesce(display_comment(comment, n), F.lit(""))
    head = F.concat(F.lit("["), journal, F.lit("]"))
    return (
        F.when(F.coalesce(journal, F.lit("")) == "", text)
        .when(text == "", head)
        .otherwise(F.concat(head, F.lit(" "), text))
    )


def percent_text(x: Column) -> Column:
    """`x` as percent with two decimals; null gives an empty text."""
    text = F.format_string("%.2f%%", x.cast("double") * 100)
    return F.when(x.isNotNull(), text).otherwise(F.lit(""))


def page_slug(path: Column, prefix: str, root: str = "README") -> Column:
    """The root page is `index`; others lose `prefix` and turn lower case."""
    return F.when(path == root, F.lit("index")).otherwise(
        F.lower(F.replace(path, F.lit(prefix), F.lit("")))
    )
