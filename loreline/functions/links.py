"""The link of a message body."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loreline.functions.html import unescape
from loreline.functions.text import first_or_null, let

REDIRECTOR = "safelinks.protection.outlook.com"


def _tidy(url: Column) -> Column:
    return F.regexp_replace(unescape(url), r"^[^a-zA-Z]*", "")


def _is_http(url: Column) -> Column:
    return F.startswith(url, F.lit("http://")) | F.startswith(url, F.lit("https://"))


def _has_path(url: Column) -> Column:
    path = F.btrim(F.regexp_replace(url, r"https?://[^/]+", ""), F.lit("/"))
    return F.contains(path, F.lit("/"))


def _all(body: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(body, F.lit(pattern), F.lit(group))


def url_from_originalsrc(body: Column) -> Column:
    """H7: first original address of a rewritten link that leads past a home page."""
    urls = F.transform(_all(body, r'originalsrc="([^"]+)"', 1), _tidy)
    return first_or_null(F.filter(urls, lambda u: _is_http(u) & _has_path(u)))


def url_from_text(body: Column) -> Column:
    """H8: first bare address with at least ten more characters that is no redirect."""
    urls = _all(body, r"""(?U)(https?://[^\s<>"']{10,})""", 1)
    urls = F.filter(urls, lambda u: ~F.contains(u, F.lit(REDIRECTOR)))
    return first_or_null(F.filter(F.transform(urls, _tidy), _is_http))


def url_from_href(body: Column) -> Column:
    """H9: first http(s) target of an anchor."""
    urls = F.transform(_all(body, r'(?i)<a\s[^>]*href="([^"]+)"', 1), _tidy)
    return first_or_null(F.filter(urls, _is_http))


def url_from_safelink(body: Column) -> Column:
    """Target inside the first redirect link. `+` and stray `%` are kept as they are."""
    pattern = r"""(?U)https?://eur\d*\.safelinks\.protection\.outlook\.com/\?url=([^&"\s]+)"""
    coded = F.nullif(F.regexp_extract(body, pattern, 1), F.lit(""))
    coded = F.regexp_replace(coded, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(F.replace(coded, F.lit("+"), F.lit("%2B")))


def best_url(body: Column) -> Column:
    """First hit of the four ways, '' without any."""
    return F.coalesce(
        url_from_originalsrc(body),
        url_from_text(body),
        url_from_href(body),
        url_from_safelink(body),
        F.lit(""),
    )


def without_addresses(c: Column) -> Column:
    """A line without web and mail addresses."""

    def cut(t: Column, part: str, pattern: str) -> Column:
        # The plain search spares most lines the pattern.
        return let(t, lambda u: F.when(F.contains(u, F.lit(part)), F.regexp_replace(u, pattern, "")).otherwise(u))

    c = cut(c, "://", r"(?U)https?://\S+")
    c = cut(c, "www.", r"(?U)\bwww\.\S+")
    return cut(c, "mailto:", r"(?U)mailto:\S+")
