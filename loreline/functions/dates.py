"""Dates: mail dates, calendar keys and calendar grids. The session zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loreline.functions.text import strip

# Fixed values: "Mon, 05 Feb 2024 10:11:12 +0100 (CET)", week day, zone note optional.
MAIL_DATE = (
    r"(?i)^(?:(?:mon|tue|wed|thu|fri|sat|sun),\s+)?"
    r"(\d{1,2})\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\s+(\d{4})\s+"
    r"(\d{1,2}:\d{1,2}:\d{1,2})\s+"
    r"(?:([+-]\d{2}):?(\d{2})(?:\s+\([a-z]+\))?|(Z)|(GMT|UTC))$"
)


def mail_date(c: Column) -> Column:
    """struct(text, ts). `text` is ISO with the sender's offset, or the raw text.

    The offset is kept in the text because the year of an item is read from it.
    """
    s = strip(c)
    part = lambda i: F.regexp_extract(s, MAIL_DATE, i)
    clock = F.concat_ws(" ", part(1), part(2), part(3), part(4))
    local = F.try_to_timestamp(clock, F.lit("d MMM yyyy H:m:s"))
    zone = (
        F.when(part(5) != "", F.concat(part(5), F.lit(":"), part(6)))
        .when(part(7) != "", F.lit("+00:00"))
        .otherwise(F.lit(""))
    )
    iso = F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), zone)
    return F.struct(
        F.coalesce(iso, c).alias("text"),
        F.try_to_timestamp(iso).alias("ts"),
    )


def commit_date(c: Column) -> Column:
    """Commit time text with `Z` or a numeric offset to a timestamp."""
    s = F.regexp_replace(c, r"\s*Z$", " +0000")
    s = F.regexp_replace(s, r"([+-]\d{2}):(\d{2})$", "$1$2")
    s = F.regexp_replace(s, r"^(\d{4}-\d{2}-\d{2})T", "$1 ")
    return F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss Z"))


def to_utc(c: Column) -> Column:
    """Text or zone-less time to a UTC timestamp."""
    return c.cast("timestamp")


def month_key(ts: Column) -> Column:
    """Year and month."""
    return F.date_format(ts, "yyyy-MM")


def week_key(ts: Column) -> Column:
    """Year and Monday-based week; days before the first Monday are week 00."""
    week = F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7)
    return F.concat(F.date_format(ts, "yyyy"), F.lit("-"), F.lpad(week.cast("string"), 2, "0"))


def year_of(date_text: Column) -> Column:
    """The first four characters of a date text."""
    return F.left(date_text, F.lit(4))


def days_before(ts: Column, days: int) -> Column:
    """The same time of day `days` days earlier."""
    return ts - F.make_dt_interval(days=F.lit(days))


def month_grid(lo: Column, hi: Column, complete: bool = False) -> Column:
    """Month starts at the time of day of `lo`, on or after `lo`, up to `hi`.

    A partial first month has no entry. `complete` starts at the month of `lo` instead.
    """
    clock = lo - F.date_trunc("day", lo)
    month = F.date_trunc("month", lo)
    one = F.make_ym_interval(F.lit(0), F.lit(1))
    if complete:
        first, last = month, F.date_trunc("month", hi)
    else:
        first = F.when(F.dayofmonth(lo) == 1, lo).otherwise(month + one + clock)
        last = hi
    return F.when(first <= last, F.sequence(first, last, one)).otherwise(
        F.array().cast("array<timestamp>")
    )


def week_grid(lo: Column, hi: Column) -> Column:
    """Mondays at the time of day of `lo`, on or after `lo`, up to `hi`."""
    first = lo + F.make_dt_interval(days=F.pmod(F.lit(7) - F.weekday(lo), F.lit(7)))
    week = F.make_dt_interval(days=F.lit(7))
    return F.when(first <= hi, F.sequence(first, hi, week)).otherwise(
        F.array().cast("array<timestamp>")
    )


def feed_pubdate(ts: Column) -> Column:
    """Mail style date text; null stays null."""
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss Z")


def feed_pubdate_text(text: Column) -> Column:
    """Mail style date text of an ISO date text, at the text's own offset; UTC where it has none."""
    zone = r"(?<=[0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,9})?)?)[ ]?(?:Z|([+-][0-9]{2}):?([0-9]{2}))$"
    offset = F.concat(F.regexp_extract(text, zone, 1), F.regexp_extract(text, zone, 2))
    local = F.date_format(F.try_to_timestamp(F.regexp_replace(text, zone, "")), "EEE, dd MMM yyyy HH:mm:ss ")
    return F.concat(local, F.when(offset != "", offset).otherwise(F.lit("+0000")))
