"""Items: from raw messages to deduplicated, merged rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from loreline.functions import mail
from loreline.functions.dates import mail_date
from loreline.functions.html import dom_view, strip_style_script
from loreline.functions.links import best_url
from loreline.functions.text import normal_title, strip
from loreline.functions.titles import (
    resolve_title_comment,
    title_from_blocks,
    title_from_lines,
)

TAG = "[paper]"


def prefilter_tagged(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """First half of B1, on the raw text: some line starts with the tagged subject.

    Runs before any parsing, so that untagged mail is dropped at the scan.
    """
    return messages.filter(F.rlike(F.col(raw), F.lit(mail.TAGGED_LINE)))


def filter_tagged(df: DataFrame, subject: str = "subject", tag: str = TAG) -> DataFrame:
    """B1: subject starts with the tag in this case; the rest is the title, not empty."""
    title = strip(F.substring(F.col(subject), len(tag) + 1, 2147483647))
    return df.filter(F.startswith(F.col(subject), F.lit(tag)) & (title != "")).withColumn(
        "title", title
    )


def parse_messages(messages: DataFrame, window: int | None = mail.BOUNDARY_WINDOW, watch: Observation | None = None) -> DataFrame:
    """Tagged messages with title, sender, dates, keywords and body text.

    `hits` is the number of tagged lines of a message, for the counters of a run; `watch` gets their sum, also
    for messages that make no item, when the rows are computed. `window` is that of `select_body`.
    """
    tagged = prefilter_tagged(messages).withColumn("hits", F.regexp_count("raw", F.lit(mail.TAGGED_LINE)))
    if watch is not None:
        tagged = tagged.observe(watch, F.coalesce(F.sum("hits"), F.lit(0)).alias("tagged"))
    parts = (
        tagged
        .withColumn("message", mail.split_message(F.col("raw")))
        .drop("raw")
    )
    h = F.col("message.headers")
    fields = parts.withColumn("subject", mail.header(h, "Subject"))
    fields = filter_tagged(fields.filter(F.col("message").isNotNull()))
    date = mail.header(h, "Date")
    return (
        fields.withColumn("sender", mail.sender_address(mail.header(h, "From")))
        .withColumn("date", date)
        .withColumn("parsed", mail_date(date))
        .withColumn("keywords", mail.header(h, "Keywords"))
        .withColumn(
            "body",
            F.coalesce(
                mail.select_body(
                    F.col("message.body"),
                    mail.header(h, "Content-Type"),
                    mail.header(h, "Content-Transfer-Encoding"),
                    window,
                ),
                F.lit(""),
            ),
        )
        .withColumn("date_parsed", F.col("parsed.text"))
        .withColumn("date_ts", F.col("parsed.ts"))
        .drop("message", "subject", "parsed")
    )


def with_title_and_comment(df: DataFrame, dom: bool = True) -> DataFrame:
    """H11 and H16 on columns `title` (the subject) and `body`: adds url, title, comment.

    `dom` walks the elements of the page (one Arrow hop); without it only the line
    form of the title search runs, and everything stays native.
    """
    df = df.withColumn("url", best_url(F.col("body")))
    df = df.withColumn("clean", strip_style_script(F.col("body")))
    if dom:
        df = df.withColumn("view", dom_view(F.col("clean")))
        df = df.withColumn("clean", F.col("view.body"))
        found = F.coalesce(title_from_blocks(F.col("view.blocks")), title_from_lines(F.col("clean")))
    else:
        found = title_from_lines(F.col("clean"))
    df = df.withColumn("body_title", found)
    df = df.withColumn(
        "resolved",
        resolve_title_comment(F.col("title"), F.col("clean"), F.col("url"), F.col("body_title")),
    )
    return (
        df.withColumn("title", F.col("resolved.title"))
        .withColumn("comment", F.col("resolved.comment"))
        .drop("resolved", "clean", "body_title", "view")
    )


def drop_blank_titles(df: DataFrame, title: str = "title") -> DataFrame:
    """Titles stripped, null and empty ones dropped."""
    return df.withColumn(title, strip(F.col(title))).filter(F.col(title) != "")


def dedupe_first(items: DataFrame, order: Column, title: str = "title") -> DataFrame:
    """Per key text of the title the first item by `order`; empty keys dropped.

    An aggregate, not a window: copies are reduced before the shuffle, so a title
    that a third of all rows share sends one row per task. Rows with an empty key are one group, dropped after it:
    a filter before it would move below the steps that make the title, and make it twice and more.
    """
    row = F.struct(*items.columns)
    return (
        items.withColumn("_key", F.nullif(normal_title(F.col(title)), F.lit("")))
        .groupBy("_key")
        .agg(F.min_by(row, order).alias("_row"), F.max("_key").alias("_title"))
        .filter(F.col("_title").isNotNull())
        .select("_row.*")
    )


def carry_enrichment(new: DataFrame, old: DataFrame, order: str = "ord", title: str = "title") -> DataFrame:
    """Doi and journal of an earlier run by key text, '' where there is none.

    Old rows with neither are ignored; of several the last by `order` counts.
    """
    known = (
        old.select(
            normal_title(F.col(title)).alias("_key"),
            F.col(order).alias("_ord"),
            F.coalesce(strip(F.col("doi")), F.lit("")).alias("_doi"),
            F.coalesce(strip(F.col("journal")), F.lit("")).alias("_journal"),
        )
        .filter((F.col("_key") != "") & ((F.col("_doi") != "") | (F.col("_journal") != "")))
        .groupBy("_key")
        .agg(F.max_by(F.struct("_doi", "_journal"), "_ord").alias("_old"))
    )
    keep = [c for c in new.columns if c not in ("doi", "journal")]
    # Rows without a title have keys of their own, which match nothing, so they don't meet in one task.
    apart = F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string"))
    key = normal_title(F.col(title))
    return (
        new.withColumn("_key", F.when(key != "", key).otherwise(apart))
        .join(known, "_key", "left")
        .select(
            *keep,
            F.coalesce("_old._doi", F.lit("")).alias("doi"),
            F.coalesce("_old._journal", F.lit("")).alias("journal"),
        )
    )


def with_sender_name(items: DataFrame, people: DataFrame, sender: str = "sender") -> DataFrame:
    """Name of the sender by address in any case, else the part before the `@`.

    `people` has email and name. The join side is left to Spark, which knows its size.
    """
    names = (
        people.filter(F.coalesce("email", F.lit("")) != "")
        .groupBy(F.lower("email").alias("_email"))
        .agg(F.max("name").alias("_name"))
    )
    # Rows without a sender have keys of their own, as above.
    apart = F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string"))
    return (
        items.withColumn("_email", F.when(F.col(sender) != "", F.lower(F.col(sender))).otherwise(apart))
        .join(names, "_email", "left")
        .withColumn("from_name", F.coalesce("_name", F.substring_index(F.col(sender), "@", 1)))
        .drop("_email", "_name")
    )


def union_folders(*folders: DataFrame) -> DataFrame:
    """G1: extractions one below the other; the order is in their `ord` column."""
    return reduce(lambda a, b: a.unionByName(b), folders)
