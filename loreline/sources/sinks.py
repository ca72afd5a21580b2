"""Item files, year layout, feeds and address lists."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreline.functions.dates import year_of
from loreline.schemas import ITEM_COLUMNS

CSV_OPTIONS = {
    "header": True, "quote": '"', "escape": '"', "emptyValue": "",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}

# The fields of a feed entry, in their order.
FEED_FIELDS = ["title", "link", "guid", "author", "pubDate", "description"]

# Characters that no XML document may hold.
NOT_XML = r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]"


def write_items_csv(items: DataFrame, path: str, columns: list[str] = ITEM_COLUMNS) -> None:
    """Item file with a header and a fixed column order; the old one is replaced."""
    items.select(*columns).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def write_items_parquet(items: DataFrame, path: str, columns: list[str] = ITEM_COLUMNS) -> None:
    """The same as Parquet, for the next stage."""
    items.select(*columns).write.mode("overwrite").parquet(path)


def write_by_year(items: DataFrame, path: str, date: str = "date", item_id: str = "item_id") -> None:
    """One folder per year, newest items first.

    Rows are range-partitioned by date, so the files of a year are in order and a year
    that holds most rows is written by many tasks. Years without a date go to `none`.
    """
    d = F.coalesce(F.col(date), F.lit(""))
    order = [d.desc(), F.col(item_id).asc()]
    year = F.coalesce(F.nullif(year_of(d), F.lit("")), F.lit("none"))
    (
        items.repartitionByRange(*order)
        .withColumn("year", year)
        .sortWithinPartitions(F.desc("year"), *order)
        .write.mode("overwrite")
        .partitionBy("year")
        .parquet(path)
    )


def write_feed(
    entries: DataFrame, path: str, *, title: str, link: str, description: str, address: str, built: str, order: list[Column], n: int = 100, language: str = "en-us"
) -> None:
    """A feed document as readers take it: one channel with its fields and the first `n` entries by `order`.

    Entries have some of title, link, guid, author, pubDate and description; those that are null are left out.
    `address` is where the feed itself will be, `built` its date. At most `n` rows meet in the one document.
    """
    def clean(c: Column) -> Column:
        return F.regexp_replace(c, NOT_XML, "")

    fields = [c for c in FEED_FIELDS if c in entries.columns]
    guid = F.when(F.col("guid").isNotNull(), F.struct(F.lit("false").alias("_isPermaLink"), clean(F.col("guid")).alias("_VALUE")))
    item = F.to_xml(F.struct(*[(guid if c == "guid" else clean(F.col(c))).alias(c) for c in fields]), {"rowTag": "item"})
    top = entries.orderBy(*order).limit(n)
    ranked = top.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), item.alias("item"))
    items = ranked.groupBy().agg(F.sort_array(F.collect_list(F.struct("rank", "item"))).alias("items"))
    told = {"title": title, "link": link, "description": description, "language": language, "lastBuildDate": built}
    channel = F.to_xml(F.struct(*[F.lit(v).alias(k) for k, v in told.items()]), {"rowTag": "channel"})
    own = f'<atom:link href={quoteattr(address)} rel="self" type="application/rss+xml"/>\n'
    whole = F.replace(channel, F.lit("</channel>"), F.concat(F.lit(own), F.array_join("items.item", "\n"), F.lit("\n</channel>")))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom">\n'
    items.select(F.concat(F.lit(head), whole, F.lit("\n</rss>")).alias("value")).write.mode("overwrite").text(path)


def write_url_inventory(inventory: DataFrame, path: str) -> None:
    """A10: address list as XML; a long one is several files, as the format allows."""
    inventory.select("loc", "lastmod").write.mode("overwrite").format("xml").options(
        rowTag="url", rootTag='urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    ).save(path)
