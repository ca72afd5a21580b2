"""Publishing tables: years, topics, feeds, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreline.functions import fixed_values as V
from loreline.functions.dates import feed_pubdate, feed_pubdate_text, year_of
from loreline.functions.html import text_summary
from loreline.functions.text import feed_description, feed_guid, news_guid, percent_text
from loreline.operators.lookup import attach_label
from loreline.operators.series import exclude_noise


def group_by_year(items: DataFrame, date: str = "date", newest: Column | None = None) -> DataFrame:
    """Per year of the date text the number of items, first and last date.

    With `newest` (a struct of columns) also the newest item. The items of a year
    are not gathered into one row: `write_by_year` lays them out, newest first.
    """
    d = F.coalesce(date, F.lit(""))
    out = [F.count(F.lit(1)).alias("items"), F.min(d).alias("first_date"), F.max(d).alias("last_date")]
    if newest is not None:
        out.append(F.max_by(newest, F.struct(d, newest)).alias("newest"))
    return items.groupBy(year_of(d).alias("year")).agg(*out)


def topic_counts(items: DataFrame, topic: str = "topic") -> DataFrame:
    """Items per topic."""
    return items.groupBy(topic).agg(F.count(F.lit(1)).alias("papers"))


def n_topics(items: DataFrame, topic: str = "topic") -> DataFrame:
    """Number of distinct topics besides noise, one row.

    Topics are made unique before they are counted, so no task sees all items.
    """
    counts = topic_counts(items, topic)
    return counts.agg(F.count_if(F.col(topic) != V.NOISE_TOPIC).alias("topics"))


def span_text(lo: Column, hi: Column) -> Column:
    """One year, or first and last year joined by a dash entity, '' without dates."""
    return (
        F.when(lo.isNull(), F.lit(""))
        .when(lo == hi, lo)
        .otherwise(F.concat(lo, F.lit("&ndash;"), hi))
    )


def years_span(items: DataFrame, date: str = "date") -> DataFrame:
    """The years that the items with a date cover, one row."""
    year = F.when(F.coalesce(date, F.lit("")) != "", year_of(F.col(date)))
    ends = items.agg(F.min(year).alias("lo"), F.max(year).alias("hi"))
    return ends.select(span_text(F.col("lo"), F.col("hi")).alias("years_span"))


def corpus_stats(items: DataFrame, growth: DataFrame, topic: str = "topic", date: str = "date") -> DataFrame:
    """D3: items, topics, hot topics and years, one row."""
    year = F.when(F.coalesce(date, F.lit("")) != "", year_of(F.col(date)))
    per_topic = items.groupBy(topic).agg(
        F.count(F.lit(1)).alias("n"), F.min(year).alias("lo"), F.max(year).alias("hi")
    )
    hot = growth.agg(F.count_if("hot")).scalar()
    stats = per_topic.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_papers"),
        F.count_if(F.col(topic) != V.NOISE_TOPIC).alias("topics"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
    )
    return stats.select(
        "total_papers", "topics", hot.alias("topics_hot"),
        span_text(F.col("lo"), F.col("hi")).alias("years_span"),
    )


def topic_label_first(items: DataFrame, order: str, topic: str = "topic") -> DataFrame:
    """The label of the first item of every topic by `order`."""
    label = F.coalesce("topic_label", F.concat(F.lit("Topic "), F.col(topic).cast("string")))
    return items.groupBy(topic).agg(F.min_by(label, order).alias("topic_label"))


def newest_first(items: DataFrame, date: str = "date", item_id: str = "item_id") -> DataFrame:
    """by date text, newest first, missing dates last; a distributed range sort."""
    return items.orderBy(F.coalesce(date, F.lit("")).desc(), F.col(item_id))


def latest(items: DataFrame, n: int, date: str = "date", item_id: str = "item_id") -> DataFrame:
    """the `n` newest items; every task keeps only its own `n`."""
    return newest_first(items, date, item_id).limit(n)


def topics_by_size(items: DataFrame, topic: str = "topic") -> DataFrame:
    """topics by number of items, largest first."""
    return topic_counts(items, topic).orderBy(F.desc("papers"), topic)


def order_by_key(rows: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """rows of a keyed collection by key."""
    return rows.orderBy(F.desc(key) if descending else F.asc(key))


def highlighted(rows: DataFrame, flag: str = "highlight") -> DataFrame:
    """Rows whose flag is set."""
    return rows.filter(F.coalesce(F.col(flag), F.lit(False)))


def outside_types(rows: DataFrame, types: list[str], column: str = "type") -> DataFrame:
    """Rows whose type is none of the listed ones."""
    return rows.filter(~F.col(column).isin(*types))


def attach_growth(topics: DataFrame, growth: DataFrame) -> DataFrame:
    """Growth texts and flags per topic; blank and false where there is no growth row."""
    g = growth.select("topic", "growth_rate", "growth_rate_3mo", "hot", "cold")
    return topics.join(g, "topic", "left").select(
        *topics.columns,
        percent_text(F.col("growth_rate")).alias("growth"),
        percent_text(F.col("growth_rate_3mo")).alias("growth_3mo"),
        F.coalesce("hot", F.lit(False)).alias("hot"),
        F.coalesce("cold", F.lit(False)).alias("cold"),
    )


def topic_report(items: DataFrame, growth: DataFrame, labels: DataFrame) -> DataFrame:
    """Every topic with label, size, growth texts and flags, largest first."""
    counted = exclude_noise(topic_counts(items))
    named = counted.join(labels.select("topic", "topic_label"), "topic", "left").select(
        "topic",
        F.coalesce("topic_label", F.concat(F.lit("Topic "), F.col("topic").cast("string"))).alias("label"),
        "papers",
    )
    return attach_growth(named, growth).orderBy(F.desc("papers"), "topic")


def topic_items(items: DataFrame, topics: DataFrame, labels: DataFrame, coords: DataFrame, item_id: str = "item_id") -> DataFrame:
    """One row per item with topic, label and place on the map, null where it has none."""
    joined = items.join(topics.select(item_id, "topic"), item_id, "left").join(coords, item_id, "left")
    return attach_label(joined, labels)


def item_feed(items: DataFrame, link_default: str, n: int = 100, item_id: str = "item_id") -> DataFrame:
    """F2 with H27-H29: the `n` newest items as feed entries."""
    top = latest(items, n, "date_parsed", item_id)
    return top.select(
        item_id,
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("url", F.lit(link_default)).alias("link"),
        feed_guid(F.col("url"), F.col("doi"), F.col("title")).alias("guid"),
        F.nullif("from_name", F.lit("")).alias("author"),
        feed_pubdate_text(F.col("date_parsed").cast("string")).alias("pubDate"),
        feed_description(F.col("comment"), F.col("journal")).alias("description"),
    )


def news_feed(news: DataFrame, now: Column, n: int = 25, item_id: str = "item_id") -> DataFrame:
    """F2 with H27, H29, H30: the `n` newest news as feed entries; `now` for bad dates."""
    text = F.col("date").cast("string")
    top = latest(news.withColumn("date", text), n, "date", item_id)
    return top.select(
        item_id,
        F.coalesce("title", F.lit("")).alias("title"),
        news_guid(F.col("title"), F.col("date")).alias("guid"),
        feed_pubdate(F.coalesce(F.try_to_timestamp("date"), now)).alias("pubDate"),
        F.nullif(text_summary(F.col("description")), F.lit("")).alias("description"),
    )
