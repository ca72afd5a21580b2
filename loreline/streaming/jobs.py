"""The re-runnable parts of the jobs as incremental streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from loreline.functions.text import item_key
from loreline.operators.items import carry_enrichment, dedupe_first, parse_messages, with_title_and_comment
from loreline.sources.archives import MESSAGE_SEPARATOR, message_text
from loreline.sources.keyed_store import BUCKETS, KeyedStore

EXTRACTED = ["title", "subject_title", "url", "sender", "date", "date_parsed", "date_ts", "comment", "keywords"]


def ingest_archive_stream(
    spark: SparkSession, folder: str, sink: str, checkpoint: str, dom: bool = True
) -> StreamingQuery:
    """Archive files not seen before, extracted and appended; then the query ends.

    The checkpoint knows the files, so a second run over the same folder adds nothing.
    All steps look at one message at a time and are those of the batch job.
    """
    raw = (
        spark.readStream.schema("value string")
        .option("lineSep", MESSAGE_SEPARATOR)
        .format("text")
        .load(folder)
        .select(message_text(F.col("value")).alias("raw"))
    )
    parsed = parse_messages(raw).withColumn("subject_title", F.col("title"))
    items = with_title_and_comment(parsed, dom).select(*EXTRACTED)
    return (
        items.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def dedupe_and_merge_stream(
    items: DataFrame, store: str, checkpoint: str, order: str, old: DataFrame | None = None, buckets: int = BUCKETS
) -> StreamingQuery:
    """New titles of a stream of items added to a keyed table, first one kept.

    The table is the state, laid out by hash bucket of the key: each batch is reduced to one row per key
    and meets the keys stored in the buckets it touches, so nothing grows in memory and a batch's cost
    follows its own keys. A batch writes folders of its own and replaces them when it runs again after
    a failure; small batches are put together now and then.
    """
    spark = items.sparkSession
    columns = [c for c in items.columns if c not in ("doi", "journal")]
    fields = [items.schema[c] for c in columns] if old is None else [items.schema[c] for c in columns] + [T.StructField(c, T.StringType()) for c in ("doi", "journal")]

    def merge(batch: DataFrame, batch_id: int) -> None:
        first = dedupe_first(batch.select(*columns), F.col(order)).withColumn("item_key", item_key(F.col("title")))
        if old is not None:
            first = carry_enrichment(first, old, "ord")
        keyed = KeyedStore(spark, store, T.StructType([*fields, T.StructField("item_key", T.StringType())]), "item_key", buckets)
        keyed.add(first, batch_id)
        keyed.compact()

    return (
        items.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def weekly_counts_stream(items: DataFrame, ts: str = "ts", late: str = "7 days") -> DataFrame:
    """Items per week as they arrive; weeks start on Monday.

    The epoch is a Thursday, so seven-day windows start four days after it. In append mode a week is given out
    once, when the watermark (`late` behind the newest item) has passed its end; only open weeks are held.
    """
    week = F.window(ts, "7 days", "7 days", "4 days")
    return (
        items.withWatermark(ts, late)
        .groupBy(week)
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.col("window.start").alias("week_start"), "count")
    )


def weekly_totals_stream(
    items: DataFrame, weeks: str, closed: str, checkpoint: str, ts: str = "ts", late: str = "7 days"
) -> StreamingQuery:
    """J3 with what comes too late: closed weeks and late items as tables.

    The engine's own watermark drops late items unseen, so open weeks are kept in the table `weeks` instead:
    (week_start, count, newest, batch), one row for each open week and one without week, a folder for each
    batch, of which the last counts. Each batch is counted by week before it meets them, so nothing else is
    held. The watermark is `late` behind the newest item of earlier batches; items of weeks that ended by
    then are late. `closed` (week_start, count, late, batch) gets late items counted by week, and each week once, when the
    watermark after a batch has passed its end. A batch that runs again replaces what it wrote. Items without
    time are left out.
    """
    spark = items.sparkSession
    schema = "week_start timestamp, count bigint, newest bigint, batch bigint"
    time, gap = F.col(ts).cast("timestamp"), F.expr(f"INTERVAL {late}")
    ends = F.col("week_start") + F.expr("INTERVAL 7 DAYS")

    def count(batch: DataFrame, batch_id: int) -> None:
        held = spark.createDataFrame([], schema)
        if _exists(spark, weeks):
            held = spark.read.schema(schema).parquet(weeks).where(F.col("batch") < batch_id)
        last, before = held.agg(F.max("batch"), F.max("newest")).first()
        held = held.where(F.col("batch") == last).where("week_start IS NOT NULL").select("week_start", "count", "newest")
        by_week = batch.where(time.isNotNull()).groupBy(F.window(time, "7 days", "7 days", "4 days")["start"].alias("week_start"))
        arrived = by_week.agg(F.count(F.lit(1)).alias("count"), F.max(F.unix_micros(time)).alias("newest")).persist()
        newest = arrived.agg(F.greatest(F.max("newest"), F.lit(before))).first()[0]
        missed = F.coalesce(ends <= F.timestamp_micros(F.lit(before)) - gap, F.lit(False))
        over = F.coalesce(ends <= F.timestamp_micros(F.lit(newest)) - gap, F.lit(False))
        here = F.lit(batch_id).cast("bigint").alias("batch")
        sums = held.unionByName(arrived.where(~missed)).groupBy("week_start").agg(F.sum("count").alias("count"))
        done = sums.where(over).select("week_start", "count", F.lit(False).alias("late"), here)
        _replace(done.unionByName(arrived.where(missed).select("week_start", "count", F.lit(True).alias("late"), here)), closed)
        known = spark.createDataFrame([(None, 0)], "week_start timestamp, count bigint")
        _replace(sums.where(~over).unionByName(known).select("week_start", "count", F.lit(newest).cast("bigint").alias("newest"), here), weeks)
        arrived.unpersist()

    return items.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def weekly_totals(spark: SparkSession, weeks: str, closed: str) -> DataFrame:
    """(week_start, count, late) of all weeks that `weekly_totals_stream` has seen, the open ones included."""
    done = spark.read.schema("week_start timestamp, count bigint, late boolean").parquet(closed).drop("batch")
    state = spark.read.schema("week_start timestamp, count bigint, batch bigint").parquet(weeks)
    held = state.where(F.col("batch") == state.agg(F.max("batch")).scalar()).where("week_start IS NOT NULL")
    both = done.unionByName(held.select("week_start", "count", F.lit(False).alias("late")))
    return both.groupBy("week_start").agg(
        F.sum(F.when(~F.col("late"), F.col("count")).otherwise(0)).alias("count"), F.sum(F.when(F.col("late"), F.col("count")).otherwise(0)).alias("late")
    )


def _replace(rows: DataFrame, path: str) -> None:
    """Write the folders of this batch anew."""
    rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
