"""A1: mail archives as one row per message."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE_SEPARATOR = "\nFrom "


def message_text(value: Column) -> Column:
    """A scanned record; only the first one of a file keeps the words the separator took off."""
    return F.regexp_replace(value, r"\AFrom ", "")


def read_mail_archive(spark: SparkSession, catalogue: list[tuple[str, int, str]]) -> DataFrame:
    """One record per message that starts at a `From ` line, from splittable text files.

    `catalogue` lists (folder, rank, path or glob), one line per mail folder.
    Columns: folder, folder_rank, path, ord, raw. `ord` orders the messages of all
    folders: rank, file, block, row in the scan. A multi-gigabyte file is read by many
    tasks, and no message passes the driver.
    """

    def scan(folder: str, rank: int, path: str) -> DataFrame:
        place = F.struct(
            F.lit(rank).alias("folder_rank"),
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        )
        return spark.read.option("lineSep", MESSAGE_SEPARATOR).text(path).select(
            F.lit(folder).alias("folder"),
            F.lit(rank).alias("folder_rank"),
            F.col("_metadata.file_path").alias("path"),
            place.alias("ord"),
            message_text(F.col("value")).alias("raw"),
        )

    return reduce(DataFrame.unionByName, [scan(*line) for line in catalogue])
