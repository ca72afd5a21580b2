"""Nested collections to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_keyed(rows: DataFrame, mapping: str, key: str = "id") -> DataFrame:
    """A map of records to one row per record, its key first."""
    return rows.select(F.explode(mapping).alias(key, "_v")).select(key, "_v.*")


def explode_resources(publications: DataFrame, resources: str = "resources", *keep: str) -> DataFrame:
    """A list of one-key maps to (type, url) rows; null and empty lists give none."""
    one = publications.select(*keep, F.explode(resources).alias("_m"))
    return one.select(*keep, F.explode("_m").alias("type", "url"))


def explode_sections(page: DataFrame, sections: str = "highlights", records: str = "papers") -> DataFrame:
    """Sections that hold lists of records, flattened to records with their section."""
    outer = page.select(F.inline(sections))
    return outer.select("category", F.inline(records))


def as_list(value: Column, kind: str) -> Column:
    """A text or a list of texts as a list; null stays null."""
    if kind.startswith("array"):
        return value
    return F.when(value.isNotNull(), F.array(value))


def align_images(rows: DataFrame, *keep: str, img: str = "img", alt: str = "img_alt") -> DataFrame:
    """One row per image with its place and the text at the same place, if any."""
    kinds = dict(rows.dtypes)
    images, texts = as_list(F.col(img), kinds[img]), as_list(F.col(alt), kinds[alt])
    placed = rows.select(*keep, texts.alias("_alt"), F.posexplode(images).alias("pos", "image"))
    return placed.select(*keep, "pos", "image", F.get("_alt", F.col("pos")).alias("alt"))


def null_if_missing_list(rows: DataFrame, values: str, *keep: str, name: str = "value") -> DataFrame:
    """Rows of an optional list; null and empty lists are skipped."""
    return rows.select(*keep, F.explode(values).alias(name))
