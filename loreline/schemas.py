"""Explicit schemas of the tables the jobs read and write; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


# The column order of the item files is a fixed value.
ITEM_COLUMNS = [
    "title", "url", "from", "date", "date_parsed",
    "comment", "keywords", "doi", "journal",
]

ITEM_CSV = T.StructType(_strings(*ITEM_COLUMNS))

NEWS = T.StructType([
    T.StructField("date", T.DateType()),
    *_strings("title", "description", "img", "img_alt"),
])

PRESS = T.StructType([
    T.StructField("date", T.DateType()),
    *_strings("title", "publisher", "url", "description", "img", "img_alt"),
])

ART = T.StructType([
    T.StructField("date", T.DateType()),
    *_strings("title", "publisher", "url", "description", "type"),
    T.StructField("img", T.ArrayType(T.StringType())),
    T.StructField("img_alt", T.ArrayType(T.StringType())),
])

PUBLICATION = T.StructType([
    *_strings("doi", "authors", "title", "publisher"),
    T.StructField("year", T.IntegerType()),
    *_strings("type", "description"),
    T.StructField("resources", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
    T.StructField("highlight", T.BooleanType()),
])

MEMBER = T.StructType([
    *_strings("id", "name", "role", "description", "email"),
    T.StructField("interests", T.ArrayType(T.StringType())),
    T.StructField("other_groups", T.ArrayType(T.StringType())),
    *_strings("photo", "photo_alt"),
])

SOFTWARE = T.StructType(_strings(
    "id", "title", "subtitle", "description", "img", "img_alt", "url_gh", "url_docs",
))

HIGHLIGHT = T.StructType([
    T.StructField("category", T.StringType()),
    T.StructField("papers", T.ArrayType(T.StructType(_strings("authors", "title", "doi")))),
])

POST = T.StructType(_strings("slug", "title", "subtitle", "date", "body"))

EMBEDDING = T.StructType([
    T.StructField("item_key", T.StringType(), False),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

TREND = T.StructType([
    T.StructField("year_month", T.StringType()),
    T.StructField("date", T.TimestampType()),
    T.StructField("topic", T.IntegerType()),
    T.StructField("count", T.LongType()),
    T.StructField("smoothed", T.DoubleType()),
])

GROWTH = T.StructType([
    T.StructField("topic", T.IntegerType()),
    T.StructField("total_papers", T.LongType()),
    T.StructField("growth_rate", T.DoubleType()),
    T.StructField("growth_rate_3mo", T.DoubleType()),
    T.StructField("surge_ratio", T.DoubleType()),
    T.StructField("p_value", T.DoubleType()),
    T.StructField("p_value_3mo", T.DoubleType()),
    T.StructField("hot", T.BooleanType()),
    T.StructField("cold", T.BooleanType()),
    T.StructField("topic_label", T.StringType()),
])
