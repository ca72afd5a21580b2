"""Item files, nested records, posts and pages."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreline.functions.html import html_to_text, page_heading, page_links
from loreline.schemas import ITEM_CSV


def read_items_csv(spark: SparkSession, path: str, schema: T.StructType = ITEM_CSV) -> DataFrame:
    """A3: item files with a header and quoted fields that may hold line breaks, read in splits.

    A line break inside quotes is one after an odd number of quotes since the start of the file. A first pass
    counts the quotes of each split, a sum over the splits of a file tells each one whether it begins inside quotes,
    and the second pass puts lines together to records where they lie. Only the record that crosses the end of a split is
    shuffled, to meet its rest. Quotes must stand only around fields, and doubled inside them. The header must
    name the fields of the schema in their order; empty lines are skipped.
    """
    # Carriage returns are kept, as they may stand in a field; one before a record's end is cut.
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line")
    )
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    counted = lines.groupBy("file", "start").agg(F.sum(quotes).alias("quotes"))
    before = F.sum("quotes").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    splits = counted.select("file", "start", (F.coalesce(before, F.lit(0)) % 2).cast("int").alias("inside"))
    # One row for each split of the files, some hundred thousand for the largest tables.
    known = spark.createDataFrame(splits.collect(), splits.schema)
    pieces = lines.join(F.broadcast(known), ["file", "start"]).mapInPandas(_records(schema.fieldNames()), "file string, start long, kind int, record string")
    parts = pieces.filter("kind IS NOT NULL")
    # A rest belongs to the last record that was left open before it; a split has one of each at most.
    opened = F.sum("kind").over(Window.partitionBy("file").orderBy("start", "kind"))
    stitched = parts.withColumn("opened", opened).groupBy("file", "opened").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "record"))).alias("p"))
    records = pieces.filter("kind IS NULL").select("record").unionByName(stitched.select(F.array_join(F.col("p.record"), "\n").alias("record")))
    records = records.select(F.regexp_replace("record", "\r$", "").alias("record")).filter("record <> ''")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return records.select(F.from_csv("record", ddl, {"quote": '"', "escape": '"'}).alias("r")).select("r.*")


def _records(names: list[str]):
    """Records of the splits (file, start, line, inside) in a task: whole ones without kind, the rest (0) of one
    that an earlier split left open, and what a split leaves open itself (1)."""

    def check(file: str, header: str) -> None:
        if next(csv.reader([header.rstrip("\r")])) != names:
            raise ValueError(f"the header of {file} is {header!r}, not {names}")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, head, first, odd = None, [], False, False, False
        out = []

        def end_of_split() -> None:
            if held:
                out.append((*at, 0 if head else 1, "\n".join(held)))

        for batch in batches:
            for file, start, line, inside in zip(batch["file"], batch["start"], batch["line"], batch["inside"], strict=True):
                if (file, start) != at:
                    end_of_split()
                    at, held, head, first, odd = (file, start), [], bool(inside), start == 0, bool(inside)
                held.append(line)
                odd ^= bool(line.count('"') % 2)
                if odd:
                    continue
                record = "\n".join(held)
                if first:
                    check(file, record)
                else:
                    out.append((file, start, 0 if head else None, record))
                held, head, first = [], False, False
            if out:
                yield pd.DataFrame(out, columns=["file", "start", "kind", "record"]).astype({"kind": "Int32"})
                out = []
        end_of_split()
        if out:
            yield pd.DataFrame(out, columns=["file", "start", "kind", "record"]).astype({"kind": "Int32"})

    return cut


def read_nested_records(
    spark: SparkSession, glob: str, root: str, schema: T.StructType, key: str | None = None
) -> DataFrame:
    """A4: records under `root` of JSON collections, one document per file.

    `root` is a dotted path inside each file. The records there are a list, or with
    `key` a map whose keys become that column. Fields outside the schema are never
    parsed; a single text where the schema has a list of texts becomes a list of one.
    Collections kept in another notation are converted to JSON first.
    """
    texts = T.ArrayType(T.StringType())
    fields = [f for f in schema.fields if f.name != key]
    # The reader gives a list under a text field as its JSON.
    plain = T.StructType([T.StructField(f.name, T.StringType() if f.dataType == texts else f.dataType) for f in fields])
    kind = T.ArrayType(plain) if key is None else T.MapType(T.StringType(), plain)
    for step in reversed(root.split(".")):
        kind = T.StructType([T.StructField(step, kind)])
    files = spark.read.schema(kind).json(glob, multiLine=True)
    records = files.select(F.explode(root).alias("r")) if key is None else files.select(F.explode(root).alias(key, "r"))

    def field(f: T.StructField):
        value = F.col(f"r.`{f.name}`")
        if f.dataType == texts:
            value = F.when(F.startswith(value, F.lit("[")), F.from_json(value, texts)).when(value.isNotNull(), F.array(value))
        return value.alias(f.name)

    own = {f.name: field(f) for f in fields}
    return records.select(*[F.col(key) if n == key else own[n] for n in schema.fieldNames()])


def _front_matter(name: str):
    block = F.regexp_extract("value", r"(?s)\A---[ \t]*\r?\n(.*?\r?\n)---[ \t]*(?:\r?\n|\z)", 1)
    value = F.regexp_extract(block, rf"(?m)^{name}:[ \t]*(.*?)[ \t]*$", 1)
    bare = F.regexp_replace(value, r"""^(["'])(.*)\1$""", "$2")
    return F.nullif(bare, F.lit(""))


def read_posts(spark: SparkSession, glob: str) -> DataFrame:
    """A5: Markdown files with front matter: slug, title, subtitle, date and body.

    The slug is the file stem; a post without a title gets its slug in title case.
    """
    files = spark.read.text(glob, wholetext=True)
    slug = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)
    body = F.regexp_replace("value", r"(?s)\A---[ \t]*\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\z)", "")
    return files.select(
        F.url_decode(slug).alias("slug"),
        _front_matter("title").alias("title"),
        _front_matter("subtitle").alias("subtitle"),
        _front_matter("date").alias("date"),
        body.alias("body"),
    ).withColumn("title", post_title(F.col("title"), F.col("slug")))


def post_title(title, slug):
    """Title of a post, else its slug as words with capitals."""
    return F.coalesce(title, F.initcap(F.replace(slug, F.lit("-"), F.lit(" "))))


def read_html_pages(pages: DataFrame, html: str = "html", *keep: str) -> DataFrame:
    """Title, links and text of every page of a table."""
    return pages.select(
        *keep,
        page_heading(F.col(html)).alias("title"),
        page_links(F.col(html)).alias("links"),
        html_to_text(F.col(html)).alias("text"),
    )
