"""Joins that are more than an equality: as-of, first rule, precedence, registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Characters of the piece a rule is found by.
RULE_GRAM = 4

# Rows of a key and bucket that one task sorts; more are split by position, at every so many of a sample.
CELL_ROWS, PER_CUT = 1_000_000, 32


def split_cells(rows: DataFrame, keys: list[str], place: str = "_pos", bucket: str = "_bucket") -> DataFrame:
    """Rows with `bucket` as a struct (bucket, range): the place of a row among positions that cut a large cell.

    A cell is a key and bucket. One of more than `CELL_ROWS` rows is cut at positions from a sample, drawn by a hash of the
    position so that every reading of the plan cuts alike; equal positions stay together. Other cells have one range.
    """
    cell = [*keys, bucket]
    large = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > CELL_ROWS)
    share = PER_CUT * F.ceil(F.col("_n") / CELL_ROWS) / F.col("_n")
    drawn = rows.select(*cell, place).join(large, cell).filter(F.pmod(F.xxhash64(*keys, place), F.lit(1 << 20)) < share * (1 << 20))
    cuts = drawn.groupBy(*cell).agg(F.array_sort(F.collect_set(place)).alias("_drawn"))
    cuts = cuts.select(*cell, F.filter("_drawn", lambda x, i: i % PER_CUT == PER_CUT - 1).alias("_cuts"))
    below = F.size(F.filter(F.coalesce("_cuts", F.array().cast(rows.select(F.array(place).alias("a")).schema["a"].dataType)), lambda c: c <= F.col(place)))
    return rows.join(cuts, cell, "left").withColumn(bucket, F.struct(F.col(bucket).alias("bucket"), below.alias("range"))).drop("_cuts")


def asof_locate(
    points: DataFrame, bounds: DataFrame, keys: list[str], pos: list[str], bucket: Column
) -> DataFrame:
    """Per point the last bound at or before it, and the bound after that one.

    Points and bounds share `keys` and `pos` (the order, compared left to right).
    Adds `start` and `end`, structs of `pos`; `end` is null for the last bound.
    Points before the first bound of their key are dropped.

    `bucket` is an expression that never falls as `pos` rises, such as the day or
    the 128 MB block. Rows are sorted by (key, bucket), so a key that holds a third
    of the table is still spread over its buckets, and a bucket that is too large for a task is cut
    by position (`split_cells`); what crosses buckets is one row per bucket, reduced before its shuffle.
    """
    place = F.struct(*pos)
    p = points.select("*", place.alias("_pos"), F.lit(1).alias("_kind"))
    b = bounds.select(*keys, *pos, place.alias("_pos"), F.lit(0).alias("_kind"))
    rows = (
        p.unionByName(b, allowMissingColumns=True)
        .withColumn("_bucket", bucket)
        .withColumn("_bound", F.when(F.col("_kind") == 0, F.col("_pos")))
    )
    rows = split_cells(rows, keys)
    cell = [*keys, "_bucket"]
    inside = W.partitionBy(*cell).orderBy("_pos", "_kind")
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    back = W.partitionBy(*cell).orderBy(F.desc("_pos"), F.desc("_kind"))
    # Seen backwards, the bounds already passed lie after the row.
    passed = back.rowsBetween(W.unboundedPreceding, W.currentRow)
    located = rows.withColumn("_start", F.last("_bound", True).over(upto)).withColumn(
        "_end", F.last("_bound", True).over(passed)
    )

    summary = rows.groupBy(*cell).agg(F.min("_bound").alias("_first"), F.max("_bound").alias("_last"))
    line = W.partitionBy(*keys).orderBy("_bucket")
    before = line.rowsBetween(W.unboundedPreceding, -1)
    after = (
        W.partitionBy(*keys).orderBy(F.desc("_bucket")).rowsBetween(W.unboundedPreceding, -1)
    )
    carried = summary.select(
        *cell,
        F.last("_last", True).over(before).alias("_carry"),
        F.last("_first", True).over(after).alias("_next"),
    )
    return (
        located.filter(F.col("_kind") == 1)
        .join(carried, cell)
        .withColumn("start", F.coalesce("_start", "_carry"))
        .withColumn("end", F.coalesce("_end", "_next"))
        .filter(F.col("start").isNotNull())
        .drop("_pos", "_kind", "_bucket", "_bound", "_start", "_end", "_carry", "_next")
    )


def match_first_rule(
    items: DataFrame, rules: DataFrame, text: str, item_id: str, out: str = "match"
) -> DataFrame:
    """C11: value of the rule with the lowest `ord` whose `segment` occurs in the text.

    Each rule is filed under the piece of `RULE_GRAM` characters of its segment that
    the fewest rules have, a shorter one under itself; the pieces of each distinct
    text meet them by equality, and hits are reduced per text. So ids may repeat,
    pieces that many rules share pair with nothing else, and rules may be many. A
    null text matches nothing; an empty segment matches every other text.
    """
    q = RULE_GRAM
    starts = F.sequence(F.lit(1), F.greatest(F.length("segment") - q + 1, F.lit(1)))
    pieces = rules.filter(F.length("segment") > 0).select(
        "ord", "segment", "value",
        F.explode(F.array_distinct(F.transform(starts, lambda i: F.substr(F.col("segment"), i, F.lit(q))))).alias("_piece"),
    )
    shared = pieces.groupBy("_piece").agg(F.count(F.lit(1)).alias("_rules"))
    filed = (
        pieces.join(shared, "_piece")
        .groupBy("ord", "segment", "value")
        .agg(F.min(F.struct("_rules", "_piece"))["_piece"].alias("_piece"))
    )
    texts = items.select(F.col(text).alias("_text")).filter(F.col("_text").isNotNull()).distinct()
    place = F.sequence(F.lit(1), F.greatest(F.length("_text"), F.lit(1)))
    grams = F.array_distinct(
        F.flatten(F.transform(place, lambda i: F.array(*[F.substr(F.col("_text"), i, F.lit(n)) for n in range(1, q + 1)])))
    )
    hits = texts.select("_text", F.explode(grams).alias("_piece")).join(filed, "_piece")
    hits = hits.filter(F.contains("_text", F.col("segment")))
    best = hits.groupBy("_text").agg(F.min(F.struct("ord", "value")).alias("_best"))
    always = rules.filter(F.length("segment") == 0).agg(F.min(F.struct("ord", "value")).alias("r")).scalar()
    return (
        items.join(best, F.col(text) == F.col("_text"), "left")
        .withColumn("_always", F.when(F.col(text).isNotNull(), always))
        .withColumn(out, F.least("_best", "_always")["value"])
        .drop("_best", "_always", "_text")
    )


def merge_right_wins(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Union of two maps; where both have the key, the right value counts."""
    left = a.select(key, F.col(value).alias("_a"))
    right = b.select(key, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    return left.join(right, key, "full").select(
        key, F.when(F.col("_in_b"), F.col("_b")).otherwise(F.col("_a")).alias(value)
    )


def attach_label(items: DataFrame, labels: DataFrame, default: str = "Other") -> DataFrame:
    """Label of the topic, `default` for topics without one."""
    return (
        items.drop("topic_label")
        .join(labels.select("topic", "topic_label"), "topic", "left")
        .withColumn("topic_label", F.coalesce("topic_label", F.lit(default)))
    )


def filter_standalone(
    pages: DataFrame, prefixes: list[str], names: list[str], path: str = "path"
) -> DataFrame:
    """Pages that are no fragments, by prefix or exact name."""
    fragment = F.col(path).isin(*names)
    for prefix in prefixes:
        fragment = fragment | F.startswith(F.col(path), F.lit(prefix))
    return pages.filter(~fragment)


def page_key(path: Column, registered: Column, manual: str) -> Column:
    """Key of a page: its registered one, else `post:<slug>` of `p/<slug>/<file>`, else `<manual>:<place>`.

    The place of a manual page is its path below the manual, without the index file;
    the first page of the manual is `index`.
    """
    post = F.regexp_extract(path, "^p/([^/]*)/[^/]*$", 1)
    below = F.regexp_extract(path, f"^{manual}/(.*?)/?(?:index\\.html)?$", 1)
    place = F.when(below == "", F.lit("index")).otherwise(below)
    return (
        F.when(registered.isNotNull(), registered)
        .when(F.rlike(path, F.lit("^p/[^/]*/[^/]*$")), F.concat(F.lit("post:"), post))
        .when(F.startswith(path, F.lit(manual + "/")), F.concat(F.lit(manual + ":"), place))
    )


def attach_lastmod(
    pages: DataFrame,
    registry: DataFrame,
    moddates: DataFrame,
    deploy_url: str,
    default: Column,
    manual: str = "lab-manual",
    path: str = "path",
) -> DataFrame:
    """Address and last change of every page, `default` where none is known.

    `registry` has page and file, `moddates` page_key and lastmod.
    """
    files = registry.select(F.col("file").alias(path), F.col("page").alias("_page"))
    dates = moddates.select("page_key", "lastmod")
    root = deploy_url.rstrip("/") + "/"
    return (
        pages.join(files, path, "left")
        .withColumn("page_key", page_key(F.col(path), F.col("_page"), manual))
        .join(dates, "page_key", "left")
        .withColumn("lastmod", F.coalesce("lastmod", default))
        .withColumn("loc", F.concat(F.lit(root), F.replace(F.col(path), F.lit("index.html"), F.lit(""))))
        .drop("_page")
    )


def union_inventory(pages: DataFrame, feeds: DataFrame) -> DataFrame:
    """Page rows and feed rows of the address list."""
    return pages.select("loc", "lastmod").unionByName(feeds.select("loc", "lastmod"))


def latest_by_key(commits: DataFrame, key: str = "key", group: str = "group", ts: str = "ts") -> DataFrame:
    """Newest change of every key and of every group.

    Columns: key, group, level ('key' or 'group'), lastmod. The row of a group has
    no key; `level` tells it from a key that is null. Groups come from the maxima of
    their keys, so the changes themselves are aggregated once.
    """
    keys = commits.groupBy(F.col(key), F.col(group)).agg(F.max(ts).alias("lastmod"))
    groups = keys.groupBy(group).agg(F.max("lastmod").alias("lastmod"))
    whole = groups.withColumn(key, F.lit(None).cast(commits.schema[key].dataType))
    order = [key, group, "level", "lastmod"]
    return keys.withColumn("level", F.lit("key")).select(*order).unionByName(whole.withColumn("level", F.lit("group")).select(*order))
