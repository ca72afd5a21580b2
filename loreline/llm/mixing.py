"""Mixing sources to target weights by Efraimidis-Spirakis keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreline.llm.common import packed, stored, text_or_empty, word_count

#: Keys of a source are dealt to so many ordered buckets; only the bucket that holds the cut is sorted.
BUCKETS = 256
#: Characters a word takes in ordinary prose, its separator included.
PROSE_WORD = 6.5


def prose_quality(text: Column, size: Column) -> Column:
    """Weight in [0.25, 1]: how near the mean length of a word is to that of prose; 0.25 without words."""
    off = F.abs(F.length(text) / size - PROSE_WORD) / PROSE_WORD
    return F.when(size > 0, F.greatest(F.lit(0.25), 1 / (1 + off))).otherwise(F.lit(0.25))


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the key's text alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 1) / float(2**52 + 1)


def source_targets(sums: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """Targets of sources (known, source, source_size): weights repeat by code point order, null last.

    The level at which `min(level * weight, most * size)` adds up to all sizes is found with running
    sums over the sources in the order in which they reach their limit. One row per source.
    """
    everywhere = W.partitionBy()
    by_name = everywhere.orderBy(F.desc("known"), "source")
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    limited = (
        sums.withColumn("weight", weight)
        .withColumn("limit", F.col("source_size") * float(most))
        .withColumn("reach", F.col("limit") / F.col("weight"))
    )
    before = everywhere.orderBy("reach", F.desc("known"), "source").rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("source_size").over(everywhere)
    left = total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # The level holds once the first source in this order stays below its limit.
    first = F.min(F.when(F.col("reach") > F.col("at"), F.struct("reach", (-F.col("at")).alias("under")))).over(everywhere)
    return (
        limited.withColumn("at", left / heavy)
        .withColumn("level", -first["under"])
        .withColumn("target", F.when(F.col("level").isNull() | (F.col("reach") <= F.col("level")), F.col("limit")).otherwise(F.col("level") * F.col("weight")))
        .select("known", "source", "source_size", "target")
    )


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    size: Column | None = None, quality: Column | None = None,
    weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: str = "mix",
) -> DataFrame:
    """How often each document enters a mix in which sources have target sizes.

    Returns (row, size, source_size, target, copies, taken); `row` is the caller's row as a struct.
    A source with target T and size S is read floor(T / S) times whole; the rest T - floor(T/S) * S is
    filled from documents in the order of -ln(u) / quality, u a hash of the id, up to the document whose
    end lies nearest to the target. `size` and `quality` are columns of `docs`; by default words of the
    text and how prose-like they are.

    The keys of a source are cut into ordered buckets. Sums by bucket tell which bucket holds the cut, and
    only its rows, one in 256, are sorted: a source with a third of all rows stays spread over all tasks,
    and no text is shuffled except in that bucket. Sources themselves are ranked in one task, one row each.

    Null text counts as empty (size 0), a null source is a source of its own and ranked last, a null id
    hashes as empty. Repeated rows each count and are equal choices. An empty table gives no rows.
    """
    text = text_or_empty(F.col(f"row.`{text_col}`"))
    source = F.col(f"row.`{source_col}`").cast("string")
    rows = packed(docs.withColumns({k: v for k, v in (("__size", size), ("__quality", quality)) if v is not None}))
    rows = rows.withColumn("size", F.col("row.__size") if size is not None else word_count(text))
    w = F.col("row.__quality") if quality is not None else prose_quality(text, F.col("size"))
    added = [c for c in ("__size", "__quality") if c in rows.schema["row"].dataType.names]
    rows = (
        rows.withColumn("known", source.isNotNull())
        .withColumn("source", F.coalesce(source, F.lit("")))
        .withColumn("u", uniform(F.col(f"row.`{id_col}`"), seed))
        .withColumn("w", w)
        .withColumn("key", -F.log("u") / F.col("w"))
        .withColumn("bucket", F.least(F.floor((1 - F.pow("u", 0.5 / F.col("w"))) * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    )
    if added:
        rows = rows.withColumn("row", F.col("row").dropFields(*added))

    by = ["known", "source"]
    sums = stored(rows.groupBy(*by, "bucket").agg(F.sum("size").alias("b_size")), "mix-buckets")
    targets = source_targets(sums.groupBy(*by).agg(F.sum("b_size").alias("source_size")), weights, most)
    upto = W.partitionBy(*by).orderBy("bucket")
    whole = F.floor(F.col("target") / F.col("source_size"))
    plan = (
        sums.withColumn("upto", F.sum("b_size").over(upto))
        .join(targets, by)
        .withColumn("epochs", F.when(F.col("source_size") > 0, whole).otherwise(0).cast("int"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .groupBy(*by)
        .agg(
            *[F.first(c).alias(c) for c in ("source_size", "target", "epochs", "rest")],
            F.min_by(F.struct("bucket", (F.col("upto") - F.col("b_size")).alias("before")), F.when(F.col("upto") > F.col("rest"), F.col("bucket"))).alias("cut"),
        )
        .select(*by, "source_size", "target", "epochs", "rest", F.coalesce("cut.bucket", F.lit(BUCKETS)).alias("cut"), F.coalesce("cut.before", F.lit(0)).alias("before"))
    )
    placed = rows.join(stored(plan, "mix-plan"), by)
    out = ["row", "size", "source_size", "target", "copies"]
    clear = placed.where(F.col("bucket") != F.col("cut")).withColumn("copies", F.col("epochs") + (F.col("bucket") < F.col("cut")).cast("int"))
    order = W.partitionBy(*by).orderBy("key", F.col(f"row.`{id_col}`"), "size", F.xxhash64(text)).rowsBetween(W.unboundedPreceding, 0)
    running = F.col("before") + F.sum("size").over(order)
    edge = placed.where(F.col("bucket") == F.col("cut")).withColumn("copies", F.col("epochs") + (2 * running - F.col("size") <= 2 * F.col("rest")).cast("int"))
    return clear.select(*out).unionByName(edge.select(*out)).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix itself: each document as often as it is taken."""
    taken = mix(docs, **options).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
