"""Stupid-backoff language-model scores from n-gram counts of the whole corpus: n-grams meet by a word they share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreline.llm.common import WORD, packed, stored, text_or_empty
from loreline.session import scratch_path

#: What each step to a shorter context costs.
BACKOFF = 0.4
#: Rows that a task counts at once, words from which on the n-grams are dealt out in one pass more, and passes at most.
TASK_ROWS, PASS_WORDS, PASSES = 1 << 19, 1 << 21, 4
#: An n-gram is frequent from a task's rows or this share of all words (a power of 2) on, whichever is less, and never below the second share.
SHARE, LEAST_SHARE = 8, 16
#: Frequent n-grams are looked for at one word of so many, where there are many. Their counts are those of the whole corpus.
ONE_IN, MANY_WORDS = 32, 1 << 20
#: Rows to count are narrow, and a pass needs its shuffle files no more once its sums are written.
WHILE_COUNTING = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(1 << 16), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: What a row is there for: the terms of a context, or one term behind a frequent context, by its n-gram or by the next longer one.
LEVEL, TERM, LONGER, KINDS = 0, 1, 2, 256


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _places(texts: DataFrame, order: int, width: int, one_in: int = 1) -> DataFrame:
    """One row for each word, or for one in so many: itself as x1, those before it as x2, x3, ..., the next as x0; `before` words precede it, as far as they matter."""
    each = texts.select("at", "h", F.posexplode("h").alias("i", "x1"))
    if one_in > 1:
        each = each.where(F.pmod(F.xxhash64("at", "i"), F.lit(one_in)) == 0)
    earlier = [F.get("h", F.col("i") - k).alias(f"x{k + 1}") for k in range(1, width)]
    return each.select(F.get("h", F.col("i") + 1).alias("x0"), "x1", *earlier, "at", F.least("i", F.lit(order - 1)).alias("before"))


def _gram(first: int, last: int) -> Column:
    """The hash of the n-gram x(first) ... x(last)."""
    return F.xxhash64(F.lit(first - last + 1), *[F.col(f"x{k}") for k in range(first, last - 1, -1)])


def _frequent(texts: DataFrame, total: int, order: int, least_count: int) -> DataFrame:
    """(gram, n): n-grams so frequent that the rows of one would burden a task, and how often the corpus has them."""
    most = max(total >> LEAST_SHARE, min(TASK_ROWS, total >> SHARE), least_count, 1)
    one_in = ONE_IN if total >= MANY_WORDS else 1
    likely = max(1, most // (2 * one_in)) if one_in > 1 else most
    grams = F.array(*[F.when(F.col("before") >= n - 1, _gram(n, 1)) for n in range(1, order + 1)])
    shown = _places(texts, order, order, one_in).select(F.explode(grams).alias("gram")).where("gram IS NOT NULL")
    likely_ones = stored(shown.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= likely).select("gram"), "lm-likely")
    found = _places(texts, order, order)
    for n in range(1, order + 1):
        is_open = (F.col("before") >= n - 1) & (F.col(f"f{n - 1}").isNotNull() if n > 1 else F.lit(True))
        known = F.broadcast(likely_ones.select(F.col("gram").alias(f"f{n}")))
        found = found.withColumn("key", F.when(is_open, _gram(n, 1))).join(known, F.col("key") == F.col(f"f{n}"), "left" if n > 1 else "inner")
    names = [f"f{n}" for n in range(1, order + 1)]
    groups = stored(found.groupBy(*names).agg(F.count("*").alias("n")), "lm-groups")
    each = groups.select(F.explode(F.array(*names)).alias("gram"), "n").where("gram IS NOT NULL")
    return stored(each.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= most), "lm-frequent")


def _with_frequent(rows: DataFrame, frequent: DataFrame, order: int, width: int, others: Column) -> DataFrame:
    """Places with c1, c2, ...: counts of the n-grams that end there, and g2, g3, ...: of those that end at the next word; null if not frequent.

    Of places whose word is not frequent, those that `others` names.
    """

    def meet(rows: DataFrame, name: str, is_open: Column, gram: Column) -> DataFrame:
        known = F.broadcast(frequent.select(F.col("gram").alias(f"_{name}"), F.col("n").alias(name)))
        return rows.withColumn("key", F.when(is_open, gram)).join(known, F.col("key") == F.col(f"_{name}"), "left").drop("key", f"_{name}")

    for r in range(1, width + 1):
        rows = meet(rows, f"c{r}", (F.col("before") >= r - 1) & (F.col(f"c{r - 1}").isNotNull() if r > 1 else F.lit(True)), _gram(r, 1))
        rows = rows.where(F.col("c1").isNotNull() | others) if r == 1 else rows
    for k in range(2, order + 1):
        shorter = F.col(f"g{k - 1}").isNotNull() if k > 2 else F.col("x0").isNotNull()
        rows = meet(rows, f"g{k}", shorter & F.col(f"c{k - 1}").isNotNull() & (F.col("before") >= k - 2), _gram(k - 1, 0))
    return rows


def _in_pass(key: Column, p: int, passes: int) -> Column:
    return F.pmod(key, F.lit(passes)) == p


def _key(code: Column | int, first: int, last: int) -> Column:
    return F.xxhash64(F.lit(code), _gram(first, last))


def _dealt(texts: DataFrame, frequent: DataFrame, order: int, width: int, p: int, passes: int) -> tuple[DataFrame, Column]:
    """Rows to count in a pass, and the key by which all rows that count an n-gram come together.

    A word and its neighbours are one row with the key x1, as all n-grams of its terms hold x1. Where x1 is frequent, the
    row has the shortest context that is not (LEVEL), and each term whose context is frequent a row of its own, with the
    key of its n-gram (TERM) or, if that is frequent as well, of the next longer one (LONGER).
    """
    single = LEVEL * KINDS + 1
    places = _with_frequent(_places(texts, order, width), frequent, order, width, _in_pass(_key(single, 1, 1), p, passes))
    null = F.lit(None).cast("int")
    hot = {r: F.col(f"c{r}").isNotNull() for r in range(1, width + 1)}
    level, keys, logs = null, F.lit(None).cast("long"), F.lit(None).cast("double")
    for r in range(2, width + 1):
        level = F.when(hot[r - 1] & ~hot[r] & (F.col("before") >= r - 1), F.lit(LEVEL * KINDS + r)).otherwise(level)
    terms = []
    for r in range(1, order):
        short = F.col(f"g{r + 1}").isNull()
        longer = (F.col("before") >= r) & F.col(f"g{r + 2}").isNull() if r + 2 <= order else F.lit(False)
        code = F.when(short, F.lit(TERM * KINDS + r)).when(longer, F.lit(LONGER * KINDS + r))
        terms.append(F.when(hot[r] & F.col("x0").isNotNull(), code).otherwise(null))
    codes = F.when(~hot[1], F.array(F.lit(single))).otherwise(F.array(level, *terms))
    code = F.floor(F.col("what") / order).cast("int")
    for r in range(1, order):
        logs = F.when(code == TERM * KINDS + r, F.log(f"c{r}")).when(code == LONGER * KINDS + r, F.log(F.col(f"g{r + 1}") / F.col(f"c{r}"))).otherwise(logs)
        keys = F.when(code == TERM * KINDS + r, _key(code, r, 0)).otherwise(keys)
        if r + 2 <= order:
            keys = F.when(code == LONGER * KINDS + r, _key(code, r + 1, 0)).otherwise(keys)
    for r in range(width, 0, -1):
        keys = F.when(code == LEVEL * KINDS + r, _key(code, r, 1)).otherwise(keys)
    logs = F.when(code == LEVEL * KINDS + 2, F.log("c1")).otherwise(logs) if width > 1 else logs
    rows = places.withColumn("code", F.explode(codes)).where("code IS NOT NULL").withColumn("what", F.col("code") * order + F.col("before"))
    return rows.where(_in_pass(keys, p, passes)).select(*[f"x{k}" for k in range(width + 1)], "at", "what", logs.alias("known")), keys


def _known_terms(places: DataFrame, total: int, order: int) -> DataFrame:
    """(at, sum) of the terms whose counts are all known as those of frequent n-grams."""
    first = F.when(F.col("c1").isNotNull() & ((F.col("before") == 0) | F.lit(order == 1)), F.log(F.col("c1") / total))
    terms = [
        F.when(F.col("x0").isNotNull() & (F.lit(r + 1 == order) | (F.col("before") < r)), F.log(F.col(f"g{r + 1}") / F.col(f"c{r}"))) for r in range(1, order)
    ]
    value = reduce(Column.__add__, [F.coalesce(term, F.lit(0.0)) for term in [first, *terms]])
    return places.select("at", value.alias("value")).where("value <> 0").groupBy("at").agg(F.sum("value").alias("sum"))


def _times(grams: np.ndarray) -> np.ndarray:
    """How often each value stands in the array."""
    order = np.argsort(grams)
    ordered = grams[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    counts = np.diff(np.append(starts, len(grams)))
    times = np.empty(len(grams), np.int64)
    times[order] = np.repeat(counts, counts)
    return times


def _sums(order: int, least_count: int, total: int, width: int):
    """(at, value) of the terms that a task's rows decide, as far as they aren't 0."""
    step = np.log(BACKOFF)

    def values(kind: int, r: int, x: list[np.ndarray], before: np.ndarray, follows: np.ndarray, known: np.ndarray) -> np.ndarray:
        def times(first: int, last: int) -> np.ndarray:
            key = x[last]
            for k in range(last + 1, first + 1):
                key = key * np.int64(-7046029254386353131) + x[k]
            return _times(key)

        out, longest = np.zeros(len(before)), np.minimum(order, before + 2)
        if kind == LONGER:
            return np.where(times(r + 1, 0) < least_count, known + step * (longest - r - 1), out)
        if kind == TERM:
            n = times(r, 0)
            hit = n >= least_count
            if r + 2 <= order:
                hit &= (before < r) | (times(r + 1, 0) < least_count)
            return np.where(hit, np.log(n) - known + step * (longest - r - 1), out)
        contexts = {j: times(j, 1) for j in range(r, max(order, min(order, 2) + 1 if r <= 2 else 0))}
        still = follows.copy()
        for k in range(order, r, -1):
            n = times(k - 1, 0)
            hit = still & (before >= k - 2) & (n >= least_count)
            out[hit] = (np.log(n / contexts[k - 1]) + step * (longest - k))[hit]
            still &= ~hit
        if r <= 2:  # the word x1 by itself
            alone = before == 0 if order > 1 else np.ones(len(out), bool)
            if order > 1:
                alone |= contexts[2] < least_count
            single = np.log(contexts[1]) if r == 1 else known
            out += np.where(alone, single - np.log(total) + step * (np.minimum(order, before + 1) - 1), 0.0)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        column = {name: rows.column(name).combine_chunks().fill_null(0).to_numpy() for name in rows.column_names}
        follows = rows.column("x0").is_valid().combine_chunks().to_numpy(zero_copy_only=False)
        del rows, held
        value = np.zeros(len(follows))
        codes, before = np.divmod(column["what"], order)
        for code in np.flatnonzero(np.bincount(codes)).tolist():
            own = np.flatnonzero(codes == code)
            x = [column[f"x{k}"][own] for k in range(width + 1)]
            value[own] = values(*divmod(code, KINDS), x, before[own], follows[own], column["known"][own])
        found = np.flatnonzero(value)
        yield pa.RecordBatch.from_arrays([pa.array(column["at"][found]), pa.array(value[found])], names=["at", "value"])

    return run


def lm_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = 3, least_count: int = 2) -> DataFrame:
    """(doc_id, n_words, score) of each row: the sum of log S over its words.

    S(w | context) is count(context w) / count(context) where the corpus shows the n-gram `least_count` times
    or more, else `BACKOFF` times S with the first word of the context dropped; for a single word it is its
    share of all words. Words are runs without ASCII white space, as they stand. Contexts do not cross
    documents; counts cover all documents, each repeated row included.

    Words are hashed once and written. Each word becomes a row with its neighbours, dealt out by the word: all n-grams
    and contexts of two terms (that of the next word, and its own as a single word) hold it, so that one exchange
    finds every count, and a task counts its rows by sorting them. The sums of each document are added up last.
    The keys are dealt out in passes, each of which drops its shuffle files before the next, so that disk
    holds a part of them at a time.
    Frequent n-grams would be skewed keys. There are few, as each has a fixed share of all words; they are counted first and
    joined as a broadcast table, and rows that hold them are dealt out by longer n-grams.

    Null and empty texts have 0 words and score 0. Null and repeated ids keep their rows. Empty tables give
    no rows. Words, and n-grams of one order, are told apart by 64 bits of hash.
    """
    spark = docs.sparkSession
    row = packed(docs)
    words = F.regexp_extract_all(text_or_empty(F.col(f"row.`{text_col}`")), F.lit(WORD), F.lit(0))
    hashed = row.select(F.monotonically_increasing_id().alias("at"), F.col(f"row.`{id_col}`").alias("doc_id"), F.transform(words, lambda w: F.xxhash64(w)).alias("h"))
    hashed = hashed.withColumn("words", F.size("h").cast("long"))
    path = scratch_path(spark, "lm-words")
    hashed.write.option("parquet.dictionary.page.size", 8 << 20).parquet(path)
    texts = spark.read.schema(hashed.schema).parquet(path)
    total = texts.agg(F.sum("words")).first()[0] or 0
    width = max(order - 1, min(order, 2))
    passes = min(PASSES, 1 + total // PASS_WORDS)
    tasks = 1 + 3 * total // (2 * passes * TASK_ROWS)
    with _settings(spark, WHILE_COUNTING):
        frequent = _frequent(texts, total, order, least_count)
        places = _with_frequent(_places(texts, order, width), frequent, order, width, F.lit(False))
        sums = [stored(_known_terms(places, max(total, 1), order), "lm-known")]
        tally = _sums(order, least_count, max(total, 1), width)
        for p in range(passes):
            rows, key = _dealt(texts, frequent, order, width, p, passes)
            met = rows.repartition(tasks, key).mapInArrow(tally, "at long, value double")
            sums.append(stored(met.groupBy("at").agg(F.sum("value").alias("sum")), f"lm-sums-{p}"))
    parts = texts.select("at", "doc_id", "words", F.lit(0.0).alias("sum"))
    for part in sums:
        parts = parts.unionByName(part, allowMissingColumns=True)
    whole = parts.groupBy("at").agg(F.first("doc_id", ignorenulls=True).alias("doc_id"), F.sum("words").alias("n_words"), F.sum("sum").alias("score"))
    return whole.select("doc_id", "n_words", "score")
