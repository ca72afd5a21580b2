"""Terms, weights and topic labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreline.functions.stopwords import ENGLISH
from loreline.functions.text import capitalise, let, strip
from loreline.session import kept

# Fixed value: a word of any script.
WORD = r"[\p{L}\p{N}_]{2,}"

# Share of rows that names candidates for frequent terms, candidates for each term asked for, and buckets that count the others.
SAMPLED, CANDIDATES, TERM_BUCKETS = 64, 8, 1 << 18

# Words that a task counts at once, unless a single text has more.
BATCH_WORDS = 1 << 22


def normalise_title(c: Column) -> Column:
    """Lower case, anything but a-z, 0-9 and white space to a blank, runs collapsed."""
    c = F.regexp_replace(F.lower(c), r"(?U)[^a-z0-9\s]", " ")
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def tokens(c: Column, stop_words=ENGLISH) -> Column:
    """Lower-case runs of two or more letters, digits and underscores, stop words removed."""
    words = F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))
    stop = [w for w in dict.fromkeys(stop_words)]
    if not stop:
        return words
    return F.filter(words, lambda w: ~w.isin(*stop))


def _pairs(t: Column) -> Column:
    """Each word with the next one; null where one of them is null."""
    n = F.greatest(F.size(t) - 1, F.lit(0))
    return F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def ngrams_1_2(c: Column, stop_words=ENGLISH) -> Column:
    """I8: words and pairs of adjoining words; pairs form after stop words are gone."""
    return let(tokens(c, stop_words), lambda t: F.concat(t, _pairs(t)))


def term_counts(grams: Column) -> Column:
    """array<struct(term, tf)> of a text.

    The terms of a text sit in one row, so they are counted there: sorted, then cut
    into runs. No shuffle by text and term is needed.
    """

    def runs(s: Column) -> Column:
        n = F.size(s)
        places = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(
            F.array().cast("array<int>")
        )
        starts = F.filter(places, lambda i: (i == 0) | (F.get(s, i - 1) != F.get(s, i)))

        def cut(b: Column) -> Column:
            return F.transform(
                b,
                lambda i, j: F.struct(
                    F.get(s, i).alias("term"),
                    (F.coalesce(F.get(b, j + 1), n) - i).cast("bigint").alias("tf"),
                ),
            )

        return let(starts, cut)

    return let(F.sort_array(grams), runs)


def doc_terms(items: DataFrame, text: Column, item_id: str, *keep: str, stop_words=ENGLISH) -> DataFrame:
    """One row per item and term with its count in the item; narrow, no shuffle.

    The outer form with a filter after it: for the inner one the optimizer tests the
    array before it is unfolded, and so builds it twice more.
    """
    counted = items.select(item_id, *keep, term_counts(ngrams_1_2(text, stop_words)).alias("_t"))
    return counted.select(item_id, *keep, F.inline_outer("_t")).filter(F.col("term").isNotNull())


def counted_terms(
    items: DataFrame, text: Column, item_id: str, *keep: str, stop_words=ENGLISH, k: int | None = None, min_df: int = 1, max_df: float = 1.0
) -> DataFrame:
    """A written table with one row per item: a number `_row`, its terms as the lines of one text, and their counts.

    Statistics and weights read it, so texts are cut into terms once. One text is written faster than many. With `k`, terms that
    can't be among the `k` most frequent ones within the bounds on df may be left out; all others have their whole counts.
    """
    row = F.monotonically_increasing_id().alias("_row")
    if k is None:
        return _written(items.select(row, item_id, *keep, term_counts(ngrams_1_2(text, stop_words)).alias("_t")), item_id, *keep)
    words = kept(items.select(row, item_id, *keep, F.array_join(tokens(text, stop_words), " ").alias("_words")), "words")
    cut = F.split("_words", " ")
    names = _contenders(words, k, min_df, max_df)
    if names is None:
        grams = F.when(F.col("_words") != "", let(cut, lambda t: F.concat(t, _pairs(t))))
    else:
        grams = let(_known(cut, names[0]), lambda t: F.filter(F.concat(t, _pairs(t)), lambda g: g.isin(names[0] + names[1])))
    return _written(words.select("_row", item_id, *keep, term_counts(grams).alias("_t")), item_id, *keep)


def _written(counted: DataFrame, item_id: str, *keep: str) -> DataFrame:
    lines = F.array_join(F.col("_t.term"), "\n").alias("_terms")
    return kept(counted.select("_row", item_id, *keep, lines, F.col("_t.tf").cast("array<int>").alias("_tf")), "terms")


def _known(words: Column, names: list[str]) -> Column:
    return F.transform(words, lambda w: F.when(w.isin(names), w))


def _contenders(words: DataFrame, k: int, min_df: int, max_df: float) -> tuple[list[str], list[str]] | None:
    """(words, pairs) of which the `k` most frequent terms are; None if there are more than `CANDIDATES` * k of either.

    The k-th count among single words within the bounds is one that every term of the vocabulary reaches, and a pair is no more
    frequent than each of its words: only pairs of words that reach it are counted.
    """
    cut = F.split("_words", " ")
    some = words.filter("_words <> ''")
    if min_df > 1 or max_df < 1.0:
        sums = term_statistics(some.select(F.inline(term_counts(cut))))
    else:
        # No bound asks for df.
        sums = some.select(F.explode(cut).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("cf"), F.lit(1).alias("df"))
    sums = kept(sums, "word-sums")
    n_items = words.agg(F.count(F.lit(1))).scalar()
    found, bound = top_vocabulary(sums, k, n_items, min_df, max_df).agg(F.count(F.lit(1)), F.min("cf")).first()
    if found < k:
        return None

    def reaching(counts: DataFrame) -> list[str] | None:
        rows = counts.filter(F.col("cf") >= bound).select("term").limit(CANDIDATES * k + 1).collect()
        return [r["term"] for r in rows] if len(rows) <= CANDIDATES * k else None

    single = reaching(sums)
    if single is None:
        return None
    met = some.select(F.explode(let(_known(cut, single), _pairs)).alias("term")).filter("term IS NOT NULL")
    pairs = reaching(met.groupBy("term").agg(F.count(F.lit(1)).alias("cf")))
    return None if pairs is None else (single, pairs)


def unfolded(counted: DataFrame, *keep: str) -> DataFrame:
    """One row per item and term of a table of counted terms."""
    pairs = F.zip_with(F.split("_terms", "\n"), F.col("_tf"), lambda term, tf: F.struct(term.alias("term"), tf.cast("bigint").alias("tf")))
    return counted.filter("_terms <> ''").select(*keep, F.inline(pairs))


def batch_terms(items: DataFrame, text: Column, stop_words=ENGLISH) -> DataFrame:
    """Terms of texts (term, tf, df), summed within a batch of a task: its occurrences, and the texts it is in.

    Words become numbers and pairs products of them, so counting is sorting numbers; a batch hands on one row per distinct term.
    """
    return items.select(tokens(text, stop_words).alias("words")).mapInArrow(_sums_of_batches, "term string, tf bigint, df bigint")


def _sums_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(0)
        before = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(words):
            end = max(int(np.searchsorted(before, (before[at - 1] if at else 0) + BATCH_WORDS, side="right")), at + 1)
            yield from _sums(words.slice(at, end - at))
            at = end


def _sums(words: pa.ListArray) -> Iterator[pa.RecordBatch]:
    coded = words.flatten().dictionary_encode()
    code, known, texts = coded.indices.to_numpy().astype("int64"), len(coded.dictionary), len(words)
    if not known:
        return
    text = np.repeat(np.arange(texts), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
    pair = np.flatnonzero(text[1:] == text[:-1])
    # A word's number, or beyond these that of a pair, and within it the text.
    places = np.concatenate([code, known + code[pair] * known + code[pair + 1]]) * texts + np.concatenate([text, text[pair]])
    places.sort()
    term = places // texts
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    new = np.r_[True, places[1:] != places[:-1]]
    tf, df = np.diff(np.r_[first, len(term)]), np.add.reduceat(new.astype("int64"), first)
    term = term[first]
    single = int(np.searchsorted(term, known))
    left, right = np.divmod(term[single:] - known, known)
    take = coded.dictionary.take
    for names, rows in (
        (take(pa.array(term[:single])), slice(0, single)),
        (pc.binary_join_element_wise(take(pa.array(left)), take(pa.array(right)), " "), slice(single, None)),
    ):
        yield pa.RecordBatch.from_arrays([names, pa.array(tf[rows]), pa.array(df[rows])], ["term", "tf", "df"])


def term_statistics(terms: DataFrame) -> DataFrame:
    """Per term its corpus frequency and the number of items it is in.

    `terms` has a row per item and term, or sums of them with `df`. One shuffle by term, combined before it, so a term in every
    item costs one row per task. Sums of batches are few for each term: they are shuffled as they are, as most terms are
    rare and combining them again would sort all for little.
    """
    if "df" in terms.columns:
        return terms.repartition("term").groupBy("term").agg(F.sum("tf").alias("cf"), F.sum("df").alias("df"))
    df = F.count(F.lit(1))
    return terms.groupBy("term").agg(F.sum("tf").alias("cf"), df.alias("df"))


def top_vocabulary(
    stats: DataFrame,
    k: int | None,
    n_items: Column | None = None,
    min_df: int = 1,
    max_df: float = 1.0,
) -> DataFrame:
    """the `k` most frequent terms of the corpus, ties by term.

    `max_df` is a share of `n_items`, the number of all items.
    """
    within = stats.filter(F.col("df") >= min_df)
    if max_df < 1.0:
        within = within.withColumn("_n", n_items).filter(F.col("df") <= F.col("_n") * max_df).drop("_n")
    return within if k is None else within.orderBy(F.desc("cf"), "term").limit(k)


def frequent_terms(
    terms: DataFrame, k: int | None, n_items: Column | None = None, min_df: int = 1, max_df: float = 1.0
) -> DataFrame:
    """F6 on unfolded terms (term, tf), without a shuffle of all distinct ones.

    A sample of rows names `CANDIDATES` * k terms, a list that is sent to every task. One pass counts these
    exactly and all others by hash bucket, of which there are `TERM_BUCKETS`. The k-th count among the former
    is a bound: a term that is to be among the first k must lie in a bucket whose sum reaches it, and only the terms of such
    buckets are counted on their own. The result is exact whatever the sample held.
    """
    if k is None:
        return top_vocabulary(term_statistics(terms), None, n_items, min_df, max_df)
    limits = (k, n_items, min_df, max_df)
    drawn = term_statistics(terms.sample(1 / SAMPLED, seed=1)).orderBy(F.desc("cf"), "term").limit(CANDIDATES * k)
    named = kept(drawn.select("term", F.lit(True).alias("_named")), "candidates")
    bucket = F.when(F.col("_named").isNull(), F.pmod(F.xxhash64("term"), F.lit(TERM_BUCKETS)))
    marked = terms.join(F.broadcast(named), "term", "left").withColumn("_bucket", bucket)
    sums = marked.groupBy(F.when(F.col("_named"), F.col("term")).alias("term"), "_bucket").agg(
        F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df")
    )
    sums = kept(sums, "term-sums")
    exact = sums.filter("_bucket IS NULL").drop("_bucket")
    found, bound = top_vocabulary(exact, *limits).agg(F.count(F.lit(1)), F.min("cf")).first()
    heavy = sums.filter(F.col("_bucket").isNotNull() & (F.col("cf") >= (bound if found == k else 0))).select("_bucket")
    if not heavy.isEmpty():
        # At most one number for each bucket.
        rest = marked.join(F.broadcast(heavy), "_bucket", "left_semi")
        exact = exact.unionByName(term_statistics(rest))
    return top_vocabulary(exact, *limits)


def weighed_terms(
    counted: DataFrame, item_id: str, *keep: str, k: int | None = 500, min_df: int = 1, max_df: float = 1.0
) -> DataFrame:
    """I9 on a table of counted terms, made without `k` or with the same limits."""
    n_items = counted.agg(F.count(F.lit(1))).scalar()
    terms = unfolded(counted)
    idf = F.log((F.lit(1.0) + F.col("_n")) / (F.lit(1.0) + F.col("df"))) + 1.0
    vocabulary = frequent_terms(terms, k, n_items, min_df, max_df)
    model = kept(vocabulary.withColumn("_n", n_items).select("term", idf.alias("idf")), "vocabulary")
    raw = unfolded(counted, "_row", item_id, *keep).join(model, "term").withColumn("_w", F.col("tf") * F.col("idf"))
    # Ids may repeat, so items are told apart by row; one row per distinct term of an item stands in its window.
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(W.partitionBy("_row")))
    return raw.select(item_id, *keep, "term", "tf", (F.col("_w") / norm).alias("weight"))


def tfidf(
    items: DataFrame,
    text: Column,
    item_id: str,
    *keep: str,
    k: int | None = 500,
    min_df: int = 1,
    max_df: float = 1.0,
    stop_words=ENGLISH,
) -> DataFrame:
    """Weight of every kept term of every item, items scaled to unit length.

    weight = tf * (ln((1 + n) / (1 + df)) + 1), n counting items without terms too.
    Terms meet the vocabulary by a join, which Spark broadcasts while it is short.
    """
    counted = counted_terms(items, text, item_id, *keep, stop_words=stop_words, k=k, min_df=min_df, max_df=max_df)
    return weighed_terms(counted, item_id, *keep, k=k, min_df=min_df, max_df=max_df)


def cluster_centroids(weights: DataFrame, sizes: DataFrame, topic: str = "topic") -> DataFrame:
    """Mean weight of every term over all items of a topic.

    `sizes` has topic and n, items without any kept term included.
    """
    sums = weights.groupBy(topic, "term").agg(F.sum("weight").alias("_s"))
    return sums.join(sizes, topic).select(topic, "term", (F.col("_s") / F.col("n")).alias("weight"))


def top_terms_per_topic(centroids: DataFrame, k: int = 5, topic: str = "topic") -> DataFrame:
    """The `k` heaviest terms of a topic with their rank, ties by later term first.

    Weights are compared at twelve digits, so that the order of summing is no tie-break.
    """
    w = W.partitionBy(topic).orderBy(F.desc(F.round("weight", 12)), F.desc("term"))
    return centroids.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def label_text(top_terms: DataFrame, capital: bool, shown: int = 3, topic: str = "topic") -> DataFrame:
    """The first terms of each topic as one text."""
    term = capitalise(F.col("term")) if capital else F.col("term")
    ranked = F.array_sort(F.collect_list(F.struct("rank", term.alias("term"))))
    return (
        top_terms.filter(F.col("rank") <= shown)
        .groupBy(topic)
        .agg(F.array_join(F.transform(ranked, lambda r: r["term"]), ", ").alias("topic_label"))
    )


def label_topics(
    items: DataFrame,
    title: str = "title",
    item_id: str = "item_id",
    topic: str = "topic",
    variant: str = "papers",
    stop_words=ENGLISH,
    names=(),
) -> DataFrame:
    """A label for every topic from the heaviest terms of its items.

    `papers`: cleaned text, 500 terms, no noise topic, capitalised. `news`: raw text,
    1000 terms within document frequency bounds, `names` of people filtered out,
    weightless terms not shown, `Topic n` when none is left.
    """
    if variant == "papers":
        items = items.filter(F.col(topic).isNotNull())
        text, k, bounds = normalise_title(F.col(title)), 500, {}
    elif variant == "news":
        text, k, bounds = F.col(title), 1000, {"min_df": 2, "max_df": 0.85}
        stop_words = (*stop_words, *names)
    else:
        raise ValueError(f"unknown variant {variant!r}")
    counted = counted_terms(items, text, item_id, topic, stop_words=stop_words, k=k, **bounds)
    weights = weighed_terms(counted, item_id, topic, k=k, **bounds)
    sizes = counted.groupBy(topic).agg(F.count(F.lit(1)).alias("n"))
    if variant == "papers":
        weights = weights.filter(F.col(topic) != -1)
        sizes = sizes.filter(F.col(topic) != -1)
    top = top_terms_per_topic(cluster_centroids(weights, sizes, topic), 5 if variant == "papers" else 3, topic)
    labels = label_text(top.filter(F.col("weight") > 0), variant == "papers", topic=topic)
    return (
        sizes.join(labels, topic, "left")
        .select(
            topic,
            F.coalesce("topic_label", F.concat(F.lit("Topic "), F.col(topic).cast("string"))).alias(
                "topic_label"
            ),
        )
    )
