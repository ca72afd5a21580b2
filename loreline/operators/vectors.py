"""Dense vectors: embedding, clustering, assignment, projection, store."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.feature import IDF, PCA, HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreline.functions.text import item_key
from loreline.operators.text import ngrams_1_2
from loreline.schemas import EMBEDDING
from loreline.session import kept
from loreline.sources.keyed_store import KeyedStore

# Numbers of all centroids up to which every task holds them as one matrix; beyond, numbers in a block of rows and of centroids.
BLOCK_FLOATS, ROW_FLOATS, MODEL_FLOATS = 10_000_000, 250_000, 1_000_000

# Rows that starting centres are drawn from.
SEED_ROWS = 4096


def l2_normalise(v: Column) -> Column:
    """I4: array scaled to unit length; a zero vector stays zero."""
    v = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.zip_with(
        v, F.array_repeat(norm, F.size(v)), lambda x, n: F.when(n > 0, x / n).otherwise(x)
    )


def whole_vector(v: Column) -> Column:
    """The vector, or null when one of its places is null or not finite."""
    known = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(known, v)


def embed(
    items: DataFrame,
    title: str = "title",
    model: Callable[[], Callable[[list[str]], np.ndarray]] | None = None,
    width: int = 384,
    rarity: bool = False,
) -> DataFrame:
    """I1 with the hook K2: adds `embedding`, an array of floats.

    `model` makes the encoder; it is called once per Python worker and encodes whole
    Arrow batches. Without one, words and word pairs are hashed into `width` places
    inside the JVM. `rarity` also weights them by how few items have them; then a
    vector depends on the other items, which does not suit the store.
    """
    if model is None:
        grams = items.withColumn("_grams", ngrams_1_2(F.col(title)))
        hashed = HashingTF(numFeatures=width, inputCol="_grams", outputCol="_v").transform(grams)
        if rarity:
            hashed = hashed.withColumnRenamed("_v", "_tf")
            hashed = IDF(inputCol="_tf", outputCol="_v").fit(hashed).transform(hashed)
        return hashed.withColumn("embedding", vector_to_array("_v", "float32")).drop(
            "_grams", "_tf", "_v"
        )

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = model()
        for titles in batches:
            vectors = np.asarray(encoder(titles.fillna("").tolist()), dtype="float32")
            yield pd.Series(list(vectors))

    return items.withColumn("embedding", encode(F.col(title)))


class Runs(NamedTuple):
    """Centres (run, centre, place) of k-means runs, and the cost of each run."""

    centers: np.ndarray
    costs: list[float]


def fit_runs(unit: DataFrame, k: int, seeds: list[int], iterations: int = 20, tolerance: float = 1e-4) -> Runs:
    """K-means on the arrays `unit`, one run for each seed, all of them advanced by the same pass over the rows.

    A pass adds up, for each run and centre, the rows nearest to it; what leaves a task is one sum for each, combined before
    the driver sees runs * k of them. Runs that stand still are left out of further passes. Starting centres are drawn by
    distance (k-means++) from the `SEED_ROWS` rows with the smallest hashes, so that a start is the same for
    the same rows and seed, alone or among others. A centre without rows stays where it is. Null arrays take no part.
    """
    unit = unit.filter("unit IS NOT NULL")
    drawn = unit.orderBy(F.xxhash64("unit"), "unit").limit(SEED_ROWS).toPandas()["unit"]
    if not len(drawn):
        return Runs(np.zeros((len(seeds), 0, 0)), [0.0] * len(seeds))
    sample = np.stack(drawn.to_numpy()).astype(float)
    centers = np.stack([_spread(sample, k, seed) for seed in seeds])
    costs = [0.0] * len(seeds)
    live = list(range(len(seeds)))
    for step in range(iterations + 1):
        # The last pass only tells the costs of the centres found.
        last = step == iterations or not live
        rows = _pass(unit, centers, list(range(len(seeds))) if last else live).collect()
        found = np.zeros_like(centers)
        n = np.zeros(centers.shape[:2])
        for r in rows:
            n[r["run"], r["center"]], found[r["run"], r["center"]] = r["n"], r["total"].toArray()
        if last:
            for r in rows:
                costs[r["run"]] += r["cost"]
            return Runs(centers, costs)
        new = np.where(n[:, :, None] > 0, found / np.maximum(n, 1)[:, :, None], centers)
        moved = np.sqrt(((new - centers) ** 2).sum(axis=2)).max(axis=1)
        centers[live] = new[live]
        live = [r for r in live if moved[r] > tolerance]
    raise AssertionError


def _spread(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """`k` rows drawn one after the other, each with a chance that grows with its squared distance from those before."""
    draw = np.random.default_rng(seed)
    chosen = [int(draw.integers(len(sample)))]
    far = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        total = far.sum()
        chosen.append(int(draw.choice(len(sample), p=far / total) if total > 0 else draw.integers(len(sample))))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _pass(unit: DataFrame, centers: np.ndarray, runs: list[int]) -> DataFrame:
    """(run, center, n, cost, total) of the rows nearest to each centre of some runs."""
    k, width = centers.shape[1:]
    model = centers[runs].reshape(-1, width)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        squares = (model * model).sum(axis=1)
        n, cost, total = np.zeros(len(model)), np.zeros(len(model)), np.zeros((len(model), width))
        for batch in batches:
            x = np.stack(batch["unit"].to_numpy()).astype(float)
            d = (x * x).sum(axis=1)[:, None] - 2.0 * (x @ model.T) + squares
            for r in range(len(runs)):
                own = d[:, r * k : (r + 1) * k]
                at = own.argmin(axis=1)
                best = np.maximum(own[np.arange(len(at)), at], 0.0)
                at = at + r * k
                n += np.bincount(at, minlength=len(model))
                cost += np.bincount(at, weights=best, minlength=len(model))
                order = np.argsort(at, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
                total[at[order][starts]] += np.add.reduceat(x[order], starts, axis=0)
        seen = np.flatnonzero(n)
        # A task may have no rows, as when a file has fewer row groups than splits; an empty column of lists has no type.
        if not len(seen):
            return
        yield pd.DataFrame({
            "run": np.array(runs, dtype=int)[seen // k], "center": seen % k, "n": n[seen], "cost": cost[seen], "total": list(total[seen]),
        })

    parts = unit.mapInPandas(sums, "run int, center int, n double, cost double, total array<double>")
    return parts.groupBy("run", "center").agg(
        F.sum("n").alias("n"), F.sum("cost").alias("cost"), Summarizer.sum(array_to_vector("total")).alias("total")
    )


def fit_topics(
    vectors: DataFrame,
    k: int = 20,
    seed: int = 42,
    restarts: int = 10,
    item_id: str = "item_id",
    embedding: str = "embedding",
) -> tuple[DataFrame, DataFrame]:
    """(item and topic, centroids) of the cheapest of several k-means runs.

    Vectors are scaled to unit length first and written once. Topics are numbered by falling size, so
    that equal clusterings get equal numbers. All runs share their passes over the vectors. Items whose vector is null or holds
    null or non-finite places take no part and have no topic.
    """
    unit = kept(vectors.select(item_id, l2_normalise(whole_vector(F.col(embedding))).alias("unit")), "unit-vectors")
    runs = fit_runs(unit.select("unit"), k, [seed + r for r in range(restarts)])
    best = runs.centers[int(np.argmin(runs.costs))]
    spark = vectors.sparkSession
    model = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(best)], "topic int, centroid array<double>")
    placed = kept(assign_topics(unit.filter("unit IS NOT NULL"), model, "unit").select(item_id, F.col("topic").alias("_c")), "placed")
    sizes = {r["_c"]: r["count"] for r in placed.groupBy("_c").count().collect()}
    ranked = sorted(sizes, key=lambda c: (-sizes[c], c))
    numbers = spark.createDataFrame([(c, n, [float(x) for x in best[c]]) for n, c in enumerate(ranked)], "_c int, topic int, centroid array<double>")
    topics = placed.join(F.broadcast(numbers.select("_c", "topic")), "_c").select(item_id, "topic")
    apart = unit.filter("unit IS NULL").select(item_id, F.lit(None).cast("int").alias("topic"))
    topics = topics.unionByName(apart)
    return topics, numbers.select("topic", "centroid")


def assign_topics(
    vectors: DataFrame, centroids: DataFrame, embedding: str = "embedding"
) -> DataFrame:
    """Adds `topic` and `distance2`, the nearest centroid; the lowest id on ties.

    Centroids (topic, centroid) of up to `BLOCK_FLOATS` numbers in all are one matrix that every task holds: one
    product per Arrow batch, and no join. More of them stay a table: vectors and centroids are packed into
    blocks, each pair of blocks is one product, skipped where lengths alone rule it out, and rows keep the nearest.
    Without centroids topic and distance are null.
    """
    numbers = centroids.agg(F.sum(F.size("centroid"))).first()[0] or 0
    if numbers > BLOCK_FLOATS:
        return _assign_in_blocks(vectors, centroids, embedding)
    rows = centroids.orderBy("topic").collect()
    none = F.lit(None).cast("struct<distance2:double,topic:int>")
    found = vectors.withColumn("_hit", _nearest(rows)(F.col(embedding)) if rows else none)
    return found.withColumn("topic", F.col("_hit.topic")).withColumn("distance2", F.col("_hit.distance2")).drop("_hit")


def _nearest(rows: list):
    """A function of a vector: the nearest of these centroids."""
    ids = np.array([r["topic"] for r in rows], dtype="int32")
    model = np.array([r["centroid"] for r in rows], dtype="float64")

    @F.pandas_udf("distance2 double, topic int")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        squares = (model * model).sum(axis=1)
        for batch in batches:
            if len(batch) == 0:
                yield pd.DataFrame({"distance2": [], "topic": []})
                continue
            x = np.stack(batch.to_numpy()).astype("float64")
            d = (x * x).sum(axis=1)[:, None] - 2.0 * (x @ model.T) + squares
            at = d.argmin(axis=1)
            best = np.maximum(d[np.arange(len(at)), at], 0.0)
            yield pd.DataFrame({"distance2": best, "topic": ids[at]})

    # Marked so, no filter on the result is moved into the scan of the vectors.
    return nearest.asNondeterministic()


def _packed(rows: DataFrame, numbers: int) -> DataFrame:
    """Rows (id, v) as blocks of at most about that many numbers, packed where they lie."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, held = [], []
        width = 1

        def block() -> pd.DataFrame:
            x = np.stack(held).astype("<f8")
            length = np.sqrt((x * x).sum(axis=1))
            return pd.DataFrame([{"ids": np.array(ids, "<i8").tobytes(), "vectors": x.tobytes(), "low": length.min(), "high": length.max()}])

        for batch in batches:
            for i, v in zip(batch["id"], batch["v"], strict=True):
                ids.append(i)
                held.append(v)
                width = len(v)
                if len(ids) * width >= numbers:
                    yield block()
                    ids, held = [], []
        if ids:
            yield block()

    return rows.mapInPandas(pack, "ids binary, vectors binary, low double, high double")


def _nearest_of_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last = None
    for batch in batches:
        for pair in batch.itertuples():
            if pair.ids != last:
                if last is not None:
                    yield pd.DataFrame({"_row": ids, "distance2": best, "topic": topic})
                last, ids = pair.ids, np.frombuffer(pair.ids, "<i8")
                x = np.frombuffer(pair.vectors, "<f8").reshape(len(ids), -1)
                squares = (x * x).sum(axis=1)
                best, topic = np.full(len(ids), np.inf), np.zeros(len(ids), "<i8")
            lengths = np.sqrt(squares)
            # Two vectors are no nearer than their lengths.
            apart = np.maximum(np.maximum(lengths - pair.c_high, pair.c_low - lengths), 0.0)
            open_ = np.flatnonzero(apart * apart <= best * (1 + 1e-9) + 1e-12)
            if not len(open_):
                continue
            topics = np.frombuffer(pair.c_ids, "<i8")
            model = np.frombuffer(pair.c_vectors, "<f8").reshape(len(topics), -1)
            d = squares[open_, None] - 2.0 * (x[open_] @ model.T) + (model * model).sum(axis=1)
            at = d.argmin(axis=1)
            found = np.maximum(d[np.arange(len(at)), at], 0.0)
            better = (found < best[open_]) | ((found == best[open_]) & (topics[at] < topic[open_]))
            best[open_[better]], topic[open_[better]] = found[better], topics[at[better]]
    if last is not None:
        yield pd.DataFrame({"_row": ids, "distance2": best, "topic": topic})


def _assign_in_blocks(vectors: DataFrame, centroids: DataFrame, embedding: str) -> DataFrame:
    rows = kept(vectors.withColumn("_row", F.monotonically_increasing_id()), "rows")
    blocks = kept(_packed(rows.select(F.col("_row").alias("id"), F.col(embedding).alias("v")), ROW_FLOATS), "row-blocks")
    # Blocks of centroids of like length, so that many are ruled out.
    squares = F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x * x)
    in_order = centroids.repartitionByRange(squares).sortWithinPartitions(squares, "topic").select(F.col("topic").cast("long").alias("id"), F.col("centroid").alias("v"))
    model = kept(_packed(in_order, MODEL_FLOATS), "centroid-blocks")
    pairs = blocks.crossJoin(model.select(*[F.col(c).alias(f"c_{c}") for c in model.columns]))
    found = pairs.mapInPandas(_nearest_of_pairs, "_row long, distance2 double, topic long")
    # A block may have met the centroids in several tasks.
    nearest = found.groupBy("_row").agg(F.min(F.struct("distance2", F.col("topic").cast("int").alias("topic"))).alias("_hit"))
    return rows.join(nearest, "_row", "left").withColumn("topic", F.col("_hit.topic")).withColumn("distance2", F.col("_hit.distance2")).drop("_row", "_hit")


def dense_centroids(vectors: DataFrame, topic: str = "topic", embedding: str = "embedding") -> DataFrame:
    """D14 for dense vectors: mean vector per topic, combined before the shuffle."""
    mean = Summarizer.mean(array_to_vector(F.col(embedding)))
    return vectors.groupBy(topic).agg(vector_to_array(mean).alias("centroid"))


def project_2d(
    vectors: DataFrame, item_id: str = "item_id", embedding: str = "embedding"
) -> DataFrame:
    """Two principal coordinates per item; the largest loading of each is positive."""
    features = vectors.select(item_id, array_to_vector(F.col(embedding)).alias("_v"))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(features)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, i]).argmax(), i] >= 0 else -1.0 for i in range(2)]
    points = model.transform(features).select(item_id, vector_to_array("_p").alias("_p"))
    return points.select(
        item_id,
        (F.col("_p")[0] * signs[0]).alias("embedding_x"),
        (F.col("_p")[1] * signs[1]).alias("embedding_y"),
    )


def map_points(
    points: DataFrame, topic: str = "topic", x: str = "embedding_x", y: str = "embedding_y"
) -> DataFrame:
    """Centroid of every topic on the map and the place of its label below it.

    The label stands 4% of the height of the whole map under the centroid. Sums
    per topic and the extent of the map come from one pass.
    """
    cells = points.groupBy(topic).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(x).alias("centroid_x"),
        F.avg(y).alias("centroid_y"),
        F.min(y).alias("_lo"),
        F.max(y).alias("_hi"),
    )
    every = W.partitionBy()
    height = F.max("_hi").over(every) - F.min("_lo").over(every)
    placed = cells.withColumn("label_y", F.col("centroid_y") - height * 0.04)
    return placed.filter(F.col(topic) != -1).drop("_lo", "_hi")


# ---- the embedding store ---------------------------------------------------------


def embedding_store(spark: SparkSession, path: str) -> KeyedStore:
    """Vectors by key, laid out by hash bucket of the key."""
    return KeyedStore(spark, path, EMBEDDING, "item_key")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """All stored vectors; an empty table when nothing was stored yet."""
    return embedding_store(spark, path).read().select("item_key", "embedding")


def append_store(vectors: DataFrame, path: str) -> None:
    """Vectors of new keys stored as one batch; keys that are there stay as they are."""
    embedding_store(vectors.sparkSession, path).add(vectors.select("item_key", "embedding").dropDuplicates(["item_key"]))


def new_items(items: DataFrame, store: DataFrame, title: str = "title") -> DataFrame:
    """Items whose key is not stored, one per key."""
    keyed = items.withColumn("item_key", item_key(F.col(title)))
    return keyed.join(store.select("item_key"), "item_key", "left_anti").dropDuplicates(["item_key"])


def union_cache(
    items: DataFrame, cached: DataFrame, fresh: DataFrame, title: str = "title"
) -> DataFrame:
    """Every item with its vector, from the stored and the new ones."""
    known = cached.select("item_key", "embedding").unionByName(fresh.select("item_key", "embedding"))
    return items.withColumn("item_key", item_key(F.col(title))).join(known, "item_key", "left")


def incremental_embed(
    items: DataFrame, path: str, title: str = "title", model=None, width: int = 384
) -> DataFrame:
    """Vectors of all items, computing only keys the store does not have.

    Which keys are new is found from the key column of the buckets that the items fall into;
    vectors of other buckets are never read. New vectors are written before they are used, so a second
    run finds them, and many small batches are put together. Items without a title have no vector.
    """
    store = embedding_store(items.sparkSession, path)
    keyed = items.withColumn("item_key", item_key(F.col(title)))
    firsts = keyed.select("item_key", F.col(title).alias("title")).where("item_key IS NOT NULL").dropDuplicates(["item_key"])
    buckets = store.touched(keyed)
    store.append(embed(store.unseen(firsts, buckets=buckets), "title", model, width))
    store.compact()
    known = store.read(buckets).select(F.col("bucket").alias("_bucket"), "item_key", "embedding")
    return keyed.withColumn("_bucket", store.bucket()).join(known, ["_bucket", "item_key"], "left").drop("_bucket")
