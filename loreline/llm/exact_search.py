"""Exact top lists by inner product: tiles of queries times shards of candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreline.llm.common import stored
from loreline.llm.toplists import PACKED, TopLists, merged

#: Vectors in a shard of candidates and in a tile of queries, and bytes that either holds at most.
SHARD_ROWS, TILE_ROWS, BLOCK_BYTES = 4096, 1024, 32_000_000
#: Scores that are looked at once.
CELLS = 1 << 21
#: Whole numbers below these are exact in single and in double precision, whatever the order of a sum.
SINGLE, DOUBLE = 2.0**24, 2.0**53
#: Numbers that a block's vectors are kept as: the narrowest that holds them all.
KINDS = ["<i1", "<i2", "<i4", "<f8"]
LEAST, MOST = -(2**63), 2**63 - 1

BLOCK = "block long, width int, at binary, id binary, known binary, kind string, vectors binary"


def _pack(scale: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["known", "id", "at"], ascending=[False, True, True])
        v = np.floor(scale * np.stack(rows["v"].to_numpy()).reshape(len(rows), -1))
        top = np.abs(v).max(initial=0)
        kind = next((k for k in KINDS[:3] if top <= np.iinfo(k).max), KINDS[3])
        return pd.DataFrame({
            "block": [rows["block"].iloc[0]], "width": [rows["width"].iloc[0]], "at": [rows["at"].to_numpy("<i8").tobytes()],
            "id": [rows["id"].to_numpy("<i8").tobytes()], "known": [rows["known"].to_numpy("u1").tobytes()],
            "kind": [kind], "vectors": [v.astype(kind).tobytes()],
        })

    return run


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers as 64-bit integers; those outside them count as the nearest one.

    The product of two lengths bounds every partial sum, so it tells which precision is exact. The few
    products that not even doubles hold are made with integers of any size.
    """
    long_a, long_b = (np.sqrt(np.einsum("nd,nd->n", x, x)) for x in (a, b))
    top = long_a.max(initial=0) * long_b.max(initial=0)
    if top < SINGLE:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if top < DOUBLE:
        return (a @ b.T).astype(np.int64)
    with np.errstate(all="ignore"):
        wide = ~(long_a[:, None] * long_b < DOUBLE)
        out = np.where(wide, 0, a @ b.T).astype(np.int64)
    whole_a, whole_b = ({i: [int(x) for x in m[i]] for i in np.flatnonzero(wide.any(axis=axis))} for m, axis in ((a, 1), (b, 0)))
    for i, j in zip(*np.nonzero(wide), strict=True):
        out[i, j] = min(MOST, max(LEAST, sum(x * y for x, y in zip(whole_a[i], whole_b[j], strict=True))))
    return out


def selected(scores: np.ndarray, taken: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's `k` highest scores that are not `taken`, earlier columns first among equal ones."""
    open_ = np.where(taken, LEAST, scores)
    k = min(k, scores.shape[1])
    bar = np.partition(open_, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    row, col = np.nonzero((open_ >= bar[:, None]) & ~taken)
    order = np.lexsort((col, ~scores[row, col], row))
    row, col = row[order], col[order]
    starts = np.searchsorted(row, np.arange(len(scores)))
    first = np.arange(len(row)) - starts[row] < k
    return row[first], col[first]


def _search(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, TopLists] = {}
        for batch in batches:
            for pair in batch.itertuples():
                if pair.width != pair.q_width:
                    continue
                asked, at = np.frombuffer(pair.q_at, "<i8"), np.frombuffer(pair.at, "<i8")
                q = np.frombuffer(pair.q_vectors, pair.q_kind).astype(float).reshape(len(asked), pair.width)
                x = np.frombuffer(pair.vectors, pair.kind).astype(float).reshape(len(at), pair.width)
                ids, known = np.frombuffer(pair.id, "<i8"), np.frombuffer(pair.known, "u1")
                rows = max(1, CELLS // len(at))
                for i in range(0, len(asked), rows):
                    scores = products(q[i : i + rows], x)
                    row, col = selected(scores, asked[i : i + rows, None] == at, k)
                    lists = best.setdefault(pair.q_block, TopLists(k))
                    lists.add(owner=asked[i + row], score=scores[row, col], id=ids[col], known=known[col])
        part = TaskContext.get().partitionId()
        for tile, lists in best.items():
            yield pd.DataFrame([lists.packed(tile, part)])

    return run


def blocks(rows: DataFrame, n: int, scale: float) -> DataFrame:
    """The rows (at, id, known, v) dealt by hash to `n` blocks, one row for each and width of its vectors."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("at"), F.lit(n)).cast("long")).withColumn("width", F.size("v"))
    return dealt.groupBy("width", "block").applyInPandas(_pack(scale), BLOCK)


def top_products(
    table: DataFrame, asks: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: float = 64.0
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the `k` other rows with the highest inner product, for each row that `asks`.

    Components count as floor(scale * x). Rows are dealt by hash to shards of candidates and tiles of
    queries, bounded in rows and bytes. Each tile meets each shard as one matrix product, from which the
    best of each query are selected; a task keeps the best of all its pairs, and the lists of the tasks are
    merged as a tree. Both sides are stored blocks, which tasks read from the shared folder: nothing is
    shuffled but the rows, once, and the lists. The work is queries times rows, which exactness by this
    method takes; blocks of equal size on both sides read least for it.

    Ties go to the smaller id; candidates without id come last among equals and have a null vec_id. Rows that
    repeat an id, or a vector, count each, and only the query's own row is left out. Vectors that are null
    or hold null or non-finite components (also after scaling) take no part. Vectors meet those of equal length only; the products
    of empty ones are 0. Scores outside 64 bits count as the nearest one within. A query with fewer
    partners has fewer rows. Empty tables give no rows.
    """
    number = F.col(f"`{id_col}`").try_cast("bigint")
    rows = table.select(
        F.monotonically_increasing_id().alias("at"), F.coalesce(number, F.lit(0)).alias("id"), number.isNotNull().alias("known"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("v"), F.coalesce(asks, F.lit(False)).alias("asks"),
    )
    fits = F.forall("v", lambda x: x.isNotNull() & (F.abs(x * scale) < float("inf")))
    rows = stored(rows.where(F.coalesce(fits, F.lit(False))), "search-rows")
    n, asked, components = rows.agg(F.count("*"), F.count_if("asks"), F.sum(F.size("v"))).first()
    held = max(1, int(BLOCK_BYTES / max(1.0, 8 * (components or 0) / max(1, n))))
    shards = stored(blocks(rows, -(-n // min(SHARD_ROWS, held)) or 1, scale), "search-shards")
    tiles = stored(blocks(rows.where("asks"), -(-asked // min(TILE_ROWS, held)) or 1, scale), "search-tiles")
    # A query set against all rows, in blocks; lengths are compared in the task, as a join by them would deal all rows to one.
    pairs = shards.crossJoin(tiles.select(*[F.col(c).alias(f"q_{c}") for c in tiles.columns]))
    found = merged(stored(pairs.mapInPandas(_search(k), PACKED), "search-lists"), k, "search-merged")
    names = rows.where("asks").select(F.col("at").alias("owner"), F.when(F.col("known"), F.col("id")).alias("query_id"))
    return found.join(names, "owner").select("query_id", "rank", F.col("id").alias("vec_id"), "score")
