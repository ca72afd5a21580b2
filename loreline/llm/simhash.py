"""Near duplicates by SimHash fingerprints, compared exactly in tiles."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreline.llm.common import packed, stored, text_or_empty
from loreline.llm.components import components, forest

#: The largest radius for which tiles are named by the counts of both halves of 64 bits.
HALVES_RADIUS = 4
#: Fingerprints in one tile, a larger one is split by hash; and in a run of a tile, which is in order of so many quarters' counts.
TILE_ROWS, RUN_ROWS, QUARTERS = 8192, 128, 4
#: Shingles whose bits are added up at once.
BLOCK = 16384
#: Odd constants that turn one hash into further words of a long fingerprint.
STEP = 0x9E3779B97F4A7C15


def widened(values: np.ndarray, words: int) -> np.ndarray:
    """Each hash followed by `words` - 1 further ones mixed from it."""
    out = np.empty((len(values), words), dtype=np.uint64)
    out[:, 0] = values
    for k in range(1, words):
        z = values + np.uint64(k * STEP % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = z ^ (z >> np.uint64(31))
    return out


def fingerprint(text: str, shingle: int, bits: int = 64) -> bytes:
    """Bits set in over half of the hashes of a text's word shingles, repeats counted; high bits first.

    Words are lower-cased in A-Z only and split at ASCII white space; a text of fewer words is one
    shingle, a text of none has only zero bits. The first 64 bits are those of XXH64 with seed 42.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(bits // 8)
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(bits, dtype=np.int64)
    for at in range(0, n, BLOCK):
        pairs = zip(starts[at : at + BLOCK], stops[at : at + BLOCK], strict=True)
        values = widened(np.array([digest(line[a:b], 42) for a, b in pairs], dtype=np.uint64), bits // 64)
        spread = np.unpackbits(values.astype(">u8").view(np.uint8)).reshape(-1, bits)
        # Byte columns are added 255 at a time without leaving their type.
        for i in range(0, len(spread), 255):
            ones += np.add.reduce(spread[i : i + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > n).tobytes()


def tile_of(prints: np.ndarray, halves: bool) -> np.ndarray:
    """What a fingerprint's tile is named by: the population counts of its halves, or that of the whole."""
    if halves:
        counts = np.bitwise_count(prints.astype(">u8").view(">u4").reshape(-1, 2)).astype(np.int32)
        return counts @ (33 ** np.arange(2, dtype=np.int32))
    return np.bitwise_count(prints).sum(axis=1, dtype=np.int32)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 64, radius: int = 3) -> DataFrame:
    """(doc_id, fp, tile) of each row; null text counts as empty."""
    halves = bits == 64 and radius <= HALVES_RADIUS

    @F.pandas_udf("struct<fp binary, tile int>")
    def print_of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            found = [fingerprint(t, shingle, bits) for t in batch]
            yield pd.DataFrame({"fp": found, "tile": tile_of(unpacked(b"".join(found), bits), halves)})

    row = packed(docs)
    read = row.select(F.col(f"row.`{id_col}`").alias("doc_id"), print_of(text_or_empty(F.col(f"row.`{text_col}`"))).alias("print"))
    return read.select("doc_id", "print.fp", "print.tile")


def unpacked(data: bytes, bits: int) -> np.ndarray:
    return np.frombuffer(data, dtype=">u8").astype(np.uint64).reshape(-1, bits // 64)


class Sorted:
    """A tile's fingerprints in runs of like population counts of their words' quarters, with the range of each count by run."""

    def __init__(self, data: bytes, bits: int):
        values = unpacked(data, bits)
        counts = np.bitwise_count(values.astype(">u8").view(">u2")).astype(np.int16).reshape(len(values), -1)
        order = np.lexsort(counts.T[:QUARTERS])
        self.values, counts = values[order], counts[order]
        self.starts = np.arange(0, len(values), RUN_ROWS)
        self.low, self.high = np.minimum.reduceat(counts, self.starts), np.maximum.reduceat(counts, self.starts)

    def runs(self, chosen: np.ndarray) -> np.ndarray:
        places = (self.starts[chosen][:, None] + np.arange(RUN_ROWS)).ravel()
        return places[places < len(self.values)]


def near_pairs(a: Sorted, b: Sorted, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs within the radius, a run of `a` at a time against the runs of `b` that can hold one."""
    words = a.values.shape[1]
    for i, start in enumerate(a.starts):
        gap = np.maximum(np.maximum(a.low[i] - b.high, b.low - a.high[i]), 0).sum(axis=1)
        places = b.runs(np.flatnonzero(gap <= radius))
        one, other = a.values[start : start + RUN_ROWS], b.values[places]
        apart = np.bitwise_count(one[:, :1] ^ other[:, 0])
        for k in range(1, min(2, words)):
            apart = apart + np.bitwise_count(one[:, k : k + 1] ^ other[:, k])
        x, y = np.nonzero(apart <= radius)
        if words > 2 and len(x):
            # The words compared so far can't differ in more bits than all.
            rest = np.bitwise_count(one[x, 2:] ^ other[y, 2:]).sum(axis=1, dtype=np.int64) + apart[x, y]
            x, y = x[rest <= radius], y[rest <= radius]
        if len(x):
            yield start + x, places[y]


def links_between(a: bytes, b: bytes, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as pairs of values, of the links within the radius between two tiles, or inside one."""
    x = Sorted(a, bits)
    same = a == b
    y = x if same else Sorted(b, bits)
    root = None
    for u, v in near_pairs(x, y, radius):
        if same:
            u, v = u[u < v], v[u < v]
        else:
            v = v + len(x.values)
        if not len(u):
            continue
        if root is None:
            root = np.arange(len(x.values) + (0 if same else len(y.values)))
        u, v = root[u], root[v]
        if (u != v).any():
            root = forest(u, v, len(root))[root]
    if root is None:
        return x.values[:0], x.values[:0]
    values = x.values if same else np.concatenate([x.values, y.values])
    off = np.flatnonzero(root != np.arange(len(root)))
    return values[off], values[root[off]]


def _compare(bits: int, radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [links_between(one, other, bits, radius) for one, other in zip(batch["one"], batch["other"], strict=True)]
            columns = [np.concatenate(side).astype(">u8") for side in zip(*found, strict=True)] if found else []
            if columns and len(columns[0]):
                yield pd.DataFrame({name: [row.tobytes() for row in side] for name, side in zip("ab", columns, strict=True)})

    return run


def tiles_met(radius: int, halves: bool) -> F.Column:
    """The tiles whose counts a fingerprint within the radius of one in `tile` can have, each pair of tiles once."""
    if not halves:
        return F.sequence(F.col("tile"), F.col("tile") + radius)
    steps = [s for s in product(range(-radius, radius + 1), repeat=2) if sum(map(abs, s)) <= radius and s >= (0, 0)]
    low, high = F.col("tile") % 33, F.floor(F.col("tile") / 33).cast("int")
    moved = F.array(*[F.struct(F.lit(x).alias("low"), F.lit(y).alias("high")) for x, y in steps])
    inside = F.filter(moved, lambda s: (low + s["low"]).between(0, 32) & (high + s["high"]).between(0, 32))
    return F.transform(inside, lambda s: F.col("tile") + s["low"] + s["high"] * 33)


def links(prints: DataFrame, bits: int = 64, radius: int = 3) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints (fp, tile) within `radius` bits of each other.

    Every pair of fingerprints in tiles that can hold such a pair is compared, by exclusive-or and bit
    count. A tile holds fingerprints of one population count; flipping r bits moves that count by r at
    most, so other pairs of tiles are skipped. For a small radius tiles are named by the counts of both halves,
    and inside a pair of tiles runs of fingerprints are skipped by the counts of their quarters, which leaves
    one pair in twenty of random bits. Large tiles are split by hash, and each
    pair of tiles meets once. Links inside a pair of tiles are reduced to a spanning forest, so near
    copies in thousands don't become pairs.

    The work grows with the square of the number of distinct fingerprints times the share not skipped.
    """
    halves = bits == 64 and radius <= HALVES_RADIUS
    # At most 33 ** 2 = 1,089 tile names, or one for each population count, whatever the data: a bounded broadcast.
    parts = stored(prints.groupBy("tile").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("parts")), "tile-parts")
    split = prints.join(F.broadcast(parts), "tile").select("tile", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"), "fp")
    # About TILE_ROWS fingerprints are laid end to end.
    laid = F.unhex(F.concat_ws("", F.collect_list(F.hex("fp")))).alias("prints")
    tiles = stored(split.groupBy("tile", "part").agg(laid), "tiles")
    asks = (
        tiles.select(F.col("tile").alias("from_tile"), F.col("part").alias("from_part"), F.explode(tiles_met(radius, halves)).alias("tile"))
        .join(F.broadcast(parts), "tile")
        .select("from_tile", "from_part", "tile", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        .where("tile <> from_tile OR part >= from_part")
    )
    one = tiles.toDF("from_tile", "from_part", "one")
    pairs = asks.join(one, ["from_tile", "from_part"]).join(tiles.withColumnRenamed("prints", "other"), ["tile", "part"])
    return pairs.select("one", "other").mapInPandas(_compare(bits, radius), "a binary, b binary")


def simhash_groups(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 64, radius: int = 3,
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row.

    Documents whose fingerprints of `bits` (a multiple of 64) differ in at most `radius` bits are linked;
    component_id is the smallest id reachable. Equal fingerprints are one node, so copies cost nothing
    beyond their row. Texts without words have fingerprint zero and link like any other; null text counts
    as empty. Null ids are never the smallest; a component without any id has a null component_id.
    Repeated rows keep their number. Empty tables give no rows.
    """
    prints = stored(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, bits=bits, radius=radius), "simhash-prints")
    nodes = stored(prints.groupBy("fp").agg(F.first("tile").alias("tile"), F.min("doc_id").alias("first")), "simhash-nodes")
    roots = components(links(nodes.select("fp", "tile"), bits, radius))
    rooted = stored(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
    smallest = stored(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-smallest")
    named = stored(rooted.join(smallest, "root").select("fp", "component_id"), "simhash-named")
    return prints.join(named, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def without_near_copies(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 64, radius: int = 3
) -> DataFrame:
    """One row of each group of `simhash_groups` stays: the one with the smallest id.

    Rows are numbered first, so that of rows that repeat an id one stays where they are near, and each where they
    are not; null ids are larger than any other. Texts without words are near each other.
    """
    rows = stored(packed(docs).select(F.monotonically_increasing_id().alias("at"), "row"), "near-rows")
    own = F.col(f"row.`{id_col}`")
    keyed = rows.select(F.struct(own.isNull().alias("none"), own.alias("id"), "at").alias("key"), F.col(f"row.`{text_col}`").alias("text"))
    groups = simhash_groups(keyed, id_col="key", shingle=shingle, bits=bits, radius=radius)
    gone = stored(groups.where("doc_id <> component_id").select("doc_id.at"), "near-gone")
    return rows.join(gone, "at", "left_anti").select("row.*")
