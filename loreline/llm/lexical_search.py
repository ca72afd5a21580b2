"""Ranked lexical search by hashed max-sketches: upper bounds first, exact scores in descending order of them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreline.llm.common import packed, stored, text_or_empty
from loreline.llm.toplists import PACKED, TopLists, merged

#: Documents and entries (distinct terms of each) after which a block ends; a longer document is a block of its own.
BLOCK_DOCS, BLOCK_ENTRIES = 1024, 1_000_000
#: Coordinates of a sketch, and the highest value of one.
WIDTH, LEVELS = 4096, 65535
#: Terms in at least one of so many documents of a block are counted for the weights of sketches, and so many terms are kept.
COMMON, COMMON_TERMS = 256, 100_000
#: Items in a group that is looked up together.
TILE_ITEMS = 512
#: Documents that are scored exactly before bounds are looked at again.
STEP = 32
#: The largest impact of a term of weight 1, as a term that fills its document comes near it.
FULL = 1_000_000
#: Terms whose hashes a worker remembers.
REMEMBERED = 1_000_000

#: Bytes that stand in a term, with A-Z lowered; all other ASCII is a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

INDEX = "block long, docs long, with_terms long, terms long, id binary, known binary, size binary, ends binary, hash binary, tf binary"
TILES = "tile long, owner binary, ends binary, hash binary, df binary"


def terms_of(text: str) -> list[bytes]:
    """Runs of ASCII letters and digits and of characters beyond ASCII; only A-Z are lowered."""
    return text.encode("utf-8", "surrogatepass").translate(TERM_BYTES).split(b" ")


class Hashes(dict):
    """64-bit hashes of terms."""

    def __missing__(self, term: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[term] = xxhash.xxh64_intdigest(term)
        return value


def counted(text: str, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct terms as ascending hashes, and how often each stands."""
    counts = Counter(terms_of(text))
    counts.pop(b"", None)
    h = np.fromiter((hashes[t] for t in counts), np.uint64, len(counts))
    tf = np.fromiter(counts.values(), np.int64, len(counts))
    order = np.argsort(h)
    return h[order], tf[order]


def _index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes, held, entries, number = Hashes(), [], 0, TaskContext.get().partitionId() << 33

    def block() -> pd.DataFrame:
        ids, known, found = zip(*held, strict=True)
        sizes = np.array([tf.sum() for _, tf in found], "<i8")
        return pd.DataFrame([{
            "block": number, "docs": len(ids), "with_terms": int((sizes > 0).sum()), "terms": int(sizes.sum()),
            "id": np.array(ids, "<i8").tobytes(), "known": np.array(known, "u1").tobytes(), "size": sizes.tobytes(),
            "ends": np.cumsum([len(h) for h, _ in found]).astype("<i8").tobytes(),
            "hash": np.concatenate([h for h, _ in found]).astype("<u8").tobytes(), "tf": np.concatenate([tf for _, tf in found]).astype("<u4").tobytes(),
        }])

    for batch in batches:
        for i, known, text in zip(batch["id"], batch["known"], batch["text"], strict=True):
            held.append((i, known, counted(text, hashes)))
            entries += len(held[-1][2][0])
            if len(held) >= BLOCK_DOCS or entries >= BLOCK_ENTRIES:
                yield block()
                held, entries, number = [], 0, number + 1
    if held:
        yield block()


def lexical_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of documents with the hashes and counts of their distinct terms, made where the documents lie."""
    number = F.col(f"row.`{id_col}`").try_cast("bigint")
    read = packed(docs).select(F.coalesce(number, F.lit(0)).alias("id"), number.isNotNull().alias("known"), text_or_empty(F.col(f"row.`{text_col}`")).alias("text"))
    return stored(read.mapInPandas(_index, INDEX), "lexical-index")


def _tile(rows: pd.DataFrame) -> pd.DataFrame:
    hashes, rows = Hashes(), rows.sort_values("at")
    found = [counted(t, hashes) for t in rows["text"]]
    # A term that stands twice in an item counts twice.
    lines = [np.repeat(h, tf) for h, tf in found]
    return pd.DataFrame([{
        "tile": rows["tile"].iloc[0], "owner": rows["at"].to_numpy("<i8").tobytes(), "ends": np.cumsum([len(x) for x in lines]).astype("<i8").tobytes(),
        "hash": np.concatenate(lines).astype("<u8").tobytes(), "df": b"",
    }])


def _frequencies(first: int):
    """For each pair of block and tile the documents that hold each term of the tile; with the first tile also those of common terms, as tile -1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pair in batch.itertuples():
                terms, df = np.unique(np.frombuffer(pair.hash, "<u8"), return_counts=True)
                hit = np.isin(terms, np.frombuffer(pair.q_hash, "<u8"))
                yield pd.DataFrame({"tile": pair.tile, "hash": terms[hit].view(np.int64), "df": df[hit]})
                if pair.tile == first:
                    hit = df * COMMON >= pair.docs
                    yield pd.DataFrame({"tile": -1, "hash": terms[hit].view(np.int64), "df": df[hit]})

    return run


def _with_frequencies(tiles: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """The tiles with the document frequency of each of their terms, 0 where no document holds it."""
    found = pd.Series(counts["df"].to_numpy(), index=counts["hash"].to_numpy())
    df = [found.reindex(np.frombuffer(h, "<i8"), fill_value=0).to_numpy("<i8").tobytes() for h in tiles["hash"]]
    return tiles.assign(df=df)


def weight(n: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Sketched:
    """A block's documents with their sketches: for each coordinate the largest impact of a term hashed to it.

    Terms weigh what their document frequency, or the lower bound of it that is known, gives at most. Impacts
    are rounded up to levels, so that no sum of levels is below the score it bounds.
    """

    def __init__(self, block, n: int, total: int, common: tuple[np.ndarray, np.ndarray]):
        self.ids, self.known = np.frombuffer(block.id, "<i8"), np.frombuffer(block.known, "u1")
        self.hash, self.tf = np.frombuffer(block.hash, "<u8"), np.frombuffer(block.tf, "<u4").astype(np.int64)
        self.ends = np.frombuffer(block.ends, "<i8")
        self.starts = np.r_[0, self.ends[:-1]]
        self.m = 75 + (25 * np.frombuffer(block.size, "<i8") * n) // max(1, total)
        self.doc = np.repeat(np.arange(len(self.ids)), self.ends - self.starts)
        self.part = impact(self.tf, self.m[self.doc])
        self.unit = -(-max(1, int(weight(n, np.array([1]))[0])) * FULL // LEVELS)
        level = -(-common_weight(self.hash, n, common) * self.part // self.unit)
        cells = np.zeros(WIDTH * len(self.ids), dtype=np.uint16)
        np.maximum.at(cells, coordinate(self.hash) * len(self.ids) + self.doc, level.astype(np.uint16))
        self.sketch = cells.reshape(WIDTH, -1)

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each document no less than the score of these terms."""
        cap = (-(-weights * FULL // self.unit)).astype(np.uint16)
        return np.minimum(self.sketch[coordinate(terms)], cap[:, None]).sum(axis=0, dtype=np.int64) * self.unit

    def exact(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Scores of some documents; `terms` ascend and are distinct, `weights` hold their repeats."""
        count = self.ends[docs] - self.starts[docs]
        place = np.repeat(self.starts[docs] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        h = self.hash[place]
        at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
        hit = np.flatnonzero(terms[at] == h)
        out = np.zeros(len(docs), dtype=np.int64)
        np.add.at(out, np.repeat(np.arange(len(docs)), count)[hit], weights[at[hit]] * self.part[place[hit]])
        return out


def coordinate(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(20)).astype(np.int64) % WIDTH


def common_weight(hashes: np.ndarray, n: int, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The largest weight each term can have: that of its counted frequency, or of one document."""
    terms, weights = common
    rare = max(0, int(weight(n, np.array([1]))[0]))
    if not len(terms):
        return np.full(len(hashes), rare)
    at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    return np.where(terms[at] == hashes, weights[at], rare)


def search_block(block: Sketched, terms: np.ndarray, weights: np.ndarray, single: np.ndarray, k: int, bar: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents (places) and scores that can be among the `k` best, and how many were scored.

    Documents are scored exactly from the highest bound downwards, until the next bound is below both the
    k-th best score and `bar`, the k-th best found elsewhere. A bound equal to it goes on: ties count.
    `single` holds the weights of one occurrence, which cap a coordinate, `weights` those of all.
    """
    bounds = np.zeros(len(block.ids), dtype=np.int64)
    times = weights // np.maximum(single, 1)
    for r in np.unique(times):
        some = times >= r
        # Repeated terms add their bound again; each pass stands for as many repeats as no smaller number covers.
        below = times[times < r].max(initial=0)
        bounds += (r - below) * block.bounds(terms[some], single[some])
    order = np.flatnonzero((bounds > 0) & (bounds >= bar))
    order = order[np.argsort(-bounds[order], kind="stable")]
    scores = np.zeros(len(order), dtype=np.int64)
    done, step = 0, max(STEP, k)
    while done < len(order) and bounds[order[done]] >= bar:
        stop = min(len(order), done + step)
        scores[done:stop] = block.exact(order[done:stop], terms, weights)
        done, step = stop, 2 * step
        if done >= k:
            bar = max(bar, int(np.partition(scores[:done], done - k)[done - k]))
    found = np.flatnonzero((scores[:done] > 0) & (scores[:done] >= bar))
    return order[found], scores[found], done


def _search(k: int, n: int, total: int, common: tuple[np.ndarray, np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, TopLists] = {}
        bars: dict[int, dict[int, int]] = {}
        last, block = None, None
        for batch in batches:
            for pair in batch.itertuples():
                if pair.block != last:
                    last, block = pair.block, Sketched(pair, n, total, common)
                owner, ends = np.frombuffer(pair.q_owner, "<i8"), np.frombuffer(pair.q_ends, "<i8")
                hashes, df = np.frombuffer(pair.q_hash, "<u8"), np.frombuffer(pair.q_df, "<i8")
                lists, bar = best.setdefault(pair.tile, TopLists(k)), bars.setdefault(pair.tile, {})
                new = []
                for i, item in enumerate(owner):
                    begin = ends[i - 1] if i else 0
                    terms, first, times = np.unique(hashes[begin : ends[i]], return_index=True, return_counts=True)
                    freq = df[begin : ends[i]][first]
                    there = freq > 0
                    single = weight(n, freq[there])
                    some = single > 0
                    terms, single, times = terms[there][some], single[some], times[there][some]
                    if not len(terms):
                        continue
                    place, score, _ = search_block(block, terms, single * times, single, k, bar.get(item, 0))
                    new.append((np.full(len(place), item), score, block.ids[place], block.known[place]))
                if new:
                    lists.add(**dict(zip(("owner", "score", "id", "known"), map(np.concatenate, zip(*new, strict=True)), strict=True)))
                    items, count = np.unique(lists.lists["owner"], return_counts=True)
                    full = items[count == k]
                    if len(full):
                        own = np.isin(lists.lists["owner"], full)
                        lowest = lists.lists["score"][own].reshape(len(full), k).min(axis=1)
                        bar.update(zip(full.tolist(), lowest.tolist(), strict=True))
        part = TaskContext.get().partitionId()
        for tile, lists in best.items():
            yield pd.DataFrame([lists.packed(tile, part)])

    return run


def ranked_search(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = 20
) -> DataFrame:
    """(item_id, rank, doc_id, score) of the `k` documents that score highest for each item, all above 0.

    Documents are indexed once, in blocks of their terms' hashes and counts. A block's documents are folded
    into sketches of `WIDTH` coordinates that hold the largest impact of the terms hashed to each. The
    items of a group are looked up together: the sum of an item's coordinates is an upper bound of a document's
    score. Documents are scored exactly from the highest bound down, until the next bound is below the k-th
    best score that the task has found; the lists of tasks are merged as a tree. Results are exact.

    A sketch needs no less than a term's weight: the documents that hold a term are counted for the terms of items, and
    for terms common in a block as a lower bound, the `COMMON_TERMS` largest of which are sent to the
    tasks (1.6 MB); all others count as standing once. Fewer counts make bounds wider, never wrong.
    Terms are told apart by 64 bits of hash; for 10,000 terms of items and 10^9 terms of documents
    that joins two terms with a chance below one in a million.

    Null and empty texts have no terms and are neither found nor find. Equal scores go by ascending id, documents without id last.
    Rows that repeat an id or a text count each; items that repeat an id have a list each. Documents of any
    length are scored whole. Empty tables give no rows.
    """
    index = lexical_index(docs, id_col=id_col, text_col=text_col)
    n, total = index.agg(F.coalesce(F.sum("with_terms"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    row = packed(items)
    asked = row.select(F.monotonically_increasing_id().alias("at"), F.col(f"row.`{item_col}`").alias("item_id"), text_or_empty(F.col(f"row.`{item_text}`")).alias("text"))
    asked = stored(asked, "lexical-items")
    groups = F.pmod(F.xxhash64("at"), F.lit(-(-asked.count() // TILE_ITEMS) or 1)).cast("long")
    tiles = stored(asked.withColumn("tile", groups).groupBy("tile").applyInPandas(_tile, TILES), "lexical-tiles")
    first = tiles.agg(F.min("tile")).first()[0]
    # Items against all documents, in blocks; neither side is shuffled.
    pairs = index.select("block", "docs", "hash").crossJoin(tiles.select("tile", F.col("hash").alias("q_hash")))
    counts = pairs.mapInPandas(_frequencies(first), "tile long, hash long, df long").groupBy("tile", "hash").agg(F.sum("df").alias("df"))
    counts = stored(counts, "lexical-frequencies")
    top = counts.where("tile = -1").orderBy(F.desc("df"), "hash").limit(COMMON_TERMS).toPandas().sort_values("hash", key=lambda h: h.astype("uint64"))
    common = top["hash"].to_numpy("int64").view(np.uint64), weight(n, top["df"].to_numpy("int64"))
    tiles = stored(tiles.groupBy("tile").cogroup(counts.where("tile >= 0").groupBy("tile")).applyInPandas(_with_frequencies, TILES), "lexical-asked")
    pairs = index.crossJoin(tiles.select("tile", *[F.col(c).alias(f"q_{c}") for c in ("owner", "ends", "hash", "df")]))
    lists = stored(pairs.mapInPandas(_search(k, n, total, common), PACKED), "lexical-lists")
    names = asked.select(F.col("at").alias("owner"), "item_id")
    return merged(lists, k, "lexical-merged").join(names, "owner").select("item_id", "rank", F.col("id").alias("doc_id"), "score")
