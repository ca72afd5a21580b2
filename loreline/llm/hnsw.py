"""Near-equal vectors by a navigable small-world graph for each shard."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from loreline.llm.common import packed, stored
from loreline.llm.components import components, forest

#: Links of a node above the ground level; twice as many on it.
LINKS = 12
#: Beam while a graph is built, and the first one while it is searched; beams widen fourfold.
BUILD_BEAM, FIRST_BEAM, WIDEN = 40, 48, 4
#: Beyond this beam a query is compared with the whole shard instead.
WIDEST_BEAM = 1024
#: Nodes put into a graph at once, and cells (queries times nodes) that mark what a search has seen.
BATCH, SEEN_CELLS = 512, 16_000_000
#: Numbers of vectors copied out of a graph at once.
GATHERED = 4_000_000
#: Nodes opened for a query in one step.
OPENED = 4
#: Queries compared with the whole shard to audit a task's recall, and the recall it must reach.
AUDITED, RECALL = 256, 0.98
#: Shards there are at least, and vectors and bytes of vectors that a shard holds; a shard must fit in one task.
LEAST_SHARDS, SHARD_ROWS, SHARD_BYTES = 4, 200_000, 64_000_000
#: Queries, and bytes of them, that are put to a shard at once, and pairs verified at once.
SLICE_ROWS, SLICE_BYTES, VERIFIED = 8192, 8_000_000, 1 << 16
#: Bytes of a shard that are in one row, and rows of them that a task passes on at once.
PIECE_BYTES, PIECES = 1 << 18, 16
#: Allowance for single precision before cosines are verified in double precision.
SLACK = 1e-4


def spans(n: int, step: int) -> Iterator[slice]:
    return (slice(i, i + step) for i in range(0, n, step))


class Graph:
    """Unit vectors (rows of `x`), and for each level the places of each node's neighbours, -1 where none.

    The tables of the levels above the ground have rows only for the nodes that are above it, `row` tells which.
    """

    def __init__(self, x: np.ndarray, level: np.ndarray, near: list[np.ndarray], entry: int):
        self.x, self.level, self.near, self.entry = x, level, near, entry
        self.row = np.cumsum(level > 0, dtype=np.int32) - 1

    @classmethod
    def build(cls, x: np.ndarray) -> Graph:
        """Insert the rows in their order, many at a time; the order must not follow the data."""
        n = len(x)
        draw = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(float) / 2.0**53
        level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(LINKS)).astype(np.int8), 6)
        above = int((level > 0).sum())
        near = [np.full((above, LINKS) if k else (n, 2 * LINKS), -1, dtype=np.int32) for k in range(int(level.max()) + 1)]
        graph, done = cls(x, level, near, 0), 1
        while done < n:
            stop = min(n, done + min(BATCH, done))
            graph.insert(np.arange(done, stop))
            done = stop
        return graph

    def rows(self, k: int, nodes: np.ndarray) -> np.ndarray:
        """Where nodes stand in the table of a level."""
        return self.row[nodes] if k else nodes

    def products(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Of each query with its nodes, some queries at a time; -2 where there is no node."""
        out = np.empty(ids.shape, dtype=np.float32)
        for some in spans(len(q), max(1, GATHERED // max(1, ids.shape[1] * self.x.shape[1]))):
            out[some] = np.einsum("nd,ncd->nc", q[some], self.x[np.maximum(ids[some], 0)])
        out[ids < 0] = -2
        return out

    def at_once(self) -> int:
        """Queries of a beam search at once: what they have seen and the vectors they meet in one step are bounded."""
        return max(8, min(SEEN_CELLS // len(self.x), GATHERED // (OPENED * 2 * LINKS * self.x.shape[1])))

    def insert(self, new: np.ndarray) -> None:
        x = self.x[new]
        start = self.descend(x, int(self.level[self.entry]), self.level[new])
        among = x @ x.T
        np.fill_diagonal(among, -2)
        for k in range(min(int(self.level[new].max()), int(self.level[self.entry])), -1, -1):
            rows = np.flatnonzero(self.level[new] >= k)
            parts = [self.beam(x[rows[some]], start[rows[some], None], BUILD_BEAM, k) for some in spans(len(rows), self.at_once())]
            ids, sims = (np.concatenate(part) for part in zip(*parts, strict=True))
            start[rows] = ids[:, 0]
            # Nodes of the same batch are candidates too.
            own = among[np.ix_(rows, rows)]
            take = min(LINKS, len(rows))
            best = np.argpartition(-own, take - 1, axis=1)[:, :take]
            ids = np.concatenate([ids, new[rows][best]], axis=1)
            sims = np.concatenate([sims, np.take_along_axis(own, best, axis=1)], axis=1)
            self.connect(new[rows], ids, sims, k)
        for k in range(int(self.level[self.entry]) + 1, int(self.level[new].max()) + 1):
            rows = new[self.level[new] >= k]
            sims = self.x[rows] @ self.x[rows].T
            np.fill_diagonal(sims, -2)
            take = min(LINKS, len(rows))
            best = np.argsort(-sims, axis=1)[:, :take]
            self.connect(rows, rows[best], np.take_along_axis(sims, best, axis=1), k)
        top = new[np.argmax(self.level[new])]
        if self.level[top] > self.level[self.entry]:
            self.entry = int(top)

    def chosen(self, ids: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
        """Of each row's candidates those no nearer to a chosen one than to the node; free places go to the nearest left."""
        step = max(1, GATHERED // (ids.shape[1] * self.x.shape[1]))
        return np.concatenate([self.choose(ids[some], sims[some], keep) for some in spans(len(ids), step)])

    def choose(self, ids: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        valid = (ids >= 0) & (sims > -1.5)
        valid[:, 1:] &= ids[:, 1:] != ids[:, :-1]
        v = self.x[np.maximum(ids, 0)]
        between = np.matmul(v, v.transpose(0, 2, 1))
        taken = np.zeros_like(valid)
        count = np.zeros(len(ids), dtype=np.int64)
        for c in range(ids.shape[1]):
            rival = np.where(taken, between[:, c], -2).max(axis=1)
            ok = valid[:, c] & (count < keep) & (rival <= sims[:, c])
            taken[:, c] = ok
            count += ok
        rank = np.where(taken, 0, np.where(valid, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
        first = np.argsort(rank, axis=1)[:, :keep]
        out = np.take_along_axis(np.where(valid, ids, -1), first, axis=1)
        return np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=-1)

    def connect(self, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> None:
        table = self.near[k]
        keep = table.shape[1]
        picked = self.chosen(np.where(sims > -1.5, ids, -1), sims, LINKS)
        table[self.rows(k, nodes), :LINKS] = picked
        src = np.repeat(nodes, LINKS)[picked.ravel() >= 0]
        dst = picked.ravel()[picked.ravel() >= 0]
        # Links back: each target chooses anew among its neighbours and the newcomers, a bounded number at a time.
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        targets, begin, count = np.unique(dst, return_index=True, return_counts=True)
        for at in range(0, int(count.max()) if len(count) else 0, keep):
            some = targets[count > at]
            width = int(min(keep, (count[count > at] - at).max()))
            place = begin[count > at][:, None] + at + np.arange(width)
            fits = place < (begin + count)[count > at][:, None]
            newer = np.where(fits, src[np.minimum(place, len(src) - 1)], -1)
            all_ids = np.concatenate([table[self.rows(k, some)], newer], axis=1)
            all_sims = self.products(self.x[some], all_ids)
            table[self.rows(k, some)] = self.chosen(all_ids, all_sims, keep)

    def descend(self, q: np.ndarray, top: int, until: np.ndarray) -> np.ndarray:
        """The node reached by going to ever nearer neighbours on the levels above `until`."""
        at = np.full(len(q), self.entry)
        sim = q @ self.x[self.entry]
        for k in range(top, 0, -1):
            moving = np.flatnonzero(until < k)
            while len(moving):
                near = self.near[k][self.rows(k, at[moving])]
                sims = self.products(q[moving], near)
                best = sims.argmax(axis=1)
                better = sims[np.arange(len(moving)), best] > sim[moving]
                moving, best, near, sims = moving[better], best[better], near[better], sims[better]
                at[moving] = near[np.arange(len(moving)), best]
                sim[moving] = sims[np.arange(len(moving)), best]
        return at

    def beam(self, q: np.ndarray, start: np.ndarray, width: int, k: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Places and similarities of the nodes a beam search ends with, nearest first; -1 and -2 where none."""
        m = len(q)
        ids = np.full((m, width), -1, dtype=np.int64)
        sims = np.full((m, width), -2, dtype=np.float32)
        ids[:, : start.shape[1]] = start
        sims[:, : start.shape[1]] = np.einsum("nd,ncd->nc", q, self.x[start])
        opened = np.zeros((m, width), dtype=bool)
        seen = np.zeros((m, len(self.x)), dtype=bool)
        np.put_along_axis(seen, start, True, axis=1)
        live = np.arange(m)
        while len(live):
            # The best nodes not yet opened.
            rank = np.where(opened[live] | (ids[live] < 0), -3, sims[live])
            pick = np.argpartition(-rank, min(OPENED, width) - 1, axis=1)[:, :OPENED]
            can = np.take_along_axis(rank, pick, axis=1) > -2.5
            going = can.any(axis=1)
            live, pick, can = live[going], pick[going], can[going]
            if not len(live):
                break
            opened[live[:, None], pick] |= can
            near = self.near[k][self.rows(k, np.take_along_axis(ids[live], pick, axis=1))]
            near = np.where(can[:, :, None], near, -1).reshape(len(live), -1)
            near.sort(axis=1)
            fresh = near >= 0
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            safe = np.maximum(near, 0)
            fresh &= ~seen[live[:, None], safe]
            r, c = np.nonzero(fresh)
            seen[live[r], near[r, c]] = True
            gained = np.full(near.shape, -2, dtype=np.float32)
            gained[r, c] = np.einsum("nd,nd->n", q[live[r]], self.x[near[r, c]])
            all_ids = np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1)
            all_sims = np.concatenate([sims[live], gained], axis=1)
            all_open = np.concatenate([opened[live], np.zeros_like(fresh)], axis=1)
            best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            ids[live] = np.take_along_axis(all_ids, best, axis=1)
            sims[live] = np.take_along_axis(all_sims, best, axis=1)
            opened[live] = np.take_along_axis(all_open, best, axis=1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)

    def whole(self, q: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs (query, node) with at least this similarity, by comparison with every node, some queries at a time."""
        step = max(1, SEEN_CELLS // (4 * len(self.x)))
        for i in range(0, len(q), step):
            hit = q[i : i + step] @ self.x.T >= least
            # Places take many times the memory of the cells.
            for some in spans(len(hit), max(1, step // 16)):
                r, c = np.nonzero(hit[some])
                yield r + (i + some.start), c

    def within(self, q: np.ndarray, least: float, first: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) the search finds, some queries at a time; a beam full of hits is widened, at last to the whole shard."""
        todo, width = np.arange(len(q)), first
        while len(todo) and width <= min(WIDEST_BEAM, len(self.x)):
            full = []
            for part in spans(len(todo), self.at_once()):
                some = todo[part]
                start = self.descend(q[some], int(self.level[self.entry]), np.zeros(len(some), dtype=np.int64))
                ids, sims = self.beam(q[some], start[:, None], width)
                hit = sims >= least
                saturated = hit.sum(axis=1) > width // 2
                full.append(some[saturated])
                r, c = np.nonzero(hit & ~saturated[:, None])
                yield some[r], ids[r, c]
            todo, width = np.concatenate(full), width * WIDEN
        for r, c in self.whole(q[todo], least):
            yield todo[r], c

    def audited(self, q: np.ndarray, least: float, own: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs found with the first beam whose recall, on some queries, an exact comparison confirms; some queries at a time.

        Recall is the mean over queries of the share of their neighbours found, for few and for many neighbours
        apart; both must suffice. `own` is each query's own node, which is no neighbour, or -1.
        """
        sample = np.unique(np.linspace(0, len(q) - 1, min(AUDITED, len(q))).astype(np.int64))
        width = FIRST_BEAM
        while width <= min(WIDEST_BEAM, len(self.x)):
            if self.recalls(q[sample], least, width, None if own is None else own[sample]):
                return self.within(q, least, width)
            width *= WIDEN
        return self.whole(q, least)

    def recalls(self, q: np.ndarray, least: float, width: int, own: np.ndarray | None) -> bool:
        """Whether a beam finds enough of what there is, held against it for a few queries at a time."""
        size, found = np.zeros(len(q)), np.zeros(len(q))
        step = max(1, SEEN_CELLS // (4 * len(self.x)))
        for i in range(0, len(q), step):
            part = q[i : i + step]
            truth = part @ self.x.T >= least
            if own is not None:
                known = np.flatnonzero(own[i : i + step] >= 0)
                truth[known, own[i + known]] = False
            size[i : i + step] = truth.sum(axis=1)
            for r, c in self.within(part, least, width):
                found[i : i + step] += np.bincount(r[truth[r, c]], minlength=len(part))
        # A first beam that finds more than half of its width is widened in any case.
        sides = [x for x in ((size > 0) & (size <= FIRST_BEAM // 2), size > FIRST_BEAM // 2) if x.any()]
        return all((found[side] / size[side]).mean() >= RECALL for side in sides)


def _units(v: np.ndarray) -> np.ndarray:
    out = np.empty(v.shape, dtype=np.float32)
    for some in spans(len(v), max(1, GATHERED // max(1, v.shape[1]))):
        part = v[some].astype(float)
        out[some] = part / np.linalg.norm(part, axis=1, keepdims=True)
    return out


def _numbers(vectors: bytes | np.ndarray, rows: int, width: int) -> np.ndarray:
    """The vectors as they are stored, in single or double precision."""
    return np.frombuffer(vectors, f"<f{len(vectors) // (rows * width)}").reshape(rows, width)


def _build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A shard's graph, nodes and vectors as rows of bounded size; a row without a part ends it."""
    turn, node, copies, vectors = [], [], [], []
    for rows in batches:
        width, shard = int(rows["width"].iloc[0]), int(rows["shard"].iloc[0])
        turn.append(rows["turn"].to_numpy("<i8"))
        node.append(rows["node"].to_numpy("<i8"))
        copies.append(rows["copies"].to_numpy("<i8"))
        vectors.append(b"".join(rows["vector"]))
    order = np.argsort(np.concatenate(turn), kind="stable")
    kept = {"nodes": np.concatenate(node)[order], "copies": np.concatenate(copies)[order]}
    whole = _numbers(b"".join(vectors), len(order), width)
    vectors.clear()
    kept["vectors"] = whole[order]
    del whole
    graph = Graph.build(_units(kept["vectors"]))
    kept |= {"level": graph.level} | {f"near{k}": t for k, t in enumerate(graph.near)} | {"entry": np.array([graph.entry])}
    del graph
    rows = [*_pieces(kept), (None, 0, 0, None)]
    for some in spans(len(rows), PIECES):
        part, at, size, data = zip(*rows[some], strict=True)
        yield pd.DataFrame({"width": width, "shard": shard, "part": part, "at": at, "size": size, "data": [x if x is None else bytes(x) for x in data]})


def _pieces(kept: dict[str, np.ndarray]) -> Iterator[tuple[str, int, int, memoryview]]:
    for part, table in kept.items():
        data = memoryview(np.ascontiguousarray(table).reshape(-1).view(np.uint8))
        for some in spans(len(data), PIECE_BYTES):
            yield part, some.start, len(data), data[some]


def _slice(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([{"q_width": rows["width"].iloc[0], "q_nodes": rows["node"].to_numpy("<i8").tobytes(), "q_vectors": b"".join(rows["vector"])}])


class Pair(NamedTuple):
    """A shard and a slice of queries."""

    width: int
    nodes: np.ndarray
    copies: np.ndarray
    vectors: np.ndarray
    q_nodes: bytes
    q_vectors: bytes


def _search(cosine: float):
    """Rows of a shard come first, one shard after the other, then its slices, each with the row that ends the shard."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, kept, graph = None, {}, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if (row.width, row.shard) != last:
                    last, kept, graph = (row.width, row.shard), {}, None
                if row.data is not None:
                    size, table = kept.setdefault(row.part, [0, np.empty(row.size, dtype=np.uint8)])
                    table[row.at : row.at + len(row.data)] = np.frombuffer(row.data, np.uint8)
                    kept[row.part][0] = size + len(row.data)
                elif row.q_nodes is not None:
                    graph = graph or _loaded(kept, row.width)
                    yield _linked(graph, Pair(row.width, *(kept[x][1] for x in ("nodes", "copies", "vectors")), row.q_nodes, row.q_vectors), cosine)

    return run


def _loaded(kept: dict[str, list], width: int) -> Graph:
    """The graph of a shard; what is missing or came twice must not pass for a graph."""
    if "entry" not in kept or any(size != len(table) for size, table in kept.values()):
        raise RuntimeError("a shard's rows must come whole and before its slices")
    level = kept["level"][1].view(np.int8)
    near = [kept[f"near{k}"][1].view(np.int32).reshape(-1, LINKS if k else 2 * LINKS) for k in range(int(level.max()) + 1)]
    return Graph(_units(_numbers(kept["vectors"][1], len(level), width)), level, near, int(kept["entry"][1].view(np.int64)[0]))


def _linked(graph: Graph, pair, cosine: float) -> pd.DataFrame:
    """Links of a slice of queries with a shard: their number by query, and a spanning forest of them.

    Pairs are verified and added up as they are found, so that a group as large as slice and shard takes no
    more memory than a few queries against the shard.
    """
    nodes, copies, asked = (np.frombuffer(x, "<i8") for x in (pair.nodes, pair.copies, pair.q_nodes))
    v, w = _numbers(pair.q_vectors, len(asked), pair.width), _numbers(pair.vectors, len(nodes), pair.width)
    order = np.argsort(nodes)
    place = order[np.minimum(np.searchsorted(nodes, asked, sorter=order), len(nodes) - 1)]
    own = np.where(nodes[place] == asked, place, -1)
    # Nodes of the shard by place; queries that are not among them after those.
    names = np.concatenate([nodes, asked])
    spot = np.where(own >= 0, own, len(nodes) + np.arange(len(asked)))
    root, links = np.arange(len(names)), np.zeros(len(asked), dtype=np.int64)
    step = max(1, min(VERIFIED, GATHERED // (4 * pair.width)))
    long_v, long_w = _lengths(v, step), _lengths(w, step)
    for r, c in graph.audited(_units(v), cosine - SLACK, own):
        for some in spans(len(r), step):
            a, b = r[some], c[some]
            exact = np.einsum("nd,nd->n", v[a].astype(float), w[b].astype(float)) / (long_v[a] * long_w[b]) >= cosine
            exact &= own[a] != b
            a, b = a[exact], b[exact]
            links += np.bincount(a, weights=copies[b].astype(float), minlength=len(v)).astype(np.int64)
            x, y = root[spot[a]], root[b]
            if (x != y).any():
                root = forest(x, y, len(names))[root]
    off = np.flatnonzero(root != np.arange(len(names)))
    hit = links > 0
    counted = pd.DataFrame({"node": asked[hit], "links": links[hit], "other": None})
    joined = pd.DataFrame({"node": names[off], "links": 0, "other": names[root[off]]})
    return pd.concat([counted, joined]).astype({"node": "int64", "links": "int64", "other": "Int64"})


def _lengths(v: np.ndarray, step: int) -> np.ndarray:
    parts = (v[some].astype(float) for some in spans(len(v), step))
    return np.sqrt(np.concatenate([np.einsum("nd,nd->n", x, x) for x in parts]))


def usable(vector: Column) -> Column:
    """Whether a vector can link: components all there and finite, and not all zero."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(ok & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row: links at `cosine` or more, verified in double precision.

    Equal vectors are one node with its number of copies. Nodes are dealt by hash to shards; each shard gets
    a hierarchical graph, every node is put to every shard, and the answers are added up. Beams full of hits
    are widened, as are all beams of a task whose mean recall on audited queries, of few or of many neighbours, falls
    below `RECALL`; a group
    larger than the widest beam is compared with the whole shard. Nothing below the cosine is linked.
    Links are verified and added up as they are found and leave a task as sums and as a spanning forest, so no
    task holds all pairs of a group. Shards are bounded in bytes, whatever the width of the vectors, and go
    from task to task in rows of `PIECE_BYTES`; only the Python worker that searches a shard holds it whole.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
    vectors of different length. Copies of a vector link with each other. A null id is never the smallest;
    it is kept where no id is known. Rows that repeat an id are counted each. Empty tables give no rows.
    """
    spark = table.sparkSession
    given = packed(table).select(F.col(f"row.`{id_col}`").alias("vec_id"), F.col(f"row.`{vector_col}`").alias("v"))
    # Vectors that come in single precision are passed on as they came; all sums are in double precision.
    number = "<f4" if given.schema["v"].dataType == ArrayType(FloatType(), given.schema["v"].dataType.containsNull) else "<f8"
    rows = given.withColumn("v", F.col("v").cast("array<double>"))
    rows = stored(rows.select(F.monotonically_increasing_id().alias("at"), "vec_id", F.when(usable(F.col("v")), F.col("v")).alias("v")), "vectors")
    grouped = rows.where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    nodes = stored(grouped.select(F.monotonically_increasing_id().alias("node"), "v", "copies", "first"), "vector-nodes")

    @F.pandas_udf("binary")
    def flat(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in vectors:
            yield pd.Series([np.asarray(x, dtype=number).tobytes() for x in batch])

    n, numbers = nodes.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    shards = max(LEAST_SHARDS, -(-n // SHARD_ROWS), -(-8 * numbers // SHARD_BYTES))
    slices = max(1, -(-n // SLICE_ROWS), -(-8 * numbers // SLICE_BYTES))
    turn = F.xxhash64("node", F.lit("turn"))
    dealt = nodes.select("node", "copies", F.size("v").alias("width"), flat("v").alias("vector"), turn.alias("turn"), F.pmod(turn, F.lit(shards)).cast("int").alias("shard"))
    dealt = stored(dealt, "vector-shards")
    # Graphs are dear and slices small, so both are dealt by number, not by bytes. The second exchange keeps a shard's rows together and in order.
    graphs = dealt.repartitionById(shards, "shard").groupBy("width", "shard").applyInPandas(_build, "width int, shard int, part string, at long, size long, data binary")
    graphs = graphs.repartitionById(shards, "shard")
    cut = dealt.withColumn("slice", F.pmod(F.xxhash64("node", F.lit("slice")), F.lit(slices)).cast("int"))
    asked = stored(cut.repartition(slices, "width", "slice").groupBy("width", "slice").applyInPandas(_slice, "q_width int, q_nodes binary, q_vectors binary"), "vector-slices")
    # Queries against all shards: a task has one shard and some slices, which it reads from the shared folder and does not shuffle.
    # The shard's rows come once, with the first slice of those (its number in the partition is 0), the slices with the row that ends the shard.
    asked = asked.withColumn("first", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0)
    ends = F.col("part").isNull()
    pairs = graphs.hint("shuffle_replicate_nl").join(asked, (~ends & F.col("first")) | (ends & (F.col("width") == F.col("q_width"))))
    pairs = pairs.select(*graphs.columns, *(F.when(ends, F.col(c)).alias(c) for c in ("q_nodes", "q_vectors")))
    found = stored(pairs.mapInPandas(_search(cosine), "node long, links long, other long"), "vector-links")

    links = stored(found.groupBy("node").agg(F.sum("links").alias("links")), "vector-sums")
    roots = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))).toDF("r_node", "root")
    placed = nodes.join(links, "node", "left").join(roots, F.col("node") == F.col("r_node"), "left")
    placed = stored(placed.select("node", "v", "first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")), "vector-placed")
    smallest = stored(placed.groupBy("root").agg(F.min("first").alias("component_id")), "vector-smallest")
    named = stored(placed.join(smallest, "root").select(F.col("v").alias("of"), "n_links", "component_id"), "vector-named")
    return rows.join(named, F.col("v") == F.col("of"), "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("of").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("of").isNull() | F.col("component_id").isNull()).alias("kept"),
    )
