"""Best entries for each query, kept by task as packed lists and merged as a tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreline.llm.common import stored

#: Lists of one group of queries that a task merges at once.
FAN = 16
#: The lists of queries `owner` (places in a group `tile` of queries) from one part of the candidates. Each
#: binary holds one number for each entry; `known` is 0 where the candidate has no id.
PACKED = "tile long, part long, owner binary, score binary, id binary, known binary"
TYPES = {"owner": "<i8", "score": "<i8", "id": "<i8", "known": "u1"}


class TopLists:
    """The `k` best of what was added, for each owner: highest scores, then smallest ids, those without id last."""

    def __init__(self, k: int):
        self.k = k
        self.lists = {name: np.zeros(0, kind) for name, kind in TYPES.items()}

    def add(self, **entries: np.ndarray) -> None:
        self.lists = {name: np.concatenate([self.lists[name], entries[name]]).astype(kind) for name, kind in TYPES.items()}
        kept, _ = self.ranked()
        self.lists = {name: values[kept] for name, values in self.lists.items()}

    def ranked(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the entries that stay, owner by owner and best first, and their ranks from 0."""
        x = self.lists
        order = np.lexsort((x["id"], 1 - x["known"], ~x["score"], x["owner"]))
        owner = x["owner"][order]
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]][: len(owner)])
        rank = np.arange(len(owner)) - np.repeat(starts, np.diff(np.append(starts, len(owner))))
        return order[rank < self.k], rank[rank < self.k]

    def packed(self, tile: int, part: int) -> dict:
        return {"tile": tile, "part": part} | {name: values.tobytes() for name, values in self.lists.items()}


def unpacked(row) -> dict[str, np.ndarray]:
    return {name: np.frombuffer(getattr(row, name), kind) for name, kind in TYPES.items()}


def merged(lists: DataFrame, k: int, name: str) -> DataFrame:
    """(tile, owner, rank from 1, score, id) of the `k` best of all parts; `lists` is a stored table of packed lists.

    Parts are merged `FAN` at a time until one is left, so no task holds more than that many lists of a tile.
    """

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        best = TopLists(k)
        for row in rows.itertuples():
            best.add(**unpacked(row))
        return pd.DataFrame([best.packed(int(rows["tile"].iloc[0]), int(rows["part"].iloc[0]))])

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                best = TopLists(k)
                best.add(**unpacked(row))
                kept, rank = best.ranked()
                x = {n: v[kept] for n, v in best.lists.items()}
                ids = pd.array(x["id"], dtype="Int64")
                ids[x["known"] == 0] = pd.NA
                yield pd.DataFrame({"tile": row.tile, "owner": x["owner"], "rank": (rank + 1).astype(np.int32), "score": x["score"], "id": ids})

    while lists.agg(F.max("part")).first()[0]:
        wider = lists.withColumn("part", F.expr(f"part div {FAN}"))
        lists = stored(wider.groupBy("tile", "part").applyInPandas(merge, PACKED), name)
    return lists.mapInPandas(spread, "tile long, owner long, rank int, score long, id long")
