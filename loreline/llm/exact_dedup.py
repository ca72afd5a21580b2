"""Exact duplicates by an exchange of Golomb-coded fingerprints."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreline.llm.common import packed, stored, text_or_empty

#: Hashes that one sender or owner holds, about; there are as many as that takes.
PART_HASHES = 500_000


def golomb_encode(values: np.ndarray) -> bytes:
    """Sorted distinct unsigned 64-bit numbers as Rice-coded gaps.

    Layout: count (4 bytes), parameter k (1 byte), first value (8 bytes), the quotients of the gaps in
    unary (a one ends each), then the remainders in k bits each; the two bit runs are padded to bytes.
    """
    n = len(values)
    if n == 0:
        return (0).to_bytes(4, "little")
    gaps = np.diff(values)
    span = int(values[-1]) - int(values[0])
    k = max(0, int(np.log2(max(1.0, 0.69 * span / max(1, n - 1)))))
    head = n.to_bytes(4, "little") + bytes([k]) + int(values[0]).to_bytes(8, "little")
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + n - 1, dtype=np.uint8)
    if n > 1:
        unary[np.cumsum(quotients + 1) - 1] = 1
    shifts = np.arange(k, dtype=np.uint64)
    bits = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return head + np.packbits(unary).tobytes() + np.packbits(bits.ravel()).tobytes()


def golomb_decode(blob: bytes) -> np.ndarray:
    """The inverse of `golomb_encode`."""
    n = int.from_bytes(blob[:4], "little")
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    k, first = blob[4], int.from_bytes(blob[5:13], "little")
    body = np.frombuffer(blob, dtype=np.uint8, offset=13)
    rest_bytes = ((n - 1) * k + 7) // 8
    ends = np.flatnonzero(np.unpackbits(body[: len(body) - rest_bytes]))[: n - 1]
    quotients = (np.diff(ends, prepend=-1) - 1).astype(np.uint64)
    bits = np.unpackbits(body[len(body) - rest_bytes :])[: (n - 1) * k].reshape(n - 1, k)
    gaps = (quotients << np.uint64(k)) | (bits.astype(np.uint64) << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.concatenate([[np.uint64(first)], np.uint64(first) + np.cumsum(gaps, dtype=np.uint64)])


def owner_of(values: np.ndarray, owners: int) -> np.ndarray:
    """The range of the hash space that a value falls in."""
    return ((values >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int32)


def _send(owners: int):
    def encode(rows: pd.DataFrame) -> pd.DataFrame:
        values = np.unique(rows["fp"].to_numpy().view(np.uint64))
        cuts = np.flatnonzero(np.diff(owner_of(values, owners))) + 1
        parts = np.split(values, cuts)
        return pd.DataFrame({
            "sender": rows["sender"].iloc[0],
            "owner": [int(owner_of(p[:1], owners)[0]) for p in parts],
            "blob": [golomb_encode(p) for p in parts],
        })

    return encode


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """An owner's bitmaps: which of a sender's hashes another sender has too."""
    lists = [golomb_decode(b) for b in rows["blob"]]
    _, place, seen = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    flags = np.split(seen[place] > 1, np.cumsum([len(x) for x in lists])[:-1])
    return pd.DataFrame({"sender": rows["sender"], "owner": rows["owner"], "n": [len(x) for x in lists], "bitmap": [np.packbits(x).tobytes() for x in flags]})


def _mark(rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
    """A sender's hashes that stand more than once: the owners' bitmaps laid end to end fit its sorted hashes."""
    values, seen = np.unique(rows["fp"].to_numpy().view(np.uint64), return_counts=True)
    twice = seen > 1
    if len(replies):
        replies = replies.sort_values("owner")
        twice |= np.concatenate([np.unpackbits(np.frombuffer(b, dtype=np.uint8))[:n] for b, n in zip(replies["bitmap"], replies["n"], strict=True)]).astype(bool)
    return pd.DataFrame({"fp": values[twice].view(np.int64)})


def suspects(prints: DataFrame, parts: int) -> DataFrame:
    """Distinct fingerprints (fp) that stand more than once in `prints` (fp, part), by the exchange.

    Rows of one scan partition stay together as one sender; it sends each owner of a hash range its
    sorted distinct hashes, Golomb-coded, and gets a bitmap back. What an owner holds is bounded by the
    number of senders for any one hash, so a hot text is no hot key.
    """
    sent = prints.select(F.pmod("part", F.lit(parts)).alias("sender"), "fp")
    blobs = sent.groupBy("sender").applyInPandas(_send(parts), "sender int, owner int, blob binary")
    replies = blobs.groupBy("owner").applyInPandas(_answer, "sender int, owner int, n int, bitmap binary")
    marked = sent.groupBy("sender").cogroup(replies.groupBy("sender")).applyInPandas(_mark, "fp long")
    return marked.distinct()


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Classes of equal texts; of each class the row with the largest id stays.

    Returns (doc_id, keep_id, group_size, kept, text_sha256), one row per input row. Texts are equal when
    their bytes are; null counts as empty. Fingerprints only name suspects: their texts are shuffled and
    compared whole by a grouping on the text, which is combined before the shuffle, so a text that a third
    of all rows share costs each task one row. If two different texts shared fingerprint and digest, their
    rows would be told apart by the text itself.

    Null ids are smaller than any other; a class without any id has a null keep_id and keeps its rows. Rows that repeat an id with its text are all kept if theirs is the largest id. Empty tables give
    no rows.
    """
    spark = docs.sparkSession
    base = packed(docs).select(F.col(f"row.`{id_col}`").alias("doc_id"), text_or_empty(F.col(f"row.`{text_col}`")).alias("text"))
    hashed = base.withColumns({"fp": F.xxhash64("text"), "sha": F.unhex(F.sha2("text", 256))})
    prints = stored(hashed.select("doc_id", "fp", "sha", F.spark_partition_id().alias("part")), "exact-prints")
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-prints.count() // PART_HASHES))
    found = stored(suspects(prints, parts), "exact-suspects")
    texts = hashed.join(found, "fp", "left_semi").groupBy("fp", "sha", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    classes = stored(texts.drop("text"), "exact-classes")
    keys = ["fp", "sha"]
    if not classes.groupBy(*keys).count().where("count > 1").isEmpty():
        # Different texts with one fingerprint and one SHA-256: rows meet their class by the text itself.
        prints, classes, keys = hashed, texts, ["fp", "sha", "text"]
    sized = prints.join(classes, keys, "left")
    return sized.select(
        "doc_id",
        F.when(F.col("group_size") > 1, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.when(F.col("group_size") > 1, F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())).otherwise(True).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.col("fp").alias("fingerprint"),
    )


def without_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that stay, found again by id and fingerprint."""
    drop = exact_duplicates(docs, id_col=id_col, text_col=text_col, **options).where("not kept").select("doc_id", "fingerprint").distinct()
    drop = stored(drop, "exact-dropped").toDF("__doc", "__fp")
    gone = F.col(f"`{id_col}`").eqNullSafe(F.col("__doc")) & (F.xxhash64(text_or_empty(f"`{text_col}`")) == F.col("__fp"))
    return docs.join(drop, gone, "left_anti")
