"""Tables laid out by hash bucket of a key: the state of jobs that run again and again."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a new store, and batches of a bucket beyond which they are put together.
BUCKETS, MOST_BATCHES = 64, 16
#: The number that compacted rows have in place of their batch.
COMPACTED = -1


class KeyedStore:
    """Rows by key under `path`, in folders bucket=b/batch=n of Parquet files.

    A key's bucket is its hash, so a batch of rows reads only the buckets its keys fall into, and of those
    only the key column. A batch writes folders of its own and replaces them when it runs again after a
    failure. The number of buckets is fixed when the store is made and kept beside the
    data. One job writes at a time; readers see whole batches.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = T.StructType([f for f in schema.fields if f.name not in ("bucket", "batch")])
        self.layout = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.LongType())])
        self._recover()
        made = [int(m[1]) for n in self._names("") if (m := re.fullmatch(r"_buckets=(\d+)", n))]
        self.buckets = made[0] if made else buckets
        if not made:
            self._files.mkdirs(self._place(f"_buckets={buckets}"))

    def bucket(self, key: Column | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key) if key is None else key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that the keys of some rows fall into; at most `buckets` numbers."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """Stored rows with their bucket and batch, of some buckets or of all; other folders are not even listed."""
        there = set(self._names(""))
        wanted = range(self.buckets) if buckets is None else buckets
        paths = [f"{self.path}/bucket={b}" for b in wanted if f"bucket={b}" in there]
        if not paths:
            return self.spark.createDataFrame([], self.layout)
        return self.spark.read.schema(self.layout).option("basePath", self.path).parquet(*paths)

    def unseen(self, rows: DataFrame, batch: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows whose key no other batch has stored. Reads keys of the buckets touched (`buckets`, if known), and nothing else."""
        stored = self.read(self.touched(rows) if buckets is None else buckets)
        if batch is not None:
            # A batch that is run again must not see what it wrote itself.
            stored = stored.where(F.col("batch") != batch)
        return rows.withColumn("bucket", self.bucket()).join(stored.select("bucket", self.key), ["bucket", self.key], "left_anti").drop("bucket")

    def append(self, rows: DataFrame, batch: int | None = None) -> int:
        """Store rows as one batch, by default the next; returns its number. Large buckets are written by many tasks."""
        batch = self.next_batch() if batch is None else batch
        dealt = rows.select(*self.schema.fieldNames(), self.bucket().alias("bucket"), F.lit(batch).cast("long").alias("batch"))
        dealt.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(self.path)
        return batch

    def add(self, rows: DataFrame, batch: int | None = None) -> int:
        """Store those rows, one for each key, whose key is new."""
        rows = rows.persist()
        try:
            return self.append(self.unseen(rows, batch), batch)
        finally:
            rows.unpersist()

    def batches(self) -> dict[int, list[int]]:
        """The batches that each bucket holds."""
        found = {int(n[7:]): [int(x[6:]) for x in self._names(n) if x.startswith("batch=")] for n in self._names("") if n.startswith("bucket=")}
        return {b: sorted(held) for b, held in found.items()}

    def next_batch(self) -> int:
        return max([COMPACTED, *(n for held in self.batches().values() for n in held)]) + 1

    def compact(self, most: int = MOST_BATCHES) -> list[int]:
        """Put the batches of each bucket that has more than `most` into one; returns these buckets.

        The new files are written aside and marked, with the batches they replace, as done; only then do they take
        the old ones' place. If that is broken off, the next job that opens the store ends it, or drops what was not marked.
        A batch that runs again after its rows were compacted finds their keys stored and adds nothing.
        """
        full = {b: held for b, held in self.batches().items() if len(held) > most}
        if not full:
            return []
        rows = self.read(sorted(full)).drop("batch")
        rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/_compacting")
        for b, held in full.items():
            for n in held:
                self._files.mkdirs(self._place(f"_compacting/_old/bucket={b}/batch={n}"))
        self._files.mkdirs(self._place("_compacting/_marked"))
        self._recover()
        return sorted(full)

    def _recover(self) -> None:
        if "_compacting" not in self._names(""):
            return
        if "_marked" in self._names("_compacting"):
            for b in self._names("_compacting/_old"):
                aside = b in self._names("_compacting")
                for n in self._names(f"_compacting/_old/{b}"):
                    # Once the new files are in place, the old folder of that name is theirs.
                    if aside or n != f"batch={COMPACTED}":
                        self._files.delete(self._place(f"{b}/{n}"), True)
                if aside:
                    self._files.rename(self._place(f"_compacting/{b}"), self._place(f"{b}/batch={COMPACTED}"))
        self._files.delete(self._place("_compacting"), True)

    def _place(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    @property
    def _files(self):
        return self._place("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        place = self._place(folder)
        return sorted(s.getPath().getName() for s in self._files.listStatus(place)) if self._files.exists(place) else []
