"""A keyed table kept up to date by a stream, in which no batch counts twice.

The table is cut into buckets by its key. A batch reads and writes the buckets that it touches and no others; a
manifest says for each bucket which batch wrote it last, and appears by a rename once all is written. A batch
that comes again, because the stream died between the write and its own checkpoint, finds its
manifest and does nothing; one that died before is made again over its own leftovers.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from foliant.operators import changes, vector
from foliant.sources.files import Folder


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema, key: str, buckets: int = 64):
        self.spark, self.key, self.buckets = spark, key, buckets
        self.schema = spark.createDataFrame([], schema).schema
        self.folder, self.manifests = Folder(spark, path), Folder(spark, f"{path.rstrip('/')}/manifests")

    def last_batch(self) -> int:
        return max((int(n) for n in self.manifests.names() if n.isdigit()), default=-1)

    def manifest(self) -> dict[str, int]:
        """Bucket -> the batch that wrote it last."""
        last = self.last_batch()
        return json.loads(self.manifests.read(f"{last:012d}")) if last >= 0 else {}

    def _of(self, wanted: dict[str, int]) -> DataFrame:
        parts = [self.spark.read.schema(self.schema).parquet(*[f"{self.folder.path}/batch-{b}/__bucket={k}" for k, at in wanted.items() if at == b]) for b in sorted(set(wanted.values()))]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._of(self.manifest())

    def apply(self, batch: DataFrame, batch_id: int, order: Sequence[str] = (), policy: dict[str, str] | None = None) -> bool:
        """Upsert a batch (its newest row a key, by ``order`` descending); False if it was there already."""
        if batch_id <= self.last_batch():
            return False
        newest = vector.top_per(batch.where(F.col(self.key).isNotNull()), [self.key], [F.desc(c) for c in order] or [F.lit(1)], 1).select(*self.schema.names)
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        known = self.manifest()
        touched = [str(r[0]) for r in newest.select(bucket.alias("b")).distinct().collect()]  # at most ``buckets``
        current = self._of({k: known[k] for k in touched if k in known})
        self.folder.delete(f"batch-{batch_id}")
        if touched:
            changes.upsert(current, newest, self.key, policy).withColumn("__bucket", bucket).write.partitionBy("__bucket").parquet(f"{self.folder.path}/batch-{batch_id}")
        if not self.manifests.put_new(f"{batch_id:012d}", json.dumps(known | dict.fromkeys(touched, batch_id))):
            return False
        return True

    def drop_unused(self, keep: int = 2) -> None:
        """Remove what no one of the last ``keep`` manifests names."""
        names = [n for n in self.manifests.names() if n.isdigit()]
        used = {b for n in names[-keep:] for b in json.loads(self.manifests.read(n)).values()}
        for n in self.folder.names():
            if n.startswith("batch-") and int(n[6:]) not in used and int(n[6:]) < int(names[-1]):
                self.folder.delete(n)
        for n in names[:-keep]:
            self.manifests.delete(n)


def upsert_stream(stream: DataFrame, table: KeyedTable, checkpoint: str, order: Sequence[str] = (), policy: dict[str, str] | None = None) -> DataStreamWriter:
    """A writer (to be started) that keeps ``table`` up to date from ``stream``."""
    return stream.writeStream.foreachBatch(lambda batch, batch_id: table.apply(batch, batch_id, order, policy) and None).option("checkpointLocation", checkpoint)
