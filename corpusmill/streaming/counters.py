"""Counters kept from a stream of changes: each batch is added to what is there, and only the buckets that it touches are written.

The counters are a table in buckets (operators/buckets.py). A streaming batch has its number from the checkpoint and is the version
of that number: a batch that comes again after a crash is worked out from the versions before it and writes the same rows once more,
so it changes nothing. No key is in memory beyond its batch, and a batch costs what the buckets that it touches hold.

Changes: key, delta (retractions are negative), ts. Defined cases: a null delta changes nothing; counters are not below 0 when they
are read, but keep what was taken too much, so that late additions come out right; a null key is a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.buckets import BucketTable


def counters(spark: SparkSession, path: str, key: str = "long", buckets: int = 64) -> BucketTable:
    """key: the type of the counters' keys."""
    return BucketTable(spark, path, T.StructType.fromDDL(f"key {key}, n long, touched_at timestamp"), "key", buckets)


def apply(table: BucketTable, changes: DataFrame, batch: int) -> None:
    """Add the changes of one batch; the same batch again changes nothing."""
    sums = changes.groupBy("key").agg(F.sum(F.coalesce("delta", F.lit(0))).cast("long").alias("n"), F.max(F.col("ts").cast("timestamp")).alias("touched_at"))
    table.change(changes.select("key"), lambda old: old.unionByName(sums).groupBy("key").agg(F.sum("n").alias("n"), F.max("touched_at").alias("touched_at")), version=batch)


def read(table: BucketTable) -> DataFrame:
    """key, n, touched_at."""
    return table.read().select("key", F.greatest("n", F.lit(0)).alias("n"), "touched_at")


def follow(table: BucketTable, changes: DataFrame, checkpoint: str) -> StreamingQuery:
    """The query that keeps the counters from a streaming DataFrame of changes, up to what is there now."""
    return changes.writeStream.foreachBatch(lambda rows, batch: apply(table, rows, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
