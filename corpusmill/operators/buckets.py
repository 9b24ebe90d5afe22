"""Tables in buckets: a change writes the buckets that it touches and publishes them at once, or leaves the table as it was.

The table is a folder. rows/W/bucket=B holds all rows of bucket B as writer W left them; log/version=N says which buckets version N
wrote, and its writer. A bucket's rows are those of its last version in the log. The log entry is written after the rows, as one file,
and is what publishes them: a job that breaks off before it leaves nothing that a reader sees, a version written again stands in for
the one before, and a change costs what the buckets that it touches hold. Of two writers of the same next version the later one fails.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

_LOG = "bucket int, version long, holds boolean, writer string"


class ConcurrentWrite(RuntimeError):
    """Another writer has published the same version."""


@dataclass(frozen=True)
class BucketTable:
    """schema: of the rows; key: the column by whose hash rows are dealt to buckets."""

    spark: SparkSession
    path: str
    schema: T.StructType
    key: str
    buckets: int = 64

    def bucket_of(self, key: str | None = None):
        return F.pmod(F.xxhash64(key or self.key), F.lit(self.buckets)).cast("int")

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(_LOG).json(f"{self.path}/log")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], _LOG)

    def version(self) -> int:
        """The newest version; -1 for a table that is not there."""
        last = self._log().agg(F.max("version")).first()[0]
        return -1 if last is None else last

    def read(self, version: int | None = None, touched: DataFrame | None = None) -> DataFrame:
        """The rows as of a version, by default the newest. touched: a table of bucket numbers; only these buckets are read."""
        log = self._log() if version is None else self._log().where(F.col("version") <= version)
        last = log.groupBy("bucket").agg(F.max_by(F.struct("writer", "holds"), "version").alias("l")).where("l.holds").select("bucket", "l.writer")  # a bucket may have become empty
        if touched is not None:
            last = last.join(touched.select("bucket"), "bucket", "left_semi")
        paths = [f"{self.path}/rows/{r['writer']}/bucket={r['bucket']}" for r in last.collect()]  # one for each bucket
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def change(self, touched: DataFrame, make: Callable[[DataFrame], DataFrame], version: int | None = None) -> int:
        """Write the buckets of `touched` (keys) anew, as make(their rows), and publish them. version: its number, by default the
        next; a number that was published is written again from the versions before it."""
        number = self.version() + 1 if version is None else version
        buckets = touched.select(self.bucket_of().alias("bucket")).distinct().collect()  # as many as there are buckets
        if not buckets:
            return number
        some = self.spark.createDataFrame(buckets, "bucket int")
        rows = make(self.read(number - 1, some)).select(*self.schema.names).withColumn("bucket", self.bucket_of())
        writer = uuid.uuid4().hex
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/rows/{writer}")
        held = self.spark.read.schema("bucket int").parquet(f"{self.path}/rows/{writer}").select("bucket").distinct()
        entry = some.join(held.withColumn("holds", F.lit(True)), "bucket", "left").select("bucket", F.lit(number).cast("long").alias("version"), F.coalesce("holds", F.lit(False)).alias("holds"), F.lit(writer).alias("writer"))
        try:
            entry.coalesce(1).write.mode("overwrite" if version is not None else "errorifexists").json(f"{self.path}/log/version={number}")
        except AnalysisException as e:
            if "PATH_ALREADY_EXISTS" in str(e):
                raise ConcurrentWrite(f"version {number} has another writer") from e
            raise
        if self._log().where((F.col("version") == number) & (F.col("writer") != writer)).limit(1).count():
            raise ConcurrentWrite(f"version {number} has another writer")
        return number

    def replace(self, rows: DataFrame, by: str | None = None) -> int:
        """Replace by document: the rows whose key (or column `by`, which must decide the bucket) is in rows go, and rows come."""
        by = by or self.key
        return self.change(rows, lambda old: old.join(rows.select(by).distinct(), by, "left_anti").unionByName(rows.select(*self.schema.names)))

    def delete(self, keys: DataFrame) -> int:
        return self.change(keys, lambda old: old.join(keys.select(self.key).distinct(), self.key, "left_anti"))
