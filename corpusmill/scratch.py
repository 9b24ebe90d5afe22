"""Tables that cut lineage: Parquet in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir where it is set; else a temporary folder in local mode, and the warehouse on a cluster."""
    if folder := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return folder.rstrip("/")
    conf = spark.sparkContext.getConf()
    if conf.get("spark.master", "").startswith("local[") or conf.get("spark.master", "") == "local":
        if not hasattr(shared_folder, "local"):
            shared_folder.local = tempfile.mkdtemp(prefix="corpusmill-")
            atexit.register(shutil.rmtree, shared_folder.local, ignore_errors=True)
        return f"file://{shared_folder.local}"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


_LEFT: list[str] = []


def _delete(path: str) -> None:
    context = SparkContext._active_spark_context
    if context is not None and context._jsc is not None:
        p = context._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _delete_left() -> None:
    while _LEFT:
        with contextlib.suppress(Exception):  # the JVM may have ended before
            _delete(_LEFT.pop())


class Scratch:
    """A folder for one call of an operator. What the returned DataFrame reads must stay; drop() frees the rest early."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, label: str) -> str:
        """A path below the folder, for other writers than save()."""
        if self.root not in _LEFT:
            _LEFT.append(self.root)
        return f"{self.root}/{label}"

    def save(self, df: DataFrame, label: str) -> DataFrame:
        """Write df and read it back: lost executors no longer matter, and its size is known to the planner. What is left of a
        session's folders goes when the driver's Python ends."""
        path = self.path(label)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Spark frees shuffle files when the driver's JVM collects its garbage, which may be long after their last use."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *labels: str) -> None:
        for label in labels:
            _delete(f"{self.root}/{label}")


def kept(df: DataFrame, path: str) -> DataFrame:
    """Write df where the caller wants it and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch of wide rows, to which its last row comes; a Python worker holds two batches.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """What is written within goes to Python workers in batches of BATCH_BYTES, where Spark's own limit is 64 MB: it fills with wide
    rows as a table grows. The setting is read when a plan runs, so a table that is only described within gets the session's."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


#: Of a list in an executor's memory, with ROW_BYTES for each row beside its values.
BROADCAST_BYTES = 24 << 20
ROW_BYTES = 64


def sized(rows: DataFrame) -> DataFrame:
    """A saved table, to be broadcast where all of its rows, weighed as text, have BROADCAST_BYTES at most; a larger one meets the
    other side in a shuffle."""
    weight = rows.select((F.lit(ROW_BYTES) + F.coalesce(F.octet_length(F.to_json(F.struct("*"))), F.lit(0))).cast("long").alias("w")).agg(F.sum("w")).first()[0]
    return F.broadcast(rows) if (weight or 0) <= BROADCAST_BYTES else rows


_BUILT: dict = {}


def once(spark: SparkSession, key: tuple, build):
    """What build() gives, built once a session for a key: an index over a table that several searches read."""
    mine = (spark.sparkContext.applicationId, *key)
    if mine not in _BUILT:
        _BUILT[mine] = build()
    return _BUILT[mine]
