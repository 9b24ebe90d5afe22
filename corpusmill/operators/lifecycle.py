"""Versions of a corpus: novelty, upserts, supersession, staleness, deletion, states of work, as set operations on snapshots.

There is no table format in a plain Spark, so a table is a folder of snapshots and a log of them; a change reads the newest
snapshot, writes the next and appends it to the log, so a lost executor or a repeated run leaves a whole state."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..scratch import Scratch

#: Allowed moves of a document's state.
MOVES = {"pending": ["fetched", "failed"], "fetched": ["extracted", "failed"], "extracted": ["chunked", "failed"], "chunked": ["complete", "failed"], "failed": ["pending"], "complete": []}
MOST_RETRIES = 3


class ConcurrentChange(RuntimeError):
    """Another writer has published a snapshot since the one that was read."""


class SnapshotTable:
    """A folder of Parquet snapshots and a log of them. A change writes its snapshot, then appends one line to the log: nothing is
    replaced or deleted, so a crash leaves the state before or after. Of two writers that publish the same number, the one whose
    snapshot has the lesser name stands, and the other gets ConcurrentChange."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _log(self) -> DataFrame:
        return self.spark.read.schema("number long, name string").json(f"{self.path}/log")

    def _newest(self):
        return self._log().orderBy(F.desc("number"), "name").first()

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self._newest()['name']}")

    def write(self, df: DataFrame, partition_by: list[str] | None = None, *, after: int = -1) -> None:
        """after: the number of the snapshot that df was made from; -1 for a table's first."""
        name = f"v-{uuid.uuid4().hex}"
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(f"{self.path}/{name}")
        self.spark.createDataFrame([(after + 1, name)], "number long, name string").coalesce(1).write.mode("append").json(f"{self.path}/log")
        if (last := self._newest())["number"] != after + 1 or last["name"] != name:
            raise ConcurrentChange(f"{last['name']} is newer than number {after}")

    def change(self, make, partition_by: list[str] | None = None) -> None:
        """Publish make(current)."""
        last = self._newest()
        self.write(make(self.spark.read.parquet(f"{self.path}/{last['name']}")), partition_by, after=last["number"])

    def upsert(self, rows: DataFrame, keys: list[str], order: Column) -> None:
        self.change(lambda current: upserted(current, rows, keys, order))


def newest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def upserted(current: DataFrame, rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Last write wins: new rows replace those of the same key; of several new rows the first by order."""
    new = newest(rows, keys, order)
    return current.join(new.select(*keys), keys, "left_anti").unionByName(new)


def inserted(current: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Insert if absent."""
    return current.unionByName(rows.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti"))


def updated(current: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    return current.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def deleted(current: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return current.join(gone.select(*keys).distinct(), keys, "left_anti")


def cascaded(children: DataFrame, parents_left: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent is left; null parents stay."""
    left = parents_left.select(F.col(parent_key).alias(child_key)).distinct()
    return children.where(F.col(child_key).isNull()).unionByName(children.join(left, child_key, "left_semi").select(*children.columns))


def cascaded_tree(rows: DataFrame, gone: DataFrame, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """rows without the gone ones and all that is below them, through any number of levels. rows: key (unique) and parent.

    Every row looks up at its parent, and in each round at twice the distance, until it has met a gone row or its root; so the
    rounds, each a join of written tables, grow with the logarithm of the deepest path. A parent that is not in rows is a root;
    rows on a cycle go if one of it is gone."""
    scratch = Scratch(rows.sparkSession, "cascade")
    out = gone.select(F.col(key).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    state = rows.select(F.col(key).alias("_k"), F.col(parent).alias("_far")).where("_k is not null").join(out, "_k", "left").select("_k", "_far", F.coalesce("_hit", F.lit(False)).alias("_hit"))
    state = scratch.save(state, "0")
    for turn in range(1, max(1, state.count()).bit_length() + 1):
        above = state.select(F.col("_k").alias("_far"), F.col("_far").alias("_next"), F.col("_hit").alias("_above"))
        settled = state.where("_hit or _far is null")
        looked = state.where("not _hit and _far is not null").join(above, "_far", "left").select("_k", F.col("_next").alias("_far"), F.coalesce("_above", F.lit(False)).alias("_hit"))
        state = scratch.save(settled.union(looked), str(turn))
        if state.where("not _hit and _far is not null").isEmpty():
            break
    return rows.join(state.where("_hit").select(F.col("_k").alias(key)), key, "left_anti")


def novel(rows: DataFrame, existing: DataFrame, scope: str, digest: str = "content_hash") -> DataFrame:
    """Rows whose hash their own document does not have yet; a missing hash is novel."""
    return rows.join(existing.where(F.col(digest).isNotNull()).select(scope, digest).distinct(), [scope, digest], "left_anti")


def stale(existing: DataFrame, current: DataFrame, key: str) -> DataFrame:
    return existing.select(key).distinct().join(current.select(key), key, "left_anti")


def first_of_batch(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return newest(rows, keys, F.col(order).asc())


def superseded(chunks: DataFrame, key: str = "guideline_id", version: str = "version") -> DataFrame:
    """is_current and superseded_by from the greatest version of each document, in whatever order versions came."""
    last = chunks.groupBy(key).agg(F.max(version).alias("_last"))
    rows = chunks.join(last, key)
    return rows.withColumns({"is_current": F.col(version) == F.col("_last"), "superseded_by": F.when(F.col(version) != F.col("_last"), F.col("_last"))}).drop("_last")


def queue(documents: DataFrame, status: str, limit: int, order: str = "file_size") -> DataFrame:
    """Work of a status, smallest first; failed work only below MOST_RETRIES."""
    rows = documents.where(F.col("status") == status)
    rows = rows.where(F.coalesce("retry_count", F.lit(0)) < MOST_RETRIES) if status == "failed" else rows
    return rows.orderBy(order, "doc_id").limit(limit)


def moved(documents: DataFrame, results: DataFrame) -> DataFrame:
    """States after results (doc_id, to): only allowed moves happen, a failure counts one retry."""
    allowed = F.create_map(*[x for k, v in MOVES.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    rows = documents.join(results.select("doc_id", "to"), "doc_id", "left")
    ok = F.coalesce(F.array_contains(F.try_element_at(allowed, F.col("status")), F.col("to")), F.lit(False))
    return rows.withColumns({"retry_count": F.col("retry_count") + (ok & (F.col("to") == "failed")).cast("int"), "status": F.when(ok, F.col("to")).otherwise(F.col("status"))}).drop("to")


def attempts_left(attempts: DataFrame) -> DataFrame:
    """Documents that may be tried again: attempts are logged before the work, so crashes count."""
    return attempts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("attempts")).where(F.col("attempts") < MOST_RETRIES)


def quarantined(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rows with the names of the checks they fail). A check that is null passes, as in SQL."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    marked = rows.withColumn("broken", broken)
    return marked.where(F.size("broken") == 0).drop("broken"), marked.where(F.size("broken") > 0)


def merged_json(current: Column, changes: Column) -> Column:
    """Two JSON objects of strings as one; the second's keys win."""
    kind = "map<string,string>"
    old, new = F.coalesce(F.from_json(current, kind), F.create_map().cast(kind)), F.coalesce(F.from_json(changes, kind), F.create_map().cast(kind))
    return F.to_json(F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new))


def sharded_path(digest: Column, folder: str, extension: str) -> Column:
    return F.concat(F.lit(folder + "/"), F.substring(digest, 1, 2), F.lit("/"), digest, F.lit("." + extension))
