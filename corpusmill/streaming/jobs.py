"""Streaming jobs: queue workers, rate limits, token reassembly, counters and caches as Structured Streaming queries.

Each function takes a streaming (or plain) DataFrame, so that a test can hold a stream against the same rows as a batch."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import lifecycle as L


def stream_of(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """Files of a folder as a stream; a batch takes files_per_batch of them."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def event_counts(events: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """Events of each type and window, late rows up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def request_counts(events: DataFrame, limit: int = 15, late: str = "5 minutes") -> DataFrame:
    """Requests of a user in a minute, and how many of them pass the limit's gate."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", "1 minute"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("user_id", F.col("window.start").alias("minute"), "n", F.least(F.col("n"), F.lit(limit)).alias("allowed"))


def rate_limited(events: DataFrame, limit: int = 15) -> DataFrame:
    """Batch form: each request with its place in its user's minute and whether it passes."""
    w = W.partitionBy("user_id", F.date_trunc("minute", "ts")).orderBy("ts", "event_id")
    return events.withColumn("place", F.row_number().over(w)).withColumn("allowed", F.col("place") <= limit)


def answers_of(tokens: DataFrame) -> DataFrame:
    """One text for each stream from its token events, in the order of seq."""
    own = tokens.where("event = 'token'").groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("seq", "data"))).alias("t"))
    return own.select("stream_id", F.array_join(F.transform("t", lambda x: x["data"]), "").alias("answer"))


def token_events(answers: DataFrame, size: int = 8) -> DataFrame:
    """An answer as token events of `size` characters, then a done event."""
    starts = F.when(F.length("answer") > 0, F.sequence(F.lit(1), F.length("answer"), F.lit(size))).otherwise(F.array().cast("array<int>"))
    rows = answers.select("stream_id", F.posexplode(F.transform(starts, lambda i: F.substring("answer", i, F.lit(size)))).alias("seq", "data")).withColumn("event", F.lit("token"))
    done = answers.select("stream_id", F.size(starts).alias("seq"), F.lit("").alias("data"), F.lit("done").alias("event"))
    return rows.unionByName(done)


def last_seen(events: DataFrame, ttl_seconds: int = 300) -> DataFrame:
    """A keyed cache with a time to live: the last value of each user and whether it came while the one before was alive."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, at = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event, ts, new in zip(rows["event_id"], rows["ts"], rows["value"], strict=True):
            out.append((key[0], event, bool(at is not None and (ts.timestamp() - at) <= ttl_seconds), value))
            value, at = float(new), ts.timestamp()
        state.update((value, at))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "hit", "cached"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, hit boolean, cached double", "value double, at double", "append", GroupStateTimeout.NoTimeout)


def work(spark: SparkSession, jobs: DataFrame, done: L.SnapshotTable, stage: Callable[[DataFrame], DataFrame], checkpoint: str, every: str | None = None):
    """A queue worker: each batch of new jobs goes through the stage and is upserted by doc_id, so a batch that runs again
    changes nothing. Runs what is there and ends, or every so often."""

    def batch(rows: DataFrame, number: int) -> None:
        done.upsert(stage(rows).withColumn("batch", F.lit(number)), ["doc_id"], F.col("batch").desc())

    writer = jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def run_for(query: StreamingQuery, seconds: float) -> bool:
    """A time guard: after so many seconds the batch at hand is let finish and the query ends; what is left waits for the next
    start. Returns whether the query had ended by itself."""
    end = time.monotonic() + seconds
    while query.isActive:
        if time.monotonic() >= end and not query.status["isTriggerActive"]:
            query.stop()
            return False
        query.awaitTermination(0.2)
    return True


def failed_share(rows: DataFrame, ok: Column, most: float = 0.3) -> DataFrame:
    """Documents whose share of bad rows is above `most`, with the counts."""
    counted = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(~ok).alias("bad"))
    return counted.withColumn("failed", F.col("bad") > F.col("rows") * most)
