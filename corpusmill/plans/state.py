"""Tables that change and streams with state: counters, the bounded cache, replacement by document, cascades through trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle as L
from ..operators.buckets import BucketTable
from ..scratch import Scratch
from ..streaming import cache, counters, jobs as J
from .base import query, table


@query("counters_by_changes", """SELECT user_id AS key, greatest(0, sum(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END))::BIGINT AS n, max(epoch_us(ts)) AS touched FROM events GROUP BY 1""")
def counters_by_changes(spark, d):
    """All events as a stream of additions and retractions, some batches of them."""
    scratch = Scratch(spark, "counters")
    kind = F.col("event_type")
    delta = F.when(kind == "view", 1).when(kind == "click", -1).otherwise(0)
    scratch.save(table(spark, d, "events").select(F.col("user_id").cast("long").alias("key"), delta.alias("delta"), F.col("ts").cast("timestamp").alias("ts")).repartition(3), "changes")
    schema = spark.read.parquet(scratch.path("changes")).schema
    kept = counters.counters(spark, scratch.path("table"), buckets=16)
    counters.follow(kept, J.stream_of(spark, scratch.path("changes"), schema, 1), scratch.path("checkpoint")).awaitTermination()
    return counters.read(kept).select("key", "n", F.unix_micros("touched_at").alias("touched"))


@query("semantic_cache_stream", """WITH r AS (SELECT vec_id, 'label ' || label AS scope FROM embeddings)
SELECT scope, vec_id AS request_id, NULL::BIGINT AS hit_id, NULL::DOUBLE AS score FROM r UNION ALL SELECT scope, vec_id + 1000000, vec_id, 1.0::DOUBLE FROM r""")
def semantic_cache_stream(spark, d):
    """Every vector as a request of its label's scope, an hour after the one before, and again twelve hours later; 0.92, a day and
    512 entries as in production. The SQL holds as no two vectors of these tables are that like."""
    scratch = Scratch(spark, "semantic-cache")
    first = table(spark, d, "embeddings").select(F.concat(F.lit("label "), F.col("label").cast("string")).alias("scope"), F.col("vec_id").cast("long").alias("request_id"), F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, 0, cast(vec_id as int), 0, 0)").alias("ts"), F.col("embedding").cast("array<double>").alias("embedding"))
    again = first.withColumn("request_id", F.col("request_id") + 1_000_000).withColumn("ts", F.expr("ts + interval 12 hours"))
    requests = first.union(again).withColumn("invalidate", F.lit(False))
    scratch.save(requests.repartitionByRange(2, "ts"), "requests")
    schema = spark.read.parquet(scratch.path("requests")).schema
    before = cache.use_state_store(spark)
    try:
        hits = cache.cached_requests(J.stream_of(spark, scratch.path("requests"), schema, 100))
        writer = hits.writeStream.format("parquet").option("path", scratch.path("out")).option("checkpointLocation", scratch.path("checkpoint")).outputMode("append")
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(cache.HITS).parquet(scratch.path("out"))


@query("replace_by_document", """SELECT l_orderkey AS doc_id, l_linenumber::INT AS chunk, l_partkey AS part FROM lineitem WHERE l_orderkey % 20 <> 0
UNION ALL SELECT l_orderkey, (100 + l_linenumber)::INT, l_suppkey FROM lineitem WHERE l_orderkey % 20 = 0 AND l_orderkey % 40 <> 0""")
def replace_by_document(spark, d):
    """Line items as the chunks of their orders: a twentieth of the orders get new chunks, and half of these then go."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("doc_id"), F.col("l_linenumber").cast("int").alias("chunk"), F.col("l_partkey").cast("long").alias("part"), F.col("l_suppkey").cast("long").alias("other"))
    chunks = BucketTable(spark, Scratch(spark, "chunks").path("t"), rows.drop("other").schema, "doc_id", 16)
    chunks.replace(rows)
    new = rows.where("doc_id % 20 = 0").select("doc_id", (F.col("chunk") + 100).alias("chunk"), F.col("other").alias("part"))
    chunks.replace(new)
    chunks.delete(new.where("doc_id % 40 = 0"))
    return chunks.read()


_TREE = """c AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber > 1 THEN l_orderkey * 10 + l_linenumber // 2 END AS parent_id FROM lineitem),
s AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_discount > 0.05)"""


@query("cascade_tree", f"WITH RECURSIVE {_TREE}, gone AS (SELECT id FROM s UNION SELECT c.id FROM c JOIN gone ON c.parent_id = gone.id) SELECT id, parent_id FROM c WHERE id NOT IN (SELECT id FROM gone)")
def cascade_tree(spark, d):
    """Line items as comments, the replies of line n being lines 2n and 2n + 1: some are deleted with all replies below them."""
    li, n = table(spark, d, "lineitem"), F.col("l_linenumber")
    key = F.col("l_orderkey") * 10
    comments = li.select((key + n).alias("id"), F.when(n > 1, key + F.floor(n / 2)).alias("parent_id")).distinct()
    gone = li.where("l_returnflag = 'R' AND l_linestatus = 'F' AND l_discount > 0.05").select((key + n).alias("id"))
    return L.cascaded_tree(comments, gone).select("id", "parent_id")
