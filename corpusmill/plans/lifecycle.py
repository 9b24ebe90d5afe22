"""Queries over versions, upserts, queues, states and limits. Events are the changes, their users the keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle as L
from ..sources import readers as R
from ..streaming import jobs as J
from .base import query, table


def events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("upsert_latest", """WITH c AS (SELECT user_id, event_id, value FROM events WHERE event_type <> 'purchase'), n AS (SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE event_type = 'purchase') WHERE k = 1)
SELECT * FROM c WHERE user_id NOT IN (SELECT user_id FROM n) UNION ALL SELECT * FROM n""")
def upsert_latest(spark, d):
    e = table(spark, d, "events")
    columns = ["user_id", "event_id", "value"]
    return L.upserted(e.where("event_type <> 'purchase'").select(columns), e.where("event_type = 'purchase'").select(columns), ["user_id"], F.desc("event_id"))


@query("insert_if_absent", "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def insert_if_absent(spark, d):
    return L.inserted(table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@query("update_where", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS status FROM orders")
def update_where(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return L.updated(o, F.col("status") == "P", {"status": F.lit("F")})


@query("delete_by_keys", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def delete_by_keys(spark, d):
    gone = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return L.deleted(table(spark, d, "orders"), gone, ["o_custkey"]).select("o_orderkey")


@query("cascade_delete", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') GROUP BY 1, 2")
def cascade_delete(spark, d):
    left = L.cascaded(table(spark, d, "lineitem"), table(spark, d, "orders").where("o_orderstatus <> 'F'"), "l_orderkey", "o_orderkey")
    return left.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("novelty_anti_join", "SELECT doc_id FROM documents a WHERE source <> 'src0' AND NOT EXISTS (SELECT 1 FROM documents b WHERE b.source = 'src0' AND b.lang = a.lang AND sha256(b.text) = sha256(a.text))")
def novelty_anti_join(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", "lang", F.sha2("text", 256).alias("content_hash"))
    return L.novel(rows.where("source <> 'src0'"), rows.where("source = 'src0'"), "lang").select("doc_id")


@query("stale_difference", "SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events)")
def stale_difference(spark, d):
    return L.stale(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), events(spark, d).select(F.col("user_id").alias("k")), "k")


@query("within_batch_dedup", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256(text)")
def within_batch_dedup(spark, d):
    return L.first_of_batch(table(spark, d, "documents").withColumn("h", F.sha2("text", 256)), ["h"], "doc_id").select("doc_id")


@query("supersede_versions", """SELECT event_id, v = m AS is_current, CASE WHEN v <> m THEN m END AS superseded_by FROM (SELECT event_id, event_id % 4 AS v, max(event_id % 4) OVER (PARTITION BY user_id) AS m FROM events)""")
def supersede_versions(spark, d):
    rows = events(spark, d).select("event_id", F.col("user_id").alias("guideline_id"), (F.col("event_id") % 4).alias("version"))
    return L.superseded(rows).select("event_id", "is_current", "superseded_by")


@query("work_queue", "SELECT event_id AS doc_id FROM events WHERE event_type = 'error' AND user_id % 5 < 3 ORDER BY value, event_id LIMIT 30")
def work_queue(spark, d):
    docs = events(spark, d).select(F.col("event_id").alias("doc_id"), F.when(F.col("event_type") == "error", "failed").otherwise("pending").alias("status"), (F.col("user_id") % 5).alias("retry_count"), F.col("value").alias("file_size"))
    return L.queue(docs, "failed", 30).select("doc_id")


@query("state_moves", """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus = 'P' THEN 'fetched' WHEN o_orderkey % 3 = 1 AND o_orderstatus IN ('P', 'O') THEN 'failed' ELSE CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'O' THEN 'chunked' ELSE 'complete' END END AS status,
 CASE WHEN o_orderkey % 3 = 1 AND o_orderstatus IN ('P', 'O') THEN 1 ELSE 0 END AS retry_count FROM orders""")
def state_moves(spark, d):
    k = F.col("o_orderkey")
    docs = table(spark, d, "orders").select(k.alias("doc_id"), F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "O", "chunked").otherwise("complete").alias("status"), F.lit(0).alias("retry_count"))
    results = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "fetched").when(F.col("doc_id") % 3 == 1, "failed").alias("to")).where("to is not null")
    return L.moved(docs, results).select("doc_id", "status", "retry_count")


@query("attempts_left", "SELECT user_id || '/' || ts::DATE AS doc_id, count(*) AS attempts FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) < 3")
def attempts_left(spark, d):
    return L.attempts_left(events(spark, d).where("event_type = 'error'").select(F.concat_ws("/", "user_id", F.to_date("ts").cast("string")).alias("doc_id")))


@query("constraint_quarantine", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 40 THEN '' ELSE 'quantity' END || CASE WHEN l_discount < 0.09 THEN '' ELSE '+discount' END AS broken FROM lineitem WHERE NOT (l_quantity <= 40 AND l_discount < 0.09)")
def constraint_quarantine(spark, d):
    _, bad = L.quarantined(table(spark, d, "lineitem"), {"quantity": F.col("l_quantity") <= 40, "+discount": F.col("l_discount") < 0.09})
    return bad.select("l_orderkey", "l_linenumber", F.array_join("broken", "").alias("broken"))


@query("json_merge", """SELECT event_id, (props->>'k') AS k, 'done' AS status FROM events""")
def json_merge(spark, d):
    merged = L.merged_json(F.col("props"), F.to_json(F.create_map(F.lit("status"), F.lit("done"))))
    return events(spark, d).select("event_id", F.get_json_object(merged, "$.k").alias("k"), F.get_json_object(merged, "$.status").alias("status"))


@query("sharded_paths", "SELECT doc_id, 'raw/' || sha256(text)[1:2] || '/' || sha256(text) || '.txt' AS path FROM documents")
def sharded_paths(spark, d):
    return table(spark, d, "documents").select("doc_id", L.sharded_path(F.sha2("text", 256), "raw", "txt").alias("path"))


@query("rate_limit_window", "SELECT event_id, place, place <= 15 AS allowed FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) AS place FROM (SELECT event_id, user_id, TIMESTAMP '2024-01-01' + to_seconds(event_id * 7 % 180) AS ts FROM events))")
def rate_limit_window(spark, d):
    """Events as requests within three minutes, fifteen a minute for each user."""
    ts = F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, event_id * 7 % 180)")
    return J.rate_limited(events(spark, d).withColumn("ts", ts)).select("event_id", "place", "allowed")


@query("window_counts", "SELECT event_type, date_trunc('hour', ts)::VARCHAR AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def window_counts(spark, d):
    return J.event_counts(events(spark, d)).select("event_type", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n")


@query("polling_batch", "SELECT event_type, count(*) AS n, sum((value > 50)::INT)::BIGINT AS large FROM events GROUP BY 1")
def polling_batch(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("large"))


@query("sse_assemble", "SELECT conv_id * 1000 + turn AS stream_id, text AS answer FROM conversations WHERE length(text) > 0")
def sse_assemble(spark, d):
    answers = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("stream_id"), F.col("text").alias("answer"))
    return J.answers_of(J.token_events(answers))


@query("sse_parse", r"""WITH p AS (SELECT conv_id, turn, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS t, len(w) AS n FROM (SELECT conv_id, turn, string_split(text, '. ') AS w FROM conversations))
SELECT conv_id, turn, i - 1 AS k, CASE WHEN i % 5 = 0 THEN 'citations' ELSE 'token' END AS event, t AS data FROM p WHERE i % 7 <> 0 AND i % 11 <> 0 AND i % 13 <> 0 AND NOT (i = n AND turn % 2 = 1)""")
def sse_parse(spark, d):
    """The sentences of every text as a stream of events: some lack the event's line, some have data that is not JSON, some have
    none, and every other stream breaks off in its last block."""
    p = table(spark, d, "conversations").select("conv_id", "turn", F.split("text", "\\. ").alias("w"))

    def block(t, i):
        k = i + 1
        name = F.when(k % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("event: "), F.when(k % 5 == 0, "citations").otherwise("token"), F.lit("\n")))
        data = F.when(k % 11 == 0, F.lit('data: {"t":')).when(k % 13 == 0, F.lit("retry: 3")).otherwise(F.concat(F.lit("data: "), F.to_json(F.struct(i.alias("k"), t.alias("t")))))
        return F.concat(name, data)

    text = F.concat(F.array_join(F.transform("w", block), "\n\n"), F.when(F.col("turn") % 2 == 0, F.lit("\n\n")).otherwise(""))
    found = p.select("conv_id", "turn", F.explode(R.event_blocks(text)).alias("e"))
    value = F.from_json("e.data", "k long, t string")
    return found.select("conv_id", "turn", value["k"].alias("k"), "e.event", value["t"].alias("data"))


@query("failed_share", "SELECT l_orderkey AS doc_id, count(*) AS rows, count(*) FILTER (WHERE l_quantity >= 40) AS bad, count(*) FILTER (WHERE l_quantity >= 40) > count(*) * 0.3 AS failed FROM lineitem GROUP BY 1")
def failed_share(spark, d):
    return J.failed_share(table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "doc_id"), F.col("l_quantity") < 40)


@query("not_processed", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def not_processed(spark, d):
    return R.not_done(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("seeded_sample", "SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM benchmark WHERE length(text) < 200) ORDER BY md5(item_id || ',11'), item_id LIMIT 20")
def seeded_sample(spark, d):
    """A sampling operator: 20 items that were not seen, in the order of a seeded random number."""
    seen = table(spark, d, "benchmark").where("length(text) < 200").select("item_id")
    return table(spark, d, "benchmark").join(seen, "item_id", "left_anti").orderBy(F.md5(F.concat_ws(",", F.col("item_id").cast("string"), F.lit("11")).cast("binary")), "item_id").limit(20).select("item_id")
