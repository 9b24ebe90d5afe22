"""Tables that change, streams with state, cascades and SQL table functions against plain restatements."""

import datetime as dt
import random
from pathlib import Path

import pytest
from corpusmill.functions import tables
from corpusmill.operators import lifecycle as L, vectors as Vc
from corpusmill.operators.buckets import BucketTable, ConcurrentWrite
from corpusmill.streaming import cache, counters, jobs as J
from pyspark.sql import functions as F, types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("chunk", T.IntegerType()), T.StructField("text", T.StringType())])


def rows_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_replace_touches_only_its_buckets(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "t"), SCHEMA, "doc_id", 8)
    assert t.version() == -1 and t.read().collect() == []
    rows = [(i, c, f"{i}-{c}") for i in range(40) for c in range(3)] + [(None, 0, "null")]
    assert t.replace(rows_of(spark, rows)) == 0
    before = {p: p.stat().st_mtime_ns for p in Path(tmp_path).rglob("*.parquet")}
    assert t.replace(rows_of(spark, [(5, 9, "new")])) == 1
    want = [r for r in rows if r[0] != 5] + [(5, 9, "new")]
    assert sorted(map(str, map(tuple, t.read().collect()))) == sorted(map(str, want))
    assert all(p.stat().st_mtime_ns == m for p, m in before.items())
    assert len(set(Path(tmp_path).rglob("*.parquet")) - set(before)) == 1
    assert sorted(map(str, map(tuple, t.read(0).collect()))) == sorted(map(str, rows))  # the version before is still there
    t.delete(rows_of(spark, rows).select("doc_id"))
    assert [tuple(r) for r in t.read().collect()] == [(None, 0, "null")]  # a null is no key that is deleted


def test_a_failure_leaves_the_state_before(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "t"), SCHEMA, "doc_id", 4)
    t.replace(rows_of(spark, [(i, 0, "a") for i in range(20)]))
    state = sorted(map(tuple, t.read().collect()))
    broken = F.udf(lambda x: 1 // (x - 7), "int")
    with pytest.raises(Exception, match="division"):
        t.change(rows_of(spark, [(i, 0, "") for i in range(20)]).select("doc_id"), lambda old: old.withColumn("chunk", broken("doc_id")))
    assert t.version() == 0 and sorted(map(tuple, t.read().collect())) == state
    t.replace(rows_of(spark, [(7, 1, "b")]))
    assert (7, 1, "b") in set(map(tuple, t.read().collect())) and t.version() == 1


def test_a_second_writer_fails(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "t"), SCHEMA, "doc_id", 4)
    t.replace(rows_of(spark, [(1, 0, "a")]))

    def slow(old):
        BucketTable(spark, t.path, SCHEMA, "doc_id", 4).replace(rows_of(spark, [(1, 1, "other")]))
        return old

    with pytest.raises(ConcurrentWrite):
        t.change(rows_of(spark, [(1, 0, "")]).select("doc_id"), slow)
    assert [tuple(r) for r in t.read().collect()] == [(1, 1, "other")]


def test_counters_take_a_batch_once(spark, tmp_path):
    rng = random.Random(2)
    batches = [[(rng.choice([1, 2, 3, None, 50]), rng.choice([1, -1, 1, None]), dt.datetime(2024, 1, 1 + b, i % 24)) for i in range(30)] for b in range(3)]
    table = counters.counters(spark, str(tmp_path / "c"), buckets=4)
    frames = [spark.createDataFrame(b, "key long, delta int, ts timestamp") for b in batches]
    for n, f in enumerate(frames):
        counters.apply(table, f, n)
    want = {}
    for key, delta, ts in sum(batches, []):
        n, at = want.get(key, (0, ts))
        want[key] = (n + (delta or 0), max(at, ts))
    shown = lambda: {r["key"]: (r["n"], r["touched_at"]) for r in counters.read(table).collect()}
    assert shown() == {k: (max(0, n), at) for k, (n, at) in want.items()}
    counters.apply(table, frames[2], 2)  # the batch comes again
    assert shown() == {k: (max(0, n), at) for k, (n, at) in want.items()}


def replay(requests, least, ttl_ms, most):
    held, out = {}, []
    likeness = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5), 6)
    for scope, request, ts, vector, invalidate in sorted(requests, key=lambda r: (r[2], r[1])):
        if invalidate:
            held[scope] = []
            continue
        at = int(ts.timestamp() * 1000)
        alive = [e for e in held.get(scope, []) if at - e[1] <= ttl_ms]
        best = max(((likeness(vector, e[2]), -i, e[0]) for i, e in enumerate(alive) if likeness(vector, e[2]) >= least), default=None)
        out.append((scope, request, best and best[2], best and best[0]))
        held[scope] = alive if best else [*alive, (request, at, vector)][-most:]
    return sorted(out, key=str)


def test_cache_stream_is_its_replay(spark, tmp_path):
    """Hits, ends of life, first in first out beyond the bound, and invalidations, over several batches."""
    rng = random.Random(9)
    base = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(12)]
    requests = [(f"s{i % 2}", i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i + (600 if i > 100 else 0)), [x + rng.gauss(0, 0.01) for x in rng.choice(base)], i % 47 == 46) for i in range(160)]
    schema = "scope string, request_id long, ts timestamp, embedding array<double>, invalidate boolean"
    for n in range(4):
        spark.createDataFrame(requests[40 * n : 40 * n + 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = cache.use_state_store(spark)
    try:
        stream = cache.cached_requests(J.stream_of(spark, str(tmp_path / "in"), T.StructType.fromDDL(schema), 1), least=0.98, ttl_ms=3 * 3_600_000, most=4)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    want = replay(requests, 0.98, 3 * 3_600_000, 4)
    got = sorted(((r["scope"], r["request_id"], r["hit_id"], r["score"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert sum(g[2] is not None for g in got) > 20 and any(g[2] is None for g in got)


def test_cascade_through_a_tree(spark):
    rng = random.Random(1)
    parent = {i: (rng.randint(0, i - 1) if i % 10 else None) for i in range(1, 200)} | {0: None, 500: 999, 601: 602, 602: 601}
    parent |= {1000 + i: (999 + i if i else 5) for i in range(70)}  # a chain of seventy
    gone = {3, 30, 1010, 602, 12345}
    below = lambda i, seen=(): i in gone or (parent.get(i) is not None and parent[i] not in seen and parent[i] in parent and below(parent[i], (*seen, i)))
    rows = spark.createDataFrame(list(parent.items()), "id long, parent_id long").withColumn("_hit", F.lit(1)).repartition(3)
    left = L.cascaded_tree(rows, spark.createDataFrame([(g,) for g in gone] + [(3,)], "id long"))
    assert sorted(r["id"] for r in left.collect()) == sorted(i for i in parent if not below(i))
    assert left.columns == rows.columns and L.cascaded_tree(rows.limit(0), rows.select("id")).collect() == []


def test_parameters_reach_the_scan(spark, tmp_path):
    data = "/root/testdata/sf0.001"
    spark.read.parquet(f"{data}/events.parquet").select(F.col("event_id").alias("id"), F.col("user_id").alias("conversation_id"), F.lit(0).alias("depth")).write.parquet(str(tmp_path / "paths"))
    tables.register(spark, paths=spark.read.parquet(str(tmp_path / "paths")))
    plan = spark.sql("SELECT * FROM get_active_path(7)")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(conversation_id,7)" in plan


def test_time_guard(spark, tmp_path):
    """A worker that would wait for ever ends between batches; the next start goes on from there."""
    spark.range(5).write.parquet(str(tmp_path / "in"))
    start = lambda **t: spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(**t).start()
    assert J.run_for(start(processingTime="200 milliseconds"), 6) is False
    spark.range(5, 8).write.mode("append").parquet(str(tmp_path / "in"))
    assert J.run_for(start(availableNow=True), 60) is True
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(8))


def test_vectors_match_in_blocks(spark, monkeypatch):
    """A table of vectors gives in blocks what each gives alone; zero vectors and those with a null or of another length match nothing."""
    monkeypatch.setattr(Vc, "CHUNK_BYTES", 8 * 3 * 7)
    monkeypatch.setattr(Vc, "BLOCK", 4)
    monkeypatch.setattr(Vc, "REACHED", 3, raising=False)
    rng = random.Random(8)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(60)], "id long, embedding array<double>")
    odd = spark.createDataFrame([(90, [0.0, 0.0, 0.0]), (91, [1.0, None, 2.0]), (92, [1.0]), (93, None)], "id long, embedding array<double>")
    every = v.union(odd)
    tables.register(spark, vectors=v, likeness=Vc.reaching(every, every.where("id % 5 = 0 or id > 89").withColumnRenamed("id", "query_id"), 0.3))
    alone = "SELECT q.id AS query_id, f.id, f.similarity FROM (SELECT * FROM mill_vectors WHERE id % 5 = 0) q, LATERAL match_documents(q.embedding, {0}D) f"
    for floor in (0.3, 0.6):
        got = sorted(map(tuple, spark.sql(f"SELECT query_id, id, similarity FROM match_each({floor}D)").collect()))
        want = sorted(map(tuple, spark.sql(alone.format(floor)).collect()))
        assert len(want) > 100
        assert [r for r in got if r[:2] != (92, 92)] == want and ((92, 92, 1.0) in got)
