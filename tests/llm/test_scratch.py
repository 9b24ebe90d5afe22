from types import SimpleNamespace

from corpusmill.llm import scratch


def test_folder_comes_from_the_session(spark):
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: "hdfs://x/shared/"))
    assert scratch.shared_folder(named) == "hdfs://x/shared"
    local = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(getConf=lambda: {"spark.master": "local[2]"}, getCheckpointDir=lambda: None))
    assert "corpusmill-" in scratch.shared_folder(local)
    cluster = SimpleNamespace(getConf=lambda: {"spark.master": "yarn"}, getCheckpointDir=lambda: None)
    unnamed = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: {"spark.sql.warehouse.dir": "hdfs://w"}.get(key, default)), sparkContext=cluster)
    assert scratch.shared_folder(unnamed) == "hdfs://w/_scratch"


def test_saved_and_dropped(spark):
    s = scratch.Scratch(spark, "t")
    assert s.save(spark.range(3), "a").count() == 3
    s.drop("a", "missing")


def test_sized(spark, monkeypatch):
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", 2 * (scratch.ROW_BYTES + 8))
    few, many = spark.range(2), spark.range(3)
    plan = lambda df: spark.range(9).join(scratch.sized(df), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(few) and "broadcast" not in plan(many)


def test_weight_of_values(spark, monkeypatch):
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", 200)
    assert scratch.fits(spark.createDataFrame([("x",)], "t string")) and not scratch.fits(spark.createDataFrame([("x" * 200,)], "t string"))
    lists = lambda n: spark.createDataFrame([(1, [(2, True)] * n)], "ref long, runs array<struct<a: long, b: boolean>>")
    assert scratch.fits(lists(1)) and not scratch.fits(lists(20)) and scratch.fits(spark.createDataFrame([(None,)], "t string"))
