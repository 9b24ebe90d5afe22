"""Each operator on odd rows and on an empty table."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import chat_rotation, cotraining, decontamination, host_rules, langid, merge_dropout, ppm, suffix_dedup, superminhash, url_gbt


def bench(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over the lazy"), (2, None), (3, ""), (4, "und die"), (4, "und die")], "item_id long, text string")


OPERATORS = {
    "op2": lambda s, d, l: cotraining.classify(d, l),
    "op3": lambda s, d, l: superminhash.group_near_duplicates(d, shingle=3, percent=85),
    "op4": lambda s, d, l: merge_dropout.encode(d),
    "op5": lambda s, d, l: langid.identify(d),
    "op6": lambda s, d, l: suffix_dedup.repeats(d, length=40),
    "op7": lambda s, d, l: ppm.score_documents(d),
    "op8": lambda s, d, l: host_rules.apply_host_rules(d),
    "op9": lambda s, d, l: decontamination.find_items(d, bench(s)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_empty_table(spark, odd, labels, name):
    rows = OPERATORS[name](spark, odd, labels).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in odd.collect())
    assert OPERATORS[name](spark, odd.limit(0), labels.limit(0)).collect() == []


def test_filters_keep_columns(spark, odd, labels):
    for f in (lambda d: cotraining.keep_good(d, labels), lambda d: superminhash.keep_one(d), lambda d: suffix_dedup.without_repeats(d, length=40), lambda d: decontamination.decontaminate(d, bench(spark))):
        out = f(odd)
        assert out.columns == odd.columns and f(odd.limit(0)).collect() == []
        assert out.count() <= odd.count()


def test_near_duplicates_of_odd_rows(spark, odd):
    rows = {str(r["doc_id"]): r for r in superminhash.group_near_duplicates(odd, shingle=3, percent=85).collect()}
    assert rows["7"]["component_id"] == 1 and not rows["7"]["kept"] and rows["6"]["component_id"] == 5
    assert rows["2"]["n_shingles"] == 0 and rows["2"]["kept"] and rows["3"]["component_id"] == 3 and rows["9"]["n_shingles"] == 1
    assert sorted(str(r["doc_id"]) for r in superminhash.keep_one(odd).collect()) == ["1", "2", "3", "4", "5", "8", "9", "None"]


def test_decontamination_of_odd_rows(spark, odd):
    found = {str(r["doc_id"]): r["items"] for r in decontamination.find_items(odd, bench(spark)).collect()}
    assert found["1"] == [1] and found["None"] == [4, 4] and found["5"] == []
    blocks = {str(r["doc_id"]): r["items"] for r in decontamination.find_items(odd, bench(spark), block_chars=8).collect()}
    assert blocks == found
    assert decontamination.find_items(odd, bench(spark).limit(0)).where("share > 0").isEmpty()


def test_languages_of_odd_rows(spark, odd):
    rows = {str(r["doc_id"]): r for r in langid.identify(odd).collect()}
    assert rows["2"]["lang_pred"] == "und" and rows["4"]["score"] == 0 and rows["1"]["lang_pred"] == "en"


def test_pipeline_stages(spark, tmp_path):
    """The stages chained by run() give what they give one by one; documents' columns stay until the last."""
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "minhash_dedup", "suffix_dedup", "decontamination", "sentencepiece"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, data)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns if i < 4 else "ids" in docs.columns
    assert sorted(map(str, corpus_pipeline.run(spark, data).collect())) == sorted(map(str, docs.collect()))
    assert docs.where("not lossless").isEmpty()
    assert corpus_pipeline.run(spark, data).count() > 100


@pytest.mark.parametrize("number", range(5))
def test_stages_on_odd_rows(spark, odd, number):
    name, stage = corpus_pipeline.STAGES[number]
    out = stage(spark, odd, "/root/testdata/sf0.001")
    rows = out.collect()
    assert len(rows) <= odd.count() and {str(r["doc_id"]) for r in rows} <= {str(r["doc_id"]) for r in odd.collect()}
    assert out.columns == odd.columns if number < 4 else all(r["lossless"] or r["ids"] is None for r in rows)
    assert stage(spark, odd.limit(0), "/root/testdata/sf0.001").collect() == []


def test_urls(spark):
    rows = [(1, None), (2, "nothing"), (3, "https://A.Example.org/es/x?q=/en/1"), (4, "http://example.org/en/13"), (5, "http://example.org/en/2"), (6, "http://x.com/fr/1"), (7, "http://x.com/de/"), (8, "http://x.net/de/1#f"), (9, "http://org"), (10, "http://badexample.org/es/"), (11, "http://org/")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit(1), "rule": F.lit(2), "label": F.lit(3)})
    got = {(r["page_id"], r["rule"]): r for r in url_gbt.filter_urls(df).collect()}
    assert len(got) == 11 and all(r["verdict"] in ("allow", "block") for r in got.values())
    assert got[(3, "example.org/es/")]["verdict"] == "block" and got[(3, "example.org/es/")]["host"] == "a.example.org"
    assert (4, "example.org/en/1") in got and (5, "org/") in got and (9, None) in got and (10, "org/") in got and (11, "org/") in got
    assert got[(1, None)]["host"] == "" and got[(2, None)]["path"] == ""
    assert url_gbt.filter_urls(df.limit(0)).collect() == []
    assert {r["verdict"] for r in url_gbt.filter_urls(df.where("page_id in (1, 6)")).collect()} == {"allow"}


def test_url_trees_learn(spark):
    """Labels that follow the number of digits and parameters are learned."""
    rows = [(i, f"http://h{i % 7}.net/p/{'9' * (12 if i % 3 == 0 else 1)}{'?a=1&b=2' if i % 3 == 0 else ''}", float(i % 3 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, label double")
    got = url_gbt.filter_urls(df, labels=df.where("page_id % 2 = 0")).join(df.select("page_id", "label"), "page_id").where("page_id % 2 = 1")
    assert got.where("(verdict = 'block') != (label = 1)").count() <= 4


def test_conversations(spark):
    rows = [(1, 0, "ann", "hi <|end|>"), (1, 1, "bob", "yo"), (1, 1, "bob", "yo"), (1, 2, None, None), (1, None, "", "x"), (2, 0, "system", "s"), (None, 3, "ann", "n")]
    rows += [(3, i, "ann" if i % 2 else "bob", f"t{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"seq": F.lit(1), "part": F.lit(1), "perspective": F.lit("q")})
    got = {(r["conv_id"], r["perspective"], r["part"]): r for r in chat_rotation.rotate(df).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (None, "ann", 0)} | {(3, p, k) for p in ("ann", "bob") for k in range(4)}
    ann = got[(1, "ann", 0)]
    assert ann["text"].startswith("<|assistant|>\nhi <\\|end|><|end|>\n<|user name=bob|>\nyo<|end|>\n") and ann["n_turns"] == 5 and ann["n_masked"] == 1
    for who in ("ann", "bob"):
        whole = "".join(got[(3, who, k)]["text"] for k in range(4))
        spans = [tuple(map(int, s.split("-"))) for k in range(4) for s in got[(3, who, k)]["mask_spans"].split(",")]
        assert [whole[a:b] for a, b in spans] == [f"t{i}<|end|>\n" for i in range(200) if ("ann" if i % 2 else "bob") == who]
        assert [got[(3, who, k)]["char_start"] for k in range(4)] == [sum(len(got[(3, who, j)]["text"]) for j in range(k)) for k in range(4)]
    assert chat_rotation.rotate(df.limit(0)).collect() == []


def test_urls_that_repeat(spark):
    """A URL that repeats does not fill the sample, and suffixes outside the sample have their rates."""
    urls = [f"https://{'bad' if i % 2 else 'good'}.net/{'x' * (i % 7)}/{i}" for i in range(200)]
    df = spark.createDataFrame([(u, int("bad" in u)) for u in urls], "url string, label int")
    first = df.orderBy(F.xxhash64("url")).first()
    labels = df.union(spark.createDataFrame([tuple(first)] * 300, df.schema))
    asked = spark.createDataFrame([(1, "https://bad.net/new"), (2, "https://good.net/new")], "page_id int, url string")
    got = {r["page_id"]: r["verdict"] for r in url_gbt.filter_urls(asked, labels=labels, max_train=100).collect()}
    assert got == {1: "block", 2: "allow"}
    known = spark.createDataFrame([("https://a.net/", "a.net", "/", 3, 3.0), ("https://b.net/", "b.net", "/", 2, 0.0)], "url string, host string, path string, n long, blocked double")
    rates = {(r["kind"], r["suffix"]): r["rate"] for r in url_gbt.suffix_rates(url_gbt.with_features(known)).collect()}
    assert rates["domain", "a.net"] == 13 / 23 and rates["domain", "b.net"] == 10 / 22 and rates["tld", "net"] == 13 / 25
