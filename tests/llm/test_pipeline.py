"""The pipeline's stages, with their own parameters, against restatements in plain Python; URL rules and features against SQL."""

import math
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import merge_dropout, queries, url_gbt

from plain import LOWER, WORD, components_of

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def pairs_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_minhash_stage(spark, docs):
    got = sorted(r["doc_id"] for r in corpus_pipeline.minhash_dedup(spark, docs, DATA).collect())
    want = components_of(pairs_of(docs), 5, 80)
    assert got == sorted({c for c, _ in want.values()}) and len(got) < docs.count()


def without_repeats(rows, length):
    count = Counter()
    for _, t in rows:
        b = t.encode()
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = {}
    for d, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept, at = [], 0
        for m in re.finditer(b"\x01+", bytes(gone)):
            a, z = m.span()
            while a < z and b[a] & 0xC0 == 0x80:  # a character that is cut in part stays
                a += 1
            while z > a and z < len(b) and b[z] & 0xC0 == 0x80:
                z -= 1
            kept.append(b[at:a])
            at = z
        out[d] = (b"".join(kept) + b[at:]).decode()
    return out


def test_suffix_stage(spark, docs):
    rows = pairs_of(docs)
    got = dict(pairs_of(corpus_pipeline.suffix_dedup_stage(spark, docs, DATA)))
    want = without_repeats(rows, corpus_pipeline.LEAST_REPEAT)
    assert got == want and sum(map(len, want.values())) < 0.95 * sum(len(t) for _, t in rows)


def test_decontamination_stage(spark, docs):
    def shingles(text, k=5):
        w = WORD.findall(text.translate(LOWER))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()), len(w)

    items = [shingles(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    dirty = set()
    for d, text in pairs_of(docs):
        own, _ = shingles(text)
        words = WORD.findall(text.translate(LOWER))
        for item, n in items:
            short = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n < 5 else own
            if item and 100 * len(item & short) >= 80 * len(item):
                dirty.add(d)
    got = {r["doc_id"] for r in corpus_pipeline.decontamination_stage(spark, docs, DATA).collect()}
    assert got == {d for d, _ in pairs_of(docs)} - dirty and dirty


def test_sentencepiece_stage(spark, docs):
    texts = dict(pairs_of(docs))
    encoded = corpus_pipeline.sentencepiece(spark, docs, DATA)
    for r in merge_dropout.decode(encoded).collect():
        assert r["text"] == texts[r["doc_id"]]
    assert encoded.where("not lossless or n_tokens != size(ids)").isEmpty()


RULES_SQL = r"""
WITH p AS (SELECT page_id, url, translate(CASE WHEN contains(url, '://') THEN regexp_extract(url, '://([^/?#]*)', 1) ELSE '' END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  CASE WHEN contains(url, '://') THEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
r(verdict, h, f) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT page_id, h || f AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || f) DESC) AS k FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, f))
SELECT p.page_id, host, path, rule, verdict FROM p LEFT JOIN m ON m.page_id = p.page_id AND k = 1"""


def test_url_rules_of_all_pages(spark):
    """Host, path, rule and the verdict of pages that a rule decides, over a whole table; the others have the trees' verdict."""
    con = duckdb.connect()
    con.execute("create view pages as select * from read_parquet('/root/testdata/sf0.01/pages.parquet')")
    want = {r[0]: r[1:] for r in con.execute(RULES_SQL).fetchall()}
    got = queries.op10_url_trees(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(want)
    for r in got:
        host, path, rule, verdict = want[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["by_rule"] == (rule is not None)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")


def test_url_features(spark):
    urls = ["https://a-1.b2.example.org/x/y.html?q=1&r=&s#top", "http://Example.com", "no url", "", None, "s3://h/é//p/?=2", "http://x.org/a?b=1?c=2"]
    host, path = url_gbt.host_and_path(F.col("url"))
    df = spark.createDataFrame([(u,) for u in urls], "url string").withColumns({"host": host, "path": path})

    def entropy(s):
        n = Counter(s)
        return -sum(v / len(s) * math.log2(v / len(s)) for v in n.values()) if s else 0.0

    for r in url_gbt.with_features(df).collect():
        u = r["url"] or ""
        m = re.search(r"(?s)://([^/?#]*)([^?#]*)", u)
        h, p = (m[1].translate(LOWER), m[2]) if m else ("", "")
        q = re.search(r"(?s)\?([^#]*)", u)
        want = {
            "host": h, "path": p, "f_length": len(u), "f_host_length": len(h), "f_path_length": len(p), "f_depth": len(re.findall("/[^/]+", p)), "f_labels": len(re.findall("[^.]+", h)),
            "f_digits": len(re.findall("[0-9]", u)) / max(len(u), 1), "f_host_digits": len(re.findall("[0-9]", h)), "f_hyphens": h.count("-"), "f_params": len(re.findall("[^&=]+=", q[1])) if q else 0,
            "f_fragment": "#" in u, "f_secure": u.startswith("https"), "f_slash_end": p.endswith("/"), "f_entropy": entropy(u), "f_host_entropy": entropy(h),
            "s_tld": h.split(".")[-1], "s_domain": ".".join(h.split(".")[-2:]), "s_file": (re.findall(r"\.([A-Za-z0-9]{1,8})$", p) or [""])[0],
        }
        for k, v in want.items():
            assert r[k] == v if isinstance(v, str) else abs(r[k] - float(v)) < 1e-9, (u, k)
