"""Crawls that resume, against a plain walk."""

import pytest
from corpusmill.sources.crawl import MOST_FAILURES, Crawl, offline
from pyspark.sql import functions as F

PAGES = {
    "http://a.org/": '<a href="/x#1">x</a> <a href="http://a.org/x">again</a> <a href="y?q=1">y</a><a href="">none</a><A class="n" HREF="http://b.org/z">z</A>',
    "http://a.org/x": '<a href="/">home</a><a href="/gone">gone</a>',
    "http://a.org/y?q=1": "no link",
    "http://b.org/z": '<a href="w.pdf">w</a>',
    "http://b.org/w.pdf": "",
    "http://c.org/alone": '<a href="/">c</a>',
}


def frame(spark, pages):
    return spark.createDataFrame(list(pages.items()), "url string, html string")


class Counting:
    """A transport that notes what it is asked, and breaks at a URL if told to."""

    def __init__(self, pages, breaks=None):
        self.get, self.asked, self.breaks = offline(pages), [], breaks

    def __call__(self, requests):
        urls = [r["url"] for r in requests.collect()]
        if self.breaks in urls:
            raise ConnectionError(self.breaks)
        self.asked += urls
        return self.get(requests)


def test_second_run_reads_what_changed(spark, tmp_path):
    seeds = spark.createDataFrame([("http://a.org/#top",), ("http://a.org/",), (None,)], "url string")
    first = Counting(frame(spark, PAGES))
    got = Crawl(spark, str(tmp_path / "s"), first, buckets=2).run(seeds, 1)
    reached = set(PAGES) - {"http://c.org/alone"}
    assert {r["url"] for r in got.collect()} == reached
    assert sorted(first.asked) == sorted([*reached, "http://a.org/gone"])  # each once
    changed = PAGES | {"http://b.org/z": '<a href="/new">n</a>', "http://b.org/new": "new"}
    second = Counting(frame(spark, changed))
    got = {r["url"]: r["body"] for r in Crawl(spark, str(tmp_path / "s"), second, buckets=2).run(seeds, 2).collect()}
    assert got == {"http://b.org/z": changed["http://b.org/z"], "http://b.org/new": "new"}
    assert len(second.asked) == len(set(second.asked))


def test_a_broken_run_is_taken_up(spark, tmp_path):
    seeds = spark.createDataFrame([("http://a.org/",)], "url string")
    broken = Counting(frame(spark, PAGES), breaks="http://b.org/w.pdf")
    with pytest.raises(ConnectionError):
        Crawl(spark, str(tmp_path / "s"), broken, buckets=2).run(seeds, 1)
    again = Counting(frame(spark, PAGES))
    Crawl(spark, str(tmp_path / "s"), again, buckets=2).run(seeds, 1)
    assert set(again.asked) == {"http://b.org/w.pdf", "http://a.org/gone"} and not set(again.asked) & set(broken.asked)


def test_followed_links_and_failures(spark, tmp_path):
    seeds = spark.createDataFrame([("http://a.org/",), ("http://nowhere.org/",)], "url string")
    get = Counting(frame(spark, PAGES))
    crawl = Crawl(spark, str(tmp_path / "s"), get, next_mark='class="n"', follow="b\\.org", buckets=2)
    assert {r["url"] for r in crawl.run(seeds, 1).collect()} == {"http://a.org/", "http://b.org/z"}
    for run in range(2, MOST_FAILURES + 3):
        crawl.run(seeds, run)
    assert get.asked.count("http://nowhere.org/") == MOST_FAILURES
    assert crawl.state.read().where(F.col("url") == "http://nowhere.org/").first()["failures"] == MOST_FAILURES
    assert Crawl(spark, str(tmp_path / "t"), get).run(seeds.limit(0), 1).collect() == []


def test_sections_leave_a_task_in_parts(monkeypatch):
    """A batch of many pages leaves in parts of HELD characters, with all of its sections in order."""
    import pyarrow as pa

    monkeypatch.setattr(H, "HELD", 500, raising=False)
    page = lambda i: f"<article><abstract><p>a{i}</p></abstract><body><sec><title>t</title><p>{'w ' * i}</p></sec></body></article>"
    batch = pa.RecordBatch.from_pydict({"k": list(range(100)), "body": [None if i == 7 else page(i) for i in range(100)]})
    parts = list(H._rows(H.article_of, "k")([batch]))
    assert len(parts) > 10 and all(sum(map(len, p.column("text").to_pylist())) < 500 + 200 for p in parts)
    rows = [tuple(r.values()) for p in parts for r in p.to_pylist()]
    assert rows == [(i, n, *s) for i in range(100) for n, s in enumerate(H.article_of(page(i) if i != 7 else None))]
