"""Crawls that resume: a frontier of URLs in rounds, conditional requests, and a state of what each URL was when last seen.

A transport takes a table of requests (url, etag) and gives a table of responses (url, status, etag, body): 200 with a body, 304 where
the etag still holds, 4xx and 5xx for failures. It is a function of DataFrames, so a real one is a mapInArrow with a client in each
task, and the offline one is a join with a table of pages. Requests of a round are one table, dealt out by URL; within a run no URL is
asked twice, however many pages link to it.

State is a table in buckets by URL (operators/buckets.py): etag, links, how many times it failed in a row, and the run that saw it
last. Each round is one version of it, so a run that breaks off goes on where it was: what it has seen is not asked again. A page that
has not changed is not fetched, and its links are taken from the state, so what lies behind it is found as well.

Defined cases: URLs are told apart without fragment; a URL that failed MOST_FAILURES runs in a row is not asked again; null and empty
links are none; pages without a known transport answer are 404.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.buckets import BucketTable
from ..scratch import Scratch
from . import html as H

MOST_FAILURES = 3
Transport = Callable[[DataFrame], DataFrame]


def offline(pages: DataFrame) -> Transport:
    """The transport over a table of pages (url, html): the etag is a hash of the page."""
    known = pages.select(_bare(F.col("url")).alias("url"), F.md5(F.col("html").cast("binary")).alias("_now"), F.col("html").alias("_html")).dropDuplicates(["url"])

    def get(requests: DataFrame) -> DataFrame:
        same = F.col("etag").isNotNull() & (F.col("etag") == F.col("_now"))
        found = requests.join(known, "url", "left")
        status = F.when(F.col("_now").isNull(), 404).when(same, 304).otherwise(200)
        return found.select("url", status.alias("status"), F.col("_now").alias("etag"), F.when(status == 200, F.col("_html")).alias("body"))

    return get


def _bare(url: Column) -> Column:
    return F.split_part(url, F.lit("#"), F.lit(1))


class Crawl:
    def __init__(self, spark: SparkSession, path: str, transport: Transport, *, follow: str = ".*", next_mark: str | None = None, buckets: int = 16):
        """path: of the state. follow: a pattern of the links that are followed; next_mark: a pattern of the a elements whose links
        are, such as class="next"."""
        part = lambda name, kind: T.StructField(name, kind)
        schema = T.StructType([part("url", T.StringType()), part("etag", T.StringType()), part("links", T.ArrayType(T.StringType())), part("failures", T.IntegerType()), part("run", T.LongType()), part("status", T.IntegerType())])
        self.spark, self.transport, self.follow, self.next_mark = spark, transport, follow, next_mark
        self.state = BucketTable(spark, path, schema, "url", buckets)

    def _links(self, url: Column, body: Column) -> Column:
        elements = F.regexp_extract_all(body, F.lit(f"(?i)<a\\s[^>]*{self.next_mark or ''}[^>]*>"), F.lit(0))
        found = F.transform(F.transform(elements, lambda e: F.regexp_extract(e, '(?i)href="([^"]*)"', 1)), lambda h: _bare(h))
        absolute = F.transform(F.filter(found, lambda h: h != ""), lambda h: H.resolved(url, h))
        return F.array_distinct(F.filter(absolute, lambda u: u.rlike(self.follow)))

    def run(self, seeds: DataFrame, run: int, *, most_rounds: int = 1000) -> DataFrame:
        """url, status, body of the pages that are new or have changed since the run before. seeds: url. run: a number that grows;
        a run that broke off is taken up by its number."""
        scratch = Scratch(self.spark, "crawl")
        done = self.state.read().where(F.col("run") == run)
        # What a run that broke off has seen leads on, too.
        behind = done.select(F.explode("links").alias("url"))
        frontier = seeds.select(_bare(F.col("url")).alias("url")).union(behind).where("url <> ''").distinct()
        changed = []
        for turn in range(most_rounds):
            known = self.state.read()
            asked = frontier.join(known.select("url", "etag", F.col("links").alias("_links"), "failures", F.col("run").alias("_run")), "url", "left")
            asked = scratch.save(asked.where(F.col("_run").isNull() | (F.col("_run") < run)).where(F.coalesce("failures", F.lit(0)) < MOST_FAILURES), f"asked-{turn}")
            if asked.isEmpty():
                break
            answers = scratch.save(self.transport(asked.select("url", "etag")), f"answers-{turn}")
            both = answers.withColumnRenamed("etag", "_new").join(asked.drop("_run"), "url")
            ok = F.col("status").isin(200, 304)
            links = F.when(F.col("status") == 200, self._links(F.col("url"), F.col("body"))).otherwise(F.coalesce("_links", F.array().cast("array<string>")))
            rows = both.select("url", F.when(ok, F.col("_new")).otherwise(F.col("etag")).alias("etag"), links.alias("links"), F.when(ok, 0).otherwise(F.coalesce("failures", F.lit(0)) + 1).cast("int").alias("failures"), F.lit(run).cast("long").alias("run"), F.col("status").cast("int").alias("status"))
            rows = scratch.save(rows, f"rows-{turn}")
            self.state.replace(rows)
            changed.append(answers.where("status = 200").select("url", "status", "body"))
            frontier = rows.select(F.explode("links").alias("url")).distinct()
        empty = self.spark.createDataFrame([], "url string, status int, body string")
        return reduce(DataFrame.union, changed, empty)
