"""Readers of manifests, question sets, reports, event streams of text, and files with a hash for a name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

GUIDELINE = "guideline_id string, guideline_version string, title string, issuing_body string, pub_year int, geography string, document_type string, evidence_tier int, path string, source_url string, licence string"
QUESTION = "id string, question string, ground_truth string, expected_source_keywords array<string>, tags array<string>, difficulty int"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The guidelines of a JSON manifest."""
    return spark.read.schema(f"guidelines array<struct<{GUIDELINE.replace(' string', ':string').replace(' int', ':int')}>>").json(path, multiLine=True).select(F.explode("guidelines").alias("g")).select("g.*")


def questions(spark: SparkSession, path: str, *, whole: bool = False) -> DataFrame:
    """A question set, an object a line; whole: each file is one array, as small hand-written sets are."""
    return spark.read.schema(QUESTION).json(path, multiLine=whole)


def report_questions(spark: SparkSession, path: str, *, whole: bool = False) -> DataFrame:
    """The per-question rows of evaluation reports, a report or a part of one a line; whole: each file is one report."""
    row = "question string, answer string, n_retrieved int, n_reranked int, n_citations int, error string"
    return spark.read.schema(f"run_id string, per_question array<struct<{row.replace(' string', ':string').replace(' int', ':int')}>>").json(path, multiLine=whole).select("run_id", F.explode("per_question").alias("q")).select("run_id", "q.*")


def bundle_chapters(bundles: DataFrame, key: str, body: str) -> DataFrame:
    """key, chapter (from 0), slug, title, url, html of each chapter of JSON bundles, in the bundle's order; a body that is no
    bundle has none. The html goes through sources.html.html_sections as any page does."""
    kind = "struct<chapters: array<struct<slug: string, title: string, url: string, html: string>>>"
    return bundles.select(key, F.posexplode(F.from_json(F.col(body), kind)["chapters"]).alias("chapter", "c")).select(key, "chapter", "c.*")


def hashed_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Files below path whose stem is a 64-digit hash: hash, path, length; contents are not read unless asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    stem = F.regexp_extract("path", "([0-9a-f]{64})\\.[^./]+$", 1)
    return files.select(stem.alias("hash"), "path", "length", "content").where(F.col("hash") != "")


def event_blocks(text: Column) -> Column:
    """array of struct(event, data): blocks between blank lines; a last block without its blank line, blocks without an event
    or data line, and data that is not JSON are left out."""
    pieces = F.split(text, "\\n\\n")
    whole = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    parsed = F.transform(whole, lambda b: F.struct(F.regexp_extract(b, "(?m)^event: ?(.*)$", 1).alias("event"), F.regexp_extract(b, "(?m)^data: ?(.*)$", 1).alias("data")))
    return F.filter(parsed, lambda x: (x["event"] != "") & F.try_parse_json(x["data"]).isNotNull() & (x["data"] != ""))


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the processed ones."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def with_outline(pages: DataFrame, outline: DataFrame) -> DataFrame:
    """Outline headings as '## heading' before the text of their page."""
    heads = outline.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("seq", "heading"))).alias("_h"))
    lines = F.array_join(F.transform("_h", lambda h: F.concat(F.lit("## "), h["heading"])), "\n")
    return pages.join(heads, ["doc_id", "page"], "left").withColumn("text", F.when(F.col("_h").isNotNull(), F.concat(lines, F.lit("\n"), F.col("text"))).otherwise(F.col("text"))).drop("_h")


def first_good(pages: DataFrame, attempts: list[DataFrame], least_words: int = 30) -> DataFrame:
    """Page texts from the first attempt (doc_id, page, text, method) with enough words; else 'failed'."""
    out = pages.select("doc_id", "page").withColumns({"text": F.lit(None).cast("string"), "method": F.lit(None).cast("string")})
    for attempt in attempts:
        good = attempt.where(F.size(F.filter(F.split("text", "\\s+"), lambda w: w != "")) >= least_words).select("doc_id", "page", F.col("text").alias("_t"), F.col("method").alias("_m"))
        out = out.join(good, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("text", "_t").alias("text"), F.coalesce("method", "_m").alias("method"))
    return out.fillna({"method": "failed"})
