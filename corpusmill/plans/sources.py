"""Readers, parsers, snapshots and streams: each query writes what the driver's tables hold in the shape that the reader takes, to
the shared folder, and reads it back through the operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conversations as C, lifecycle as L, retrieval as R
from ..scratch import Scratch
from ..sources import crawl as Cr, html as H, readers as Rd
from ..streaming import jobs as J
from . import base as B
from .base import query, table


@query("manifest_read", "SELECT n_name AS guideline_id, 1900 + n_nationkey AS pub_year, CASE WHEN n_regionkey = 0 THEN NULL ELSE 'r' || n_regionkey END AS geography FROM nation")
def manifest_read(spark, d):
    """Nations as the guidelines of one manifest."""
    path = Scratch(spark, "manifest").path("m")
    g = F.struct(F.col("n_name").alias("guideline_id"), (F.col("n_nationkey") + 1900).alias("pub_year"), F.when(F.col("n_regionkey") != 0, F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))).alias("geography"))
    table(spark, d, "nation").agg(F.to_json(F.struct(F.collect_list(g).alias("guidelines"))).alias("value")).write.text(path)
    return Rd.manifest(spark, path).select("guideline_id", "pub_year", "geography")


@query("questions_read", "SELECT item_id::VARCHAR AS id, text AS question, [split_part(text, ' ', 1)] AS expected_source_keywords, (item_id % 3 + 1)::INT AS difficulty FROM benchmark")
def questions_read(spark, d):
    """Benchmark items as a question set, an object a line."""
    path = Scratch(spark, "questions").path("q")
    q = F.struct(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), F.array(F.split_part("text", F.lit(" "), F.lit(1))).alias("expected_source_keywords"), (F.col("item_id") % 3 + 1).alias("difficulty"))
    table(spark, d, "benchmark").select(F.to_json(q).alias("value")).write.text(path)
    return Rd.questions(spark, path).select("id", "question", "expected_source_keywords", "difficulty")


@query("report_questions_read", "SELECT 'run-1' AS run_id, text AS question, length(text)::INT AS n_retrieved, CASE WHEN item_id % 5 = 0 THEN 'late' END AS error FROM benchmark")
def report_questions_read(spark, d):
    """Items as a run's report in parts of a hundred questions, a part a line."""
    path = Scratch(spark, "report").path("r")
    row = F.struct(F.col("text").alias("question"), F.length("text").alias("n_retrieved"), F.when(F.col("item_id") % 5 == 0, "late").alias("error"))
    parts = table(spark, d, "benchmark").groupBy(F.floor(F.col("item_id") / 100).alias("part")).agg(F.to_json(F.struct(F.lit("run-1").alias("run_id"), F.collect_list(row).alias("per_question"))).alias("value"))
    parts.select("value").write.text(path)
    return Rd.report_questions(spark, path).select("run_id", "question", "n_retrieved", "error")


_XML_TEXT = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_SQUEEZED = r"trim(regexp_replace({}, '\s+', ' ', 'g'), ' ')"


def _articles(spark, d):
    """Documents as journal articles: an abstract, a section with the text, and a section within it."""
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    clean = F.regexp_replace(safe, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    tag = lambda name, body: F.concat(F.lit(f"<{name}>"), body, F.lit(f"</{name.split()[0]}>"))
    inner = tag("sec", F.concat(tag("title", F.lit("Methods")), tag("p", F.concat(F.col("lang"), F.lit(" <b>only</b>")))))
    body = tag("body", tag("sec", F.concat(tag("title", F.col("source")), tag("p", clean), inner)))
    kind = F.when(F.col("doc_id") % 3 == 0, "Animals").otherwise("Adult")
    people = F.lit('<contrib contrib-type="author"><name><surname>Li</surname><given-names>Ann May</given-names></name></contrib>')
    many = F.when(F.col("doc_id") % 2 == 0, F.concat(people, people, people, people)).otherwise(people)
    front = F.concat(tag("article-title", F.concat(F.lit("On "), F.col("source"))), many, tag("abstract", tag("p", F.col("lang"))), tag('kwd-group kwd-group-type="mesh"', tag("kwd", kind)), tag("pub-date", tag("year", (F.col("doc_id") % 50 + 1970).cast("string"))))
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit('<article article-type="research-article">'), tag("front", front), body, F.lit("</article>")).alias("xml"))


@query("xml_sections", f"""SELECT doc_id, 0 AS seq, 1 AS level, 'Abstract' AS heading, lang AS text FROM documents UNION ALL SELECT doc_id, 1, 1, source, {_SQUEEZED.format('text')} FROM documents WHERE {_SQUEEZED.format('text')} <> ''
 UNION ALL SELECT doc_id, 1 + ({_SQUEEZED.format('text')} <> '')::INT, 2, 'Methods', lang || ' only' FROM documents""")
def xml_sections(spark, d):
    return H.xml_sections(_articles(spark, d), "doc_id", "xml")


@query("xml_metadata", """SELECT doc_id, 'On ' || source AS title, (doc_id % 50 + 1970)::VARCHAR AS year, CASE WHEN doc_id % 2 = 0 THEN 'Li AM, Li AM, Li AM et al.' ELSE 'Li AM' END AS authors, 'open-access' AS licence, 'research-article' AS article_type,
 [CASE WHEN doc_id % 3 = 0 THEN 'Animals' ELSE 'Adult' END] AS keywords FROM documents""")
def xml_metadata(spark, d):
    return H.xml_metadata(_articles(spark, d), "doc_id", "xml").select("doc_id", "title", "year", "authors", "licence", "article_type", "keywords")


@query("page_years", """SELECT page_id, CASE WHEN page_id % 3 < 2 THEN (1990 + page_id % 30)::INT END AS year FROM pages""")
def page_years(spark, d):
    """The years of whole pages, with a line of their publication or update spliced behind."""
    k, year = F.col("page_id") % 3, (F.col("page_id") % 30 + 1990).cast("string")
    line = F.when(k == 0, F.concat(F.lit(" Published: 3 May 1980. Last updated: 12 June "), year)).when(k == 1, F.concat(F.lit(" published 1 May "), year)).otherwise("")
    return table(spark, d, "pages").select("page_id", H.years(F.concat(F.col("html"), line)).alias("year"))


@query("pages_by_kind", """SELECT page_id, CASE WHEN page_id % 4 = 1 THEN 'xml' WHEN page_id % 4 = 2 THEN 'bundle' WHEN page_id % 4 = 3 THEN 'other' ELSE 'html' END AS parser FROM pages""")
def pages_by_kind(spark, d):
    """The parser of a body, by its content type and, where that says nothing, by how it begins."""
    k = F.col("page_id") % 4
    kind = F.when(k == 0, "text/html; charset=utf-8").when(k == 1, "application/xml").when(k == 2, "application/octet-stream").otherwise("application/pdf")
    body = F.when(k == 2, F.concat(F.lit(' {"chapters": []}'), F.lit(""))).otherwise(F.col("html"))
    return table(spark, d, "pages").select("page_id", H.routed(kind, body).alias("parser"))


_BUNDLE = r"regexp_extract(url, '://([^/?#]*)', 1) || '/' || page_id // 50"


@query("chapter_bundles", f"""SELECT {_BUNDLE} AS bundle, page_id AS chapter_id, row_number() OVER (PARTITION BY {_BUNDLE} ORDER BY page_id) - 1 AS chapter, 'c' || page_id AS title, url FROM pages""")
def chapter_bundles(spark, d):
    """Pages as the chapters of their host's bundles of fifty at most, one JSON object each, taken apart again in their order."""
    chapter = F.struct(F.col("page_id").alias("k"), F.concat(F.lit("c"), F.col("page_id").cast("string")).alias("title"), "url", "html")
    bundle = F.concat(F.regexp_extract("url", "://([^/?#]*)", 1), F.lit("/"), F.floor(F.col("page_id") / 50).cast("string"))
    bundles = table(spark, d, "pages").groupBy(bundle.alias("bundle")).agg(F.to_json(F.struct(F.sort_array(F.collect_list(chapter)).alias("chapters"))).alias("body"))
    return Rd.bundle_chapters(bundles, "bundle", "body").select("bundle", F.substring("title", 2, 20).cast("bigint").alias("chapter_id"), "chapter", "title", "url")


#: Page p links on to the pages 4p + 1 to 4p + 4, where these are there and not divisible by five.
_CRAWL = """WITH RECURSIVE r AS (SELECT page_id FROM pages WHERE page_id = 0 UNION SELECT p.page_id FROM r JOIN pages p ON p.page_id BETWEEN 4 * r.page_id + 1 AND 4 * r.page_id + 4 AND p.page_id % 5 <> 0)"""


def _linked(spark, d):
    """Pages under a URL of their own, with links to the next ones behind their html."""
    url = lambda i: F.concat(F.lit("https://index.example.org/p/"), i.cast("string"))
    one = lambda k: F.when((F.col("page_id") * 4 + k) % 5 != 0, F.concat(F.lit('<a class="next" href="/p/'), (F.col("page_id") * 4 + k).cast("string"), F.lit('#top">next</a>'))).otherwise("")
    return table(spark, d, "pages").select("page_id", url(F.col("page_id")).alias("url"), F.concat(F.col("html"), *[one(k) for k in (1, 2, 3, 4)]).alias("html"))


@query("crawl_first_run", f"{_CRAWL} SELECT page_id, md5(html) AS page FROM r JOIN pages USING (page_id)")
def crawl_first_run(spark, d):
    """All pages that the first one leads to, by its next links."""
    pages = _linked(spark, d)
    found = Cr.Crawl(spark, Scratch(spark, "crawl-state").path("s"), Cr.offline(pages), next_mark='class="next"', buckets=4).run(pages.where("page_id = 0"), 1)
    number = F.substring_index("url", "/", -1).cast("long")
    return found.select(number.alias("page_id"), F.md5(F.regexp_replace("body", '(<a class="next"[^>]*>next</a>)+$', "").cast("binary")).alias("page"))


@query("crawl_changed", f"{_CRAWL} SELECT page_id FROM r WHERE page_id % 3 = 0")
def crawl_changed(spark, d):
    """A second run, after a third of the pages have changed: these alone are fetched, and the rest answer that they are as before."""
    pages, path = _linked(spark, d), Scratch(spark, "crawl-state").path("s")
    Cr.Crawl(spark, path, Cr.offline(pages), next_mark='class="next"', buckets=4).run(pages.where("page_id = 0"), 1)
    later = pages.withColumn("html", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<!-- new -->"), F.col("html"))).otherwise(F.col("html")))
    found = Cr.Crawl(spark, path, Cr.offline(later), next_mark='class="next"', buckets=4).run(pages.where("page_id = 0"), 2)
    return found.select(F.substring_index("url", "/", -1).cast("long").alias("page_id"))


@query("snapshot_upsert", """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS v FROM orders WHERE o_orderkey % 3 <> 0""")
def snapshot_upsert(spark, d):
    """A table's first snapshot, an upsert of every second row, and a delete of every third."""
    t = L.SnapshotTable(spark, Scratch(spark, "snapshots").path("t"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("v"))
    t.write(rows)
    t.upsert(rows.where("doc_id % 2 = 0").withColumn("v", F.lit(2)), ["doc_id"], F.col("v").desc())
    t.change(lambda current: L.deleted(current, rows.where("doc_id % 3 = 0"), ["doc_id"]))
    return t.read()


_M = "m AS (SELECT conv_id * 1000 + turn AS id, conv_id AS conversation_id, CASE WHEN turn < max(turn) OVER (PARTITION BY conv_id) THEN conv_id * 1000 + turn + 1 END AS selected_child_id FROM conversations)"


@query("appended_messages", f"""WITH {_M} SELECT id, conversation_id, CASE WHEN id % 3 = 0 THEN -2 * id - 1 ELSE selected_child_id END AS selected_child_id FROM m
UNION ALL SELECT -2 * id - s, conversation_id, NULL FROM m, (SELECT unnest([0, 1]) AS s) WHERE id % 3 = 0""")
def appended_messages(spark, d):
    """Two new children for every third message; the later one is selected."""
    m = B.messages(spark, d).select("id", "conversation_id", "selected_child_id")
    new = m.where("id % 3 = 0").select((-2 * F.col("id")).alias("_n"), F.col("id").alias("parent_id"), "conversation_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("created_at"))
    new = new.select((F.col("_n") - F.col("created_at")).alias("id"), "conversation_id", F.lit(None).cast("long").alias("selected_child_id"), "parent_id", "created_at")
    old = m.withColumns({"parent_id": F.lit(None).cast("long"), "created_at": F.lit(0)})
    return C.append_message(old, new).select("id", "conversation_id", "selected_child_id")


@query("term_index", "SELECT term, id, count(*) AS tf FROM (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{5,}')) AS term FROM documents) GROUP BY 1, 2")
def term_index(spark, d):
    """The inverted index, written once and read as a table."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return Scratch(spark, "index").save(R.term_index(docs, 5), "terms")


_LINE = "SELECT doc_id, unnest(range(len(l))) AS page, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"


@query("page_cascade", rf"""SELECT doc_id, page::INT AS page, CASE WHEN n >= 30 THEN text WHEN 2 * n >= 30 THEN text || ' ' || text END AS text, CASE WHEN n >= 30 THEN 'layer' WHEN 2 * n >= 30 THEN 'ocr' ELSE 'failed' END AS method
FROM (SELECT *, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS n FROM ({_LINE}))""")
def page_cascade(spark, d):
    """Lines as pages: their own words first, then a second attempt that reads everything twice."""
    pages = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))
    second = pages.select("doc_id", "page", F.concat_ws(" ", "text", "text").alias("text"), F.lit("ocr").alias("method"))
    return Rd.first_good(pages, [pages.withColumn("method", F.lit("layer")), second])


@query("outlined_pages", f"""SELECT doc_id, page::INT AS page, CASE WHEN page % 4 = 1 THEN '## a' || page || chr(10) || '## b' || chr(10) || text ELSE text END AS text FROM ({_LINE})""")
def outlined_pages(spark, d):
    pages = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))
    two = F.array(F.struct(F.lit(0).alias("seq"), F.concat(F.lit("a"), F.col("page").cast("string")).alias("heading")), F.struct(F.lit(1).alias("seq"), F.lit("b").alias("heading")))
    outline = pages.where("page % 4 = 1").select("doc_id", "page", F.explode(two).alias("o")).select("doc_id", "page", "o.*")
    return Rd.with_outline(pages, outline).select("doc_id", "page", "text")


@query("cache_stream", """SELECT user_id, event_id, coalesce(epoch(ts) - epoch(before) <= 43200, false) AS hit, cached FROM (SELECT *, lag(ts) OVER w AS before, lag(value) OVER w AS cached FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def cache_stream(spark, d):
    """Events as a stream through a keyed cache of twelve hours, a batch at a time, against window functions over the table."""
    scratch = Scratch(spark, "cache")
    scratch.save(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).repartitionByRange(3, "ts", "event_id"), "events")
    schema = spark.read.parquet(scratch.path("events")).schema
    stream = J.stream_of(spark, scratch.path("events"), schema).select("user_id", "event_id", "ts", "value")
    writer = J.last_seen(stream, 43_200).writeStream.format("parquet").option("path", scratch.path("out")).option("checkpointLocation", scratch.path("state")).outputMode("append")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(scratch.path("out"))
