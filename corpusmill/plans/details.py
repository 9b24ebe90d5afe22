"""Smaller operators over whole tables: titles and pages that are skipped, segments, cited sources, lookups by prefix, links, queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S, text as X, vocabulary as V
from ..operators import evaluation as E, lifecycle as L, retrieval as R
from ..scratch import Scratch
from ..sources import html as H
from ..streaming import jobs as J
from .base import first_match_sql, literal, query, spliced, spliced_sql, table

#: Titles: a document's source, with a word of a section's behind it, chosen by the text's length.
_TITLES = ["References and notes", "Methods", "List of Tables", "Results", "ACKNOWLEDGEMENTS", "Annexes", "Dosing"]


@query("skipped_sections", f"SELECT doc_id, ({' OR '.join(f'contains(lower(t), {literal(s)})' for s in V.SKIPPED_SECTIONS)}) AS skipped FROM (SELECT doc_id, {spliced_sql(_TITLES, 'source').replace('length(source)', 'length(text)')} AS t FROM documents)")
def skipped_sections(spark, d):
    title = F.concat_ws(" ", "source", F.element_at(F.array(*map(F.lit, _TITLES)), (F.pmod(F.length("text"), F.lit(len(_TITLES))) + 1).cast("int")))
    return table(spark, d, "documents").select("doc_id", X.skipped_section(title).alias("skipped"))


@query("text_pages", r"""SELECT doc_id, page::INT AS page, length(regexp_replace(line, '\s', '', 'g')) >= 100 AS has_text FROM (SELECT doc_id, unnest(range(len(l))) AS page, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""")
def text_pages(spark, d):
    """Lines as pages: enough characters of their own, or an image's."""
    pages = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "line"))
    return pages.select("doc_id", "page", X.has_page_text(F.col("line")).alias("has_text"))


_SQUEEZE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(p, ' '), '\f', chr(10), 'g'), '[^\S\n]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '- \n', '', 'g')"


@query("assembled_text", rf"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, '. '), lambda p: {_SQUEEZE}), lambda p: p <> ''), chr(10) || chr(10)) AS text FROM documents""")
def assembled_text(spark, d):
    """Sentences as pages, cleaned and put together."""
    pages = F.transform(F.split("text", "\\. "), lambda p: S.squeeze_spaces(F.trim(p)))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.filter(pages, lambda p: p != ""), "\n\n").alias("text"))


#: Behind the texts, so that each type comes up.
_SEGMENTS = ["take 10 mg as one dose per kg daily.", "monitor closely at follow-up.", "this is defined as a criterion.", "evidence of a trial and a systematic review.", "we recommend it.", "plain words."]
_LAST = "lower(t)"
_ANY = lambda words: "(" + " OR ".join(f"contains({_LAST}, '{w}')" for w in words) + ")"


@query("segment_types", f"""WITH s AS (SELECT doc_id, {spliced_sql(_SEGMENTS)} AS t FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(t, {literal(V.RECOMMENDATION)}) THEN 'recommendation' WHEN regexp_matches(t, {literal(V.DOSES)}) AND {_ANY(['dose', 'dosage', 'dosing', 'mg/kg', 'per kg'])} THEN 'drug_dosing'
 WHEN {_ANY(['monitor', 'surveillance', 'follow-up', 'follow up'])} THEN 'monitoring' WHEN {_ANY(['defined as', 'criterion', 'criteria', 'classified as'])} THEN 'definition_criteria'
 WHEN {' + '.join(f"regexp_matches(t, {literal(p)})::INT" for p in V.REASONS)} >= 2 THEN 'rationale' ELSE 'background' END AS segment FROM s""")
def segment_types(spark, d):
    t = spliced(F.col("text"), _SEGMENTS)
    return table(spark, d, "documents").select("doc_id", X.segment_type(t, F.lit(True)).alias("segment"))


@query("fenced_json", """SELECT doc_id, source AS title, length(text) AS size FROM documents""")
def fenced_json(spark, d):
    """Records as a model writes them, some within a code fence, read back."""
    record = F.to_json(F.struct(F.col("source").alias("title"), F.length("text").cast("long").alias("size")))
    written = F.when(F.length("text") % 3 == 0, F.concat(F.lit("```json\n"), record, F.lit("\n```"))).when(F.length("text") % 3 == 1, F.concat(F.lit(" ```\n"), record, F.lit("\n``` "))).otherwise(record)
    read = F.from_json(X.repaired_json(written), "title string, size long")
    return table(spark, d, "documents").select("doc_id", read["title"].alias("title"), read["size"].alias("size"))


#: Fixed values of the test: sources by their beginnings, the longer one behind the shorter one.
_PREFIXES = [("src1", "first"), ("src12", "never"), ("src3", ""), ("src", "other")]


@query("prefix_lookup", "SELECT doc_id, CASE WHEN starts_with(source, 'src1') THEN 'first' WHEN starts_with(source, 'src3') THEN '' WHEN starts_with(source, 'src') THEN 'other' END AS body FROM documents")
def prefix_lookup(spark, d):
    return table(spark, d, "documents").select("doc_id", S.first_prefix(F.col("source"), _PREFIXES).alias("body"))


@query("results_by_question", """SELECT r.doc_id, q.id AS question_id, q.lang AS strata FROM documents r JOIN (SELECT text, max(doc_id) AS id, arg_max(lang, doc_id) AS lang FROM documents GROUP BY text) q ON q.text = r.text""")
def results_by_question(spark, d):
    """Documents as results and as questions: of questions with one text the last counts."""
    docs = table(spark, d, "documents")
    questions = E.questions_by_text(docs.select(F.col("text").alias("question"), F.col("doc_id").alias("id"), "lang"))
    return docs.select("doc_id", F.col("text").alias("question")).join(questions, "question").select("doc_id", F.col("id").alias("question_id"), F.col("lang").alias("strata"))


@query("cited_only", r"""WITH c AS (SELECT conv_id, turn, text || ' [' || (length(text) % 5 + 1) || '][' || (turn % 3 + 1) || ']' AS t FROM conversations)
SELECT conv_id, turn, list_filter([1, 2, 3, 4, 5, 6], lambda n: contains(t, '[' || n || ']')) AS cited FROM c""")
def cited_only(spark, d):
    """Of six sources those whose mark is in the answer."""
    answer = F.concat("text", F.lit(" ["), (F.length("text") % 5 + 1).cast("string"), F.lit("]["), (F.col("turn") % 3 + 1).cast("string"), F.lit("]"))
    sources = F.array(*[F.struct(F.lit(n).alias("index"), F.lit(f"title {n}").alias("title")) for n in range(1, 7)])
    return table(spark, d, "conversations").select("conv_id", "turn", F.transform(R.cited_only(sources, answer), lambda c: c["index"]).alias("cited"))


@query("page_links", r"""SELECT page_id, href, CASE WHEN regexp_matches(href, '^[a-zA-Z]+://') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-zA-Z]+://[^/]+)', 1) || href
 ELSE regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '[^/]*$', '') || href END AS target
FROM (SELECT DISTINCT page_id, url, split_part(split_part(unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1)), '?', 1), '#', 1) AS href FROM pages)""")
def page_links(spark, d):
    """Each page's distinct links, and where they lead."""
    found = table(spark, d, "pages").select("page_id", "url", F.explode(H.links(F.col("html"))).alias("href"))
    return found.select("page_id", "href", H.resolved(F.col("url"), F.col("href")).alias("target")).distinct()


@query("queue_worker", "SELECT o_orderkey AS doc_id, length(o_orderpriority)::INT AS size FROM orders")
def queue_worker(spark, d):
    """Orders as jobs that come in files: each batch goes through a stage and is upserted; the last batch comes twice."""
    scratch = Scratch(spark, "worker")
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderpriority")
    scratch.save(jobs.repartition(3), "jobs")
    schema = spark.read.parquet(scratch.path("jobs")).schema
    done = L.SnapshotTable(spark, scratch.path("done"))
    done.write(spark.createDataFrame([], "doc_id long, size int, batch int"))
    stage = lambda rows: rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.length("o_orderpriority").alias("size"))
    J.work(spark, J.stream_of(spark, scratch.path("jobs"), schema, 1), done, stage, scratch.path("checkpoint")).awaitTermination()
    done.upsert(stage(jobs.where("o_orderkey % 3 = 0")).withColumn("batch", F.lit(9)), ["doc_id"], F.col("batch").desc())
    return done.read().select("doc_id", "size")
