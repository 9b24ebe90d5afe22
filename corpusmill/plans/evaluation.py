"""Evaluation and monitoring queries over events, documents, labels and benchmark items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evaluation as E
from .base import query, table


@query("status_counts", "SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def status_counts(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("progress_view", """SELECT event_type AS status, count(*) AS n, round(avg(least(value, 100) / 100), 4) AS avg_confidence, count(*) FILTER (WHERE least(value, 100) / 100 >= 0.7) AS high,
count(*) FILTER (WHERE least(value, 100) / 100 >= 0.4 AND least(value, 100) / 100 < 0.7) AS medium, count(*) FILTER (WHERE least(value, 100) / 100 < 0.4) AS low FROM events GROUP BY 1""")
def progress_view(spark, d):
    return E.progress(table(spark, d, "events").select(F.col("event_type").alias("status"), (F.least(F.col("value"), F.lit(100.0)) / 100).alias("confidence")))


@query("coverage_report", """SELECT o_orderpriority AS domain, count(DISTINCT o_orderkey) AS documents, count(l_orderkey) AS chunks, count(CASE WHEN l_quantity > 10 THEN 1 END) AS embedded
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def coverage_report(spark, d):
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("domain"))
    chunks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk_id"), F.when(F.col("l_quantity") > 10, 1).alias("embedded"))
    return E.coverage(docs, chunks)


@query("domain_totals", "SELECT c_mktsegment AS domain, count(*) AS n, sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END)::BIGINT AS with_balance FROM customer GROUP BY 1")
def domain_totals(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("domain")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("c_acctbal") > 0, 1).otherwise(0)).alias("with_balance"))


@query("latency_quantiles_exclusive", """WITH v AS (SELECT event_type, list(value ORDER BY value) AS v FROM events GROUP BY 1),
q AS (SELECT event_type, v, len(v) AS n, p, greatest(1, least(len(v) - 1, (p * (len(v) + 1)) // 100)) AS j FROM v, (SELECT unnest([50, 95]) AS p)),
r AS (SELECT event_type, n, p, CASE WHEN n = 1 THEN v[1] ELSE round((v[j] * (100 - (p * (n + 1) - j * 100)) + v[j + 1] * (p * (n + 1) - j * 100)) / 100.0, 1) END AS x FROM q)
SELECT event_type, max(x) FILTER (WHERE p = 50) AS p50, max(x) FILTER (WHERE p = 95) AS p95, max(n) AS n FROM r GROUP BY 1""")
def latency_quantiles_exclusive(spark, d):
    return E.latency(table(spark, d, "events"), ["event_type"], "value")


def _results(spark, d):
    """Documents with labels as answers: their text carries marks made from the id, quality is the difficulty."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    i = F.col("doc_id")
    answer = F.concat(F.col("text"), F.when(i % 3 == 0, F.concat(F.lit(" ["), (i % 5).cast("string"), F.lit("]"))).otherwise(""), F.when(i % 4 == 0, " 12 mg").otherwise(""))
    truth = F.when(i % 2 == 0, F.lit("12 mg in 3 days")).otherwise(F.lit("none"))
    titles = F.array(F.col("source"), F.col("lang"), F.col("source"))
    return docs.select("doc_id", "quality", answer.alias("answer"), E.numeric_recall(answer, truth).alias("recall"), E.diversity(titles).alias("diversity"), E.covered(titles, F.array(F.lit("SRC1"))).alias("is_covered"))


_RESULTS = """r AS (
  SELECT doc_id, quality, text || CASE WHEN doc_id % 3 = 0 THEN ' [' || doc_id % 5 || ']' ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN ' 12 mg' ELSE '' END AS answer, source, lang
  FROM documents JOIN labels USING (doc_id)),
m AS (
  SELECT *, len(regexp_extract_all(answer, '\\[\\d+\\]')) AS marks, CASE WHEN doc_id % 2 = 0 THEN ((contains(lower(answer), '12 mg'))::INT + (contains(lower(answer), '3 days'))::INT) / 2 END AS recall,
         CASE WHEN source = lang THEN 1 ELSE 2 END / 3 AS diversity, contains(lower(source || ' ' || lang || ' ' || source), 'src1') AS is_covered
  FROM r)""".replace("\\\\", "\\")
_RATES = """round(avg((marks > 0)::INT), 3) AS citation_present_rate, round(avg(marks), 2) AS avg_citations, round(avg(is_covered::INT), 3) AS source_coverage_rate,
round(avg(len(list_filter(string_split_regex(answer, '\\s+'), lambda w: w <> ''))), 2) AS answer_words, round(avg((length(trim(answer)) < 20)::INT), 3) AS empty_answer_rate,
round(coalesce(avg(recall), 0.0), 3) AS numeric_accuracy_rate, round(avg(diversity), 3) AS diversity_avg, count(*) AS n""".replace("\\\\", "\\")


@query("eval_rates", f"WITH {_RESULTS} SELECT {_RATES} FROM m")
def eval_rates(spark, d):
    return E.rates(_results(spark, d))


@query("eval_strata", f"WITH {_RESULTS} SELECT quality, {_RATES} FROM m GROUP BY quality")
def eval_strata(spark, d):
    return E.rates(_results(spark, d), ["quality"])


@query("numeric_recall", f"WITH {_RESULTS} SELECT doc_id, round(recall, 6) AS recall FROM m")
def numeric_recall(spark, d):
    return _results(spark, d).select("doc_id", F.round("recall", 6).alias("recall"))


@query("report_compare", """WITH a AS (SELECT event_type AS metric, round(avg(value), 4) AS a FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1), b AS (SELECT event_type AS metric, round(avg(value), 4) AS b FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1)
SELECT 'latency' AS section, metric, a, b, round(b - a, 6) AS delta, CASE WHEN abs(b - a) < 1e-6 THEN 'same' WHEN b - a > 0 THEN 'better' ELSE 'worse' END AS direction FROM a JOIN b USING (metric)""")
def report_compare(spark, d):
    e = table(spark, d, "events")
    half = lambda first: e.where((F.col("ts") < F.lit("2024-01-16").cast("timestamp")) == first).groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 4).alias("value")).withColumn("section", F.lit("latency"))
    return E.compared(half(True), half(False))


@query("report_unpivot", "SELECT 'events' AS section, unnest(['n', 'mean']) AS metric, unnest([n::DOUBLE, mean]) AS value FROM (SELECT count(*) AS n, round(avg(value), 6) AS mean FROM events)")
def report_unpivot(spark, d):
    return E.unpivoted(table(spark, d, "events").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean")), "events")


@query("payload_completeness", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'status' ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN ',key' ELSE '' END AS missing FROM orders")
def payload_completeness(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")).alias("status"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")).alias("key"))
    gone = E.missing_fields(o, ["status", "key"])
    return gone.select("o_orderkey", F.concat(F.when(F.array_contains("missing", "status"), "status").otherwise(""), F.when(F.array_contains("missing", "key"), ",key").otherwise("")).alias("missing"))


@query("doc_type_breakdown", "SELECT lang, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY 1")
def doc_type_breakdown(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"))


@query("distinct_titles", "SELECT DISTINCT p_name FROM part ORDER BY p_name LIMIT 30")
def distinct_titles(spark, d):
    return table(spark, d, "part").select("p_name").distinct().orderBy("p_name").limit(30)


@query("judge_means", "SELECT event_type, round(avg(CASE WHEN value > 5 THEN value END), 4) AS mean, count(CASE WHEN value > 5 THEN value END) AS scored FROM events GROUP BY 1")
def judge_means(spark, d):
    v = F.when(F.col("value") > 5, F.col("value"))
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg(v), 4).alias("mean"), F.count(v).alias("scored"))


@query("document_totals", "SELECT l_orderkey AS doc_id, count(*) AS chunk_count, sum(l_quantity) AS total_tokens FROM lineitem GROUP BY 1")
def document_totals(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count(F.lit(1)).alias("chunk_count"), F.sum("l_quantity").alias("total_tokens"))


@query("run_totals", "SELECT count(*) AS articles, sum(n_chars)::BIGINT AS chars, count(CASE WHEN n_chars < 20 THEN 1 END) AS failed FROM documents")
def run_totals(spark, d):
    return table(spark, d, "documents").agg(F.count(F.lit(1)).alias("articles"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") < 20).alias("failed"))


@query("mode_by_group", "SELECT event_type, max(k) AS top FROM (SELECT event_type, k, n, max(n) OVER (PARTITION BY event_type) AS most FROM (SELECT event_type, round(value)::BIGINT AS k, count(*) AS n FROM events GROUP BY 1, 2)) WHERE n = most GROUP BY 1")
def mode_by_group(spark, d):
    counted = table(spark, d, "events").groupBy("event_type", F.round("value").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("event_type").agg(F.max_by("k", F.struct("n", "k")).alias("top"))


@query("json_promote_guarded_cast", "SELECT event_id, (props->>'k') AS k_text, CASE WHEN regexp_matches(props->>'k', '^[0-9]+$') THEN (props->>'k')::BIGINT END AS k FROM events")
def json_promote_guarded_cast(spark, d):
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select("event_id", k.alias("k_text"), S.guarded_int(k).alias("k"))


@query("scan_project_filter", "SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' AND n_chars < 500 AND source <> 'src1'")
def scan_project_filter(spark, d):
    return table(spark, d, "documents").where("lang = 'en' and n_chars < 500 and source <> 'src1'").select("doc_id", "lang", "n_chars")


@query("ilike_substring", "SELECT doc_id FROM documents WHERE text ILIKE '%THATION%'")
def ilike_substring(spark, d):
    return table(spark, d, "documents").where(F.col("text").ilike("%THATION%")).select("doc_id")


@query("in_list_filter", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE')")
def in_list_filter(spark, d):
    return table(spark, d, "customer").where(F.col("c_mktsegment").isin("BUILDING", "FURNITURE")).select("c_custkey", "c_mktsegment")


@query("like_wildcard", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'S_A%'")
def like_wildcard(spark, d):
    return table(spark, d, "part").where(F.col("p_type").like("S_A%")).select("p_partkey", "p_type")


@query("optional_param_filter", "SELECT c_custkey FROM customer WHERE (NULL IS NULL OR c_mktsegment = NULL) AND (4 IS NULL OR c_nationkey = 4)")
def optional_param_filter(spark, d):
    rows = table(spark, d, "customer")
    for column, value in (("c_mktsegment", None), ("c_nationkey", 4)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows.select("c_custkey")


@query("must_not_filter", "SELECT o_orderkey FROM orders WHERE coalesce(CASE WHEN o_totalprice < 100000 THEN NULL ELSE o_orderstatus END, '') <> 'F'")
def must_not_filter(spark, d):
    kind = F.when(F.col("o_totalprice") >= 100000, F.col("o_orderstatus"))
    return table(spark, d, "orders").where(~(F.coalesce(kind, F.lit("")) == "F")).select("o_orderkey")


@query("distinct_not_null", "SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL AND event_type <> 'view'")
def distinct_not_null(spark, d):
    return table(spark, d, "events").where("user_id is not null and event_type <> 'view'").select("user_id").distinct()


@query("keyset_page", "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def keyset_page(spark, d):
    return table(spark, d, "orders").where("o_orderdate < timestamp '1999-01-01'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey")


@query("enumerated_order", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '5-LOW' THEN 2 ELSE 99 END AS place FROM orders ORDER BY place, o_orderkey LIMIT 40")
def enumerated_order(spark, d):
    at = F.array_position(F.array(F.lit("1-URGENT"), F.lit("5-LOW")), F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", F.when(at == 0, 99).otherwise(at).cast("int").alias("place")).orderBy("place", "o_orderkey").limit(40)


@query("smallest_first_queue", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 25")
def smallest_first_queue(spark, d):
    return table(spark, d, "documents").orderBy("n_chars", "doc_id").limit(25).select("doc_id", "n_chars")


@query("lookup_override", "SELECT o_orderkey, coalesce(CASE WHEN c_acctbal > 5000 THEN c_mktsegment END, o_orderpriority) AS kind FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def lookup_override(spark, d):
    own = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).alias("_k"))
    return table(spark, d, "orders").join(own, "o_custkey", "left").select("o_orderkey", F.coalesce("_k", "o_orderpriority").alias("kind"))
