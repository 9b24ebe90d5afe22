"""Evaluation of answered questions: rates, strata, quantiles, coverage, comparison of reports, completeness of payloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scalars as S

#: The units that may follow a number.
UNITS = "mg|mL|weeks?|months?|%|hrs?|days?|years?|doses?"
NUMBER = f"(?i)\\b\\d+(?:\\.\\d+)?(?:\\s*(?:{UNITS}))?\\b"
#: Metrics where less is better.
LOWER_IS_BETTER = (
    "embed_p50", "embed_p95", "retrieval_p50", "retrieval_p95", "rerank_p50", "rerank_p95", "ttft_p50", "ttft_p95",
    "total_p50", "total_p95", "classify_p50", "classify_p95", "empty_answer_rate", "hallucination_score",
)


#: Of percentile_approx; its rank is wrong by n / ACCURACY at most.
ACCURACY = 10_000
BINS = 1024


def latency(results: DataFrame, key: list[str], value: str, percents=(50, 95)) -> DataFrame:
    """Exclusive quantiles of each group: the percent-th percentile at rank percent * (n + 1) / 100 between its two neighbours,
    rounded to one place; of one value the value itself. Groups of nulls alone have 0 and n = 0.

    Exact, and no group is collected: percentile_approx gives a value on either side of both neighbours, what lies below is
    counted, and the distinct values between the two (some ten-thousandths of a group) are counted in BINS spans of equal width; only
    the values of the spans that hold the two neighbours are put in order."""
    rows = results.select(*key, F.col(value).cast("double").alias("_v"))
    margin = 4 / ACCURACY
    ends = [x for p in percents for x in (max(0.0, p / 100 - margin), min(1.0, p / 100 + margin))]
    sizes = rows.groupBy(*key).agg(F.count("_v").alias("n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.percentile_approx("_v", ends, ACCURACY).alias("_e"))
    whole = F.col("n") <= ACCURACY  # small groups are ordered whole
    spans = F.array(*[F.struct(F.lit(p).alias("p"), F.when(whole, F.col("_least")).otherwise(F.get("_e", F.lit(2 * i))).alias("lo"), F.when(whole, F.col("_most")).otherwise(F.get("_e", F.lit(2 * i + 1))).alias("hi")) for i, p in enumerate(percents)])
    bounds = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], "n", spans.alias("_spans"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]
    counted = rows.where("_v is not null").groupBy(*key, "_v").agg(F.count(F.lit(1)).alias("_m"))
    met = counted.join(bounds, reduce(lambda a, b: a & b, same)).select(*key, "n", "_v", "_m", F.explode("_spans").alias("_s"))
    lo, width = F.col("_s.lo"), (F.col("_s.hi") - F.col("_s.lo")) / BINS
    bin_ = F.when(F.col("_v") < lo, -1).when(width > 0, F.least(F.lit(BINS - 1), F.floor((F.col("_v") - lo) / width))).otherwise(0).cast("int")  # all that lies below is one bin
    near = met.where(F.col("_v") <= F.col("_s.hi")).select(*key, "n", F.col("_s.p").alias("p"), bin_.alias("_b"), "_v", "_m")
    at = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor(F.col("p") * (F.col("n") + 1) / 100)))
    group = [*key, "n", "p"]
    bins = near.groupBy(*group, "_b").agg(F.sum("_m").alias("_k")).withColumn("_to", F.sum("_k").over(W.partitionBy(*group).orderBy("_b")))
    bins = bins.withColumn("_base", F.col("_to") - F.col("_k")).where((F.col("_to") >= at) & (F.col("_base") < at + 1))
    bins = bins.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate([*group, "_b"])], "_base")
    within = near.join(bins, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate([*group, "_b"])])).select(*group, "_b", "_v", "_m", "_base")
    upto = within.withColumn("_to", F.col("_base") + F.sum("_m").over(W.partitionBy(*group, "_b").orderBy("_v")))
    holds = lambda rank: (F.col("_to") >= rank) & (F.col("_to") - F.col("_m") < rank)
    pair = upto.groupBy(*group).agg(F.max(F.when(holds(at), F.col("_v"))).alias("low"), F.max(F.when(holds(at + 1), F.col("_v"))).alias("high"))
    rest = F.col("p") * (F.col("n") + 1) - at * 100
    between = F.when(F.col("n") == 1, F.col("low")).otherwise(F.round((F.col("low") * (100 - rest) + F.col("high") * rest) / 100.0, 1))
    found = pair.select(*key, "p", between.alias("x")).groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(*[F.max(F.when(F.col("p") == p, F.col("x"))).alias(f"p{p}") for p in percents])
    of_all = sizes.select(*key, "n").join(found, reduce(lambda a, b: a & b, same), "left")
    return of_all.select(*key, *[F.coalesce(f"p{p}", F.lit(0.0)).alias(f"p{p}") for p in percents], "n")


def numbers_of(text: Column) -> Column:
    return F.filter(S.trimmed(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1))), lambda x: x != "")


def numeric_recall(answer: Column, truth: Column) -> Column:
    """The share of the truth's numbers found in the answer as substrings; null without numbers."""
    wanted = numbers_of(truth)
    hits = F.filter(wanted, lambda w: F.contains(F.lower(answer), F.lower(w)))
    return F.when(F.size(wanted) > 0, F.size(hits) / F.size(wanted))


def diversity(titles: Column) -> Column:
    """Distinct titles by titles; 0 for none."""
    return F.when(F.size(titles) > 0, F.size(F.array_distinct(titles)) / F.size(titles)).otherwise(0.0)


def covered(titles: Column, keywords: Column) -> Column:
    """Is any keyword in any title, in any case?"""
    joined = F.lower(F.array_join(titles, " "))
    return F.exists(keywords, lambda k: F.contains(joined, F.lower(k)))


def questions_by_text(questions: DataFrame) -> DataFrame:
    """One row for each question text, the last by id."""
    return questions.groupBy("question").agg(F.max_by(F.struct(*[c for c in questions.columns if c != "question"]), "id").alias("q")).select("question", "q.*")


def rates(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """results: answer, is_covered, recall, diversity and the group columns; without errors. Strata without rows do not appear."""
    marks = F.size(S.citation_marks(F.col("answer")))
    measures = [
        F.round(F.avg((marks > 0).cast("int")), 3).alias("citation_present_rate"),
        F.round(F.avg(marks), 2).alias("avg_citations"),
        F.round(F.avg(F.col("is_covered").cast("int")), 3).alias("source_coverage_rate"),
        F.round(F.avg(S.word_count(F.col("answer"))), 2).alias("answer_words"),
        F.round(F.avg((F.length(F.trim("answer")) < 20).cast("int")), 3).alias("empty_answer_rate"),
        F.round(F.coalesce(F.avg("recall"), F.lit(0.0)), 3).alias("numeric_accuracy_rate"),
        F.round(F.avg("diversity"), 3).alias("diversity_avg"),
        F.count(F.lit(1)).alias("n"),
    ]
    return (results.groupBy(*by) if by else results).agg(*measures)


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """Reports (section, metric, value): differences of common numeric metrics and whether each is better, worse or the same."""
    both = a.select("section", "metric", F.col("value").alias("a")).join(b.select("section", "metric", F.col("value").alias("b")), ["section", "metric"]).where("a is not null and b is not null")
    delta = F.col("b") - F.col("a")
    better = (delta < 0) == F.col("metric").isin(*LOWER_IS_BETTER)
    return both.withColumn("delta", F.round(delta, 6)).withColumn("direction", F.when(F.abs(delta) < 1e-6, "same").when(better, "better").otherwise("worse"))


def unpivoted(wide: DataFrame, section: str) -> DataFrame:
    """section, metric, value for each numeric column of a one-row report."""
    numeric = [c for c, t in wide.dtypes if t in ("int", "bigint", "double", "float")]
    items = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numeric])
    return wide.select(F.lit(section).alias("section"), F.explode(items).alias("m")).select("section", "m.metric", "m.value")


def missing_fields(rows: DataFrame, required: list[str]) -> DataFrame:
    """The required fields that are null or empty in each row."""
    gone = F.array(*[F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(c)) for c in required])
    return rows.withColumn("missing", F.filter(gone, lambda x: x.isNotNull()))


def progress(rows: DataFrame, key: str = "status") -> DataFrame:
    """Rows, mean confidence and counts of three confidence classes for each status."""
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 4).alias("avg_confidence"), F.count_if(F.col("confidence") >= 0.7).alias("high"), F.count_if((F.col("confidence") >= 0.4) & (F.col("confidence") < 0.7)).alias("medium"), F.count_if(F.col("confidence") < 0.4).alias("low")
    )


def coverage(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents, chunks and embedded chunks of each domain; documents without chunks count."""
    return documents.join(chunks, "doc_id", "left").groupBy("domain").agg(F.count_distinct("doc_id").alias("documents"), F.count("chunk_id").alias("chunks"), F.count("embedded").alias("embedded"))
