"""Product labels: names and sections looked up from questions, and added to what a search found.

labels: id, name, section, content. Questions and what is fetched for them stay bounded by the caps that the lookup is made of
(names of a question, sections of a name, rows of a section), which are parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import retrieval as R

#: Sections in the order of their use, and the words of a question that move one to the front, the last first.
SECTIONS = [
    "pharmacokinetics", "dosage_and_administration", "mechanism_of_action", "indications_and_usage", "adverse_reactions", "pharmacodynamics", "contraindications", "drug_interactions",
    "use_in_specific_populations",
]
HINTS = (
    (["pharmacokinetic", "absorption", "distribution", "clearance", "half-life"], "pharmacokinetics"),
    (["dos", "administration", "regimen"], "dosage_and_administration"),
    (["mechanism", "moa", "action"], "mechanism_of_action"),
    (["indicat", "approved", "use for"], "indications_and_usage"),
)
DOSE_SECTIONS = ["dosage_and_administration", "use_in_specific_populations"]


def section_order(question: Column, sections: list[str] | None = None, hints=HINTS) -> Column:
    """All sections, those that the question hints at first."""
    text = F.lower(question)
    hinted = [F.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words]), F.lit(name)) for words, name in reversed(list(hints))]
    found = F.filter(F.array(*hinted), lambda x: x.isNotNull())
    return F.array_distinct(F.concat(found, F.array(*map(F.lit, sections or SECTIONS))))


def candidate_words(question: Column, least: int = 5, most: int = 8) -> Column:
    return F.slice(F.array_distinct(F.filter(F.split(question, "[\\s,;]+"), lambda w: F.length(w) >= least)), 1, most)


def direct_lookup(questions: DataFrame, labels: DataFrame, *, sections: list[str] | None = None, hints=HINTS, per_word: int = 3, names: int = 3, top_sections: int = 5, rows: int = 4) -> DataFrame:
    """query_id, id, name, section, rank: label rows of the names that a question's words are part of. The names' dictionary is
    joined to the words, not the labels."""
    words = questions.select("query_id", F.explode(candidate_words(F.col("text"))).alias("word"))
    known = labels.select("name", F.col("name").alias("text")).distinct()
    first = R.containing(known, words.select(F.col("word").alias("phrase"))).select(F.col("phrase").alias("_w"), "name")
    first = first.withColumn("_k", F.row_number().over(W.partitionBy("_w").orderBy("name"))).where(F.col("_k") <= per_word).drop("_k")
    hits = words.join(first, F.lower("word") == F.col("_w")).select("query_id", "word", "name")
    hits = hits.withColumn("_k", F.row_number().over(W.partitionBy("query_id", "word").orderBy("name"))).where(F.col("_k") <= per_word)
    own = hits.select("query_id", "name").distinct().withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy("name"))).where(F.col("_n") <= names)
    wanted = own.join(questions.select("query_id", section_order(F.col("text"), sections, hints).alias("_order")), "query_id")
    found = labels.join(wanted, "name").withColumn("_at", F.array_position("_order", F.col("section"))).where(F.col("_at").between(1, top_sections))
    found = found.withColumn("_r", F.row_number().over(W.partitionBy("query_id", "name").orderBy("_at", "id"))).where(F.col("_r") <= rows)
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("_n", "_at", "id"))).select("query_id", "id", "name", "section", "rank")


def augmented(found: DataFrame, labels: DataFrame, names: list[str], *, most: int = 5, rows: int = 8, sections: list[str] | None = None) -> DataFrame:
    """found (query_id, id, rank, content), then the dose sections of the names that its texts mention most, without rows that
    are there already: query_id, id, rank, added."""
    pattern = R.dictionary_pattern(names)
    mentioned = found.select("query_id", "id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)), F.lower))).alias("key"))
    weight = mentioned.groupBy("query_id", "key").agg(F.count(F.lit(1)).alias("w"))
    best = weight.withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("w"), "key"))).where(F.col("_n") <= most)
    dose = labels.where(F.col("section").isin(sections or DOSE_SECTIONS)).withColumn("key", F.lower("name"))
    new = dose.join(best, "key").withColumn("_r", F.row_number().over(W.partitionBy("query_id", "key").orderBy("id"))).where(F.col("_r") <= rows)
    new = new.join(found.select("query_id", "id"), ["query_id", "id"], "left_anti")
    last = found.groupBy("query_id").agg(F.max("rank").alias("_last"))
    new = new.join(last, "query_id").withColumn("rank", F.col("_last") + F.row_number().over(W.partitionBy("query_id").orderBy("_n", "id")))
    return found.select("query_id", "id", "rank", F.lit(False).alias("added")).unionByName(new.select("query_id", "id", "rank", F.lit(True).alias("added")))
