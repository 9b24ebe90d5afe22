"""Names like a name: set-similarity search over letter trigrams, exact at a threshold.

A name's trigrams are put in order of how many names have them, rarest first. Two sets of a Jaccard similarity of t at least share a
trigram among their first n - ceil(t * n) + 1, and their sizes are within a factor of t; so only names that meet in such a prefix and
fit in size are compared. Equal names are compared once, and stand for all their rows afterwards. Frequent trigrams are at the end
of the order, beyond nearly all prefixes, so no trigram gathers all names.

Defined cases: names are compared in lower case, padded as in retrieval.trigram_similarity(); null names are like nothing; repeated
rows of an id count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..scratch import Scratch, sized
from .vectors import top_k


def grams(c: Column) -> Column:
    """The distinct trigrams of a name, two blanks before it and one behind."""
    padded = F.concat(F.lit("  "), F.lower(c), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) + 1), lambda i: F.substring(padded, i, F.lit(3))))


def similar_names(names: DataFrame, asked: DataFrame, least: float = 0.3, digits: int = 6) -> DataFrame:
    """asked, name, s: the pairs of lower-case names with a similarity of least or more. names: name; asked: name."""
    scratch = Scratch(names.sparkSession, "fuzzy")
    both = names.select(F.lower("name").alias("name"), F.lit(False).alias("a")).union(asked.select(F.lower("name").alias("name"), F.lit(True).alias("a")))
    both = scratch.save(both.where("name is not null").groupBy("name").agg(F.bool_or("a").alias("asked"), F.bool_or(~F.col("a")).alias("known")).withColumn("grams", grams(F.col("name"))), "names")
    seen = both.where("known or asked").select("name", F.explode("grams").alias("gram"))
    often = sized(scratch.save(seen.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "often"))
    ordered = seen.join(often, "gram").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("g"))
    ordered = ordered.withColumn("size", F.size("g")).withColumn("prefix", (F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1).cast("int"))
    heads = scratch.save(ordered.join(both.select("name", "asked", "known"), "name").select("name", "asked", "known", "size", F.explode(F.slice("g", F.lit(1), F.col("prefix"))["gram"]).alias("gram")), "heads")
    of = lambda flag, name: heads.where(flag).select(F.col("name").alias(name), F.col("size").alias(f"{name}_n"), "gram")
    fits = (F.col("asked_n") >= F.col("name_n") * least - 1e-9) & (F.col("name_n") >= F.col("asked_n") * least - 1e-9)
    met = of("asked", "asked").join(of("known", "name"), "gram").where(fits).select("asked", "name").distinct()
    sets = both.select("name", "grams")
    compared = met.join(sets, "name").join(sets.select(F.col("name").alias("asked"), F.col("grams").alias("_g")), "asked")
    shared = F.size(F.array_intersect("grams", "_g"))
    s = shared / (F.size("grams") + F.size("_g") - shared)
    return compared.select("asked", "name", s.alias("_s")).where(F.col("_s") >= least).select("asked", "name", F.round("_s", digits).alias("s"))


def fuzzy(names: DataFrame, asked: DataFrame, k: int, *, least: float = 0.3, digits: int = 6) -> DataFrame:
    """query_id, id, score, rank: the k likest rows of each query, by similarity and id. names: id, name; asked: query_id, name.

    Of rows with an equal name the k of least id are enough, so that a name with a third of all rows stays k rows."""
    pairs = similar_names(names, asked, least, digits)
    few = W.partitionBy("name").orderBy("id")
    rows = names.select("id", F.lower("name").alias("name")).where("name is not null").distinct().withColumn("_r", F.row_number().over(few)).where(F.col("_r") <= k).drop("_r")
    # The best k of each distinct name asked for, then once for each query of that name.
    best = top_k(pairs.join(rows, "name").select(F.col("asked").alias("query_id"), "id", F.col("s").alias("score")), k).withColumnRenamed("query_id", "asked")
    return asked.select("query_id", F.lower("name").alias("asked")).distinct().join(best, "asked").select("query_id", "id", "score", "rank")
