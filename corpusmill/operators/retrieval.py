"""Hybrid retrieval for batches of queries: exact vector search, term search, phrase and dictionary lookup, rank fusion,
injection, re-scoring, citations and a semantic cache.

Every function takes a table of queries, so a batch is one job; every ranking ends in an id, so it is total. Vectors are searched
in blocks (operators/vectors.py), texts by an index with places (operators/text_index.py) or by tries of many phrases
(operators/dictionary.py).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql import types as T

from ..functions import scalars as S, vocabulary as V
from ..scratch import Scratch, sized
from .dictionary import containing
from .fuzzy import grams
from .text_index import TextIndex, posted
from .vector_codes import coded, scale_of
from .vectors import nearest, top_k

K_RRF = 60


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is 0, of another length, or null."""
    product = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (product > 0), dot(a, b) / product).otherwise(F.lit(0.0))


def decode_vector(c: Column) -> Column:
    """'[0.1, 0.2]' as an array; null where it is none."""
    return F.from_json(c, T.ArrayType(T.FloatType()))


def knn(vectors: DataFrame, queries: DataFrame, k: int, *, floor: float | None = None, digits: int = 6) -> DataFrame:
    """query_id, id, score, rank. vectors: id, embedding; queries: query_id, embedding. Filters go on the inputs."""
    return top_k(nearest(vectors, queries, k, floor=floor, digits=digits), k)


def terms(c: Column, least: int = 1) -> Column:
    """Distinct lower-case runs of ASCII letters and digits of at least `least` characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(f"([a-z0-9]{{{least},}})"), F.lit(1)))


def term_index(docs: DataFrame, least: int = 1) -> DataFrame:
    """term, id, tf: the inverted index, written once and joined by each batch of queries."""
    return posted(docs, least)


def full_text(index: DataFrame, queries: DataFrame, n_docs: int, k: int, *, every: bool = True, digits: int = 6, source: Column | None = None) -> DataFrame:
    """query_id, id, score, matched, rank: documents with all (or any) terms of a query, by the sum of tf * idf. source: of what
    source a document is, by its id; then the best k of each source are found, and source is a column too. The wanted terms' postings
    are dealt out by document: a task has all of a document's, so only its best k of each query leave it."""
    scratch = Scratch(queries.sparkSession, "full-text")
    own = F.array_distinct("terms")
    wanted = scratch.save(queries.select("query_id", F.size(own).alias("_n"), F.explode(own).alias("term")), "wanted")
    index = index.join(sized(scratch.save(wanted.select("term").distinct(), "terms")), "term", "left_semi")
    frequency = index.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    idf = F.log1p(F.lit(float(n_docs)) / F.col("_df")).alias("_idf")
    weights = sized(scratch.save(wanted.join(frequency, "term").select("query_id", "_n", "term", idf), "weights"))
    hits = index.select("term", "id", "tf").repartition("id").join(weights, "term").groupBy("query_id", "id")
    found = hits.agg(F.round(F.sum(F.col("tf") * F.col("_idf")), digits).alias("score"), F.count(F.lit(1)).alias("matched"), F.max("_n").alias("_n"))
    if every:
        found = found.where(F.col("matched") == F.col("_n"))
    found = found.drop("_n")
    if source is None:
        return top_k(found, k)
    w = W.partitionBy("query_id", "source").orderBy(F.desc("score"), "id")
    return found.withColumn("source", source).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def expand(c: Column, abbreviations: dict[str, str]) -> Column:
    """Each abbreviation, in order and in any case, by its long form."""
    return reduce(lambda x, kv: F.regexp_replace(x, f"(?i)\\b{re.escape(kv[0])}\\b", kv[1]), abbreviations.items(), c)


def query_terms(c: Column, stop: list[str]) -> Column:
    """Words of three or more characters that are neither stop words nor digits alone."""
    words = S.words(F.regexp_replace(F.lower(c), "[?.,!;:()\\[\\]/+]", " "))
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(stop) & ~w.rlike("^[0-9]+$"))


def proper_phrases(c: Column, stop: list[str]) -> Column:
    """Acronyms in parentheses, then capitalised phrases, then upper-case tokens; else what stands before 'trial' or 'study'.
    The first spelling of each phrase stays."""
    every = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    inside, capital, upper = every(c, V.ACRONYM_INSIDE), every(c, V.CAPITAL_PHRASE), every(c, V.UPPER_WORDS)
    fine = lambda p: (F.length(F.trim(p)) >= 3) & ~F.lower(F.trim(p)).isin(stop)
    first = F.filter(S.trimmed(F.concat(inside, capital, upper)), fine)
    before = every(F.lower(c), V.BEFORE_TRIAL)
    tail = lambda p: F.array_join(F.slice(F.reverse(F.slice(F.reverse(F.filter(S.words(p), lambda w: ~w.isin(stop))), 1, 3)), 1, 3), " ")
    fallback = F.filter(F.transform(before, tail), fine)
    found = F.when(F.size(first) > 0, first).otherwise(fallback)
    return F.filter(found, lambda p, i: ~F.exists(F.slice(found, 1, i), lambda q: F.lower(q) == F.lower(p)))


def phrase_lookup(docs: DataFrame, phrases: DataFrame, limit: int = 4, index: TextIndex | None = None) -> DataFrame:
    """query_id, phrase, id, rank: shortest documents with each phrase, in any case. phrases: query_id, phrase. index: of docs; with
    it only documents that hold the phrase's terms in their places are read, and phrases without a whole term scan all texts."""
    docs = docs.select("id", "text")
    if index is None:
        found = containing(docs, phrases)
    else:
        own = phrases.where(F.length("phrase") > 0).select(F.lower("phrase").alias("phrase")).distinct()
        found, rest = index.holding(docs, own)
        found = found.select("phrase", "id", "text").unionByName(containing(docs, rest))
    best = found.select(F.col("phrase").alias("_p"), "id", F.length("text").alias("_n"))
    w = W.partitionBy("_p").orderBy("_n", "id")
    best = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return phrases.distinct().join(best, F.lower("phrase") == F.col("_p")).select("query_id", "phrase", "id", "rank")


def dictionary_pattern(names: list[str]) -> str:
    """One alternation, longest names first, with word ends."""
    return "(?i)\\b(" + "|".join(re.escape(n) for n in sorted(set(names), key=lambda n: (-len(n), n))) + ")\\b"


def mentions(docs: DataFrame, names: list[str]) -> DataFrame:
    """id, name, n: dictionary names in each text (longest first, whole words, any case). The dictionary is a bounded list."""
    found = F.regexp_extract_all(F.col("text"), F.lit(dictionary_pattern(names)), F.lit(1))
    return docs.select("id", F.explode(found).alias("name")).select("id", F.lower("name").alias("name")).groupBy("id", "name").agg(F.count(F.lit(1)).alias("n"))


def mention_weights(found: DataFrame, labels: DataFrame) -> DataFrame:
    """name, weight: 2 for each labelled chunk of the name, 1 for each other chunk that mentions it."""
    weighted = found.select("id", "name").distinct().join(labels, ["id", "name"], "left").select("name", F.when(F.col("is_label"), 2).otherwise(1).alias("w"))
    return weighted.groupBy("name").agg(F.sum("w").alias("weight"))


def weighted(lists: dict[str, DataFrame], weights: dict[str, float], *, k: int = K_RRF, top: int = 40) -> DataFrame:
    """Fusion of named searches by weights that sum to 1; a search without a weight, or with 0, is not run."""
    used = {n: w for n, w in weights.items() if w}
    if abs(sum(used.values()) - 1) > 1e-9 or not used.keys() <= lists.keys():
        raise ValueError("weights of known searches sum to 1")
    return rrf(*[lists[n] for n in used], k=k, top=top, weights=tuple(used.values()))


def rrf(*lists: DataFrame, k: int = K_RRF, top: int = 40, digits: int = 8, weights: tuple[float, ...] | None = None) -> DataFrame:
    """Reciprocal rank fusion of lists (query_id, id, rank): the sum of 1 / (k + rank), ties by the first list and rank. A table may
    hold several lists, told apart by a column source from 0."""
    weights = weights or (1.0,) * len(lists)
    all_ = reduce(DataFrame.union, [x.select("query_id", "id", F.struct(F.lit(i).alias("i"), (F.col("source") if "source" in x.columns else F.lit(0)).cast("int").alias("source")).alias("list"), "rank", F.lit(w).alias("w")) for i, (x, w) in enumerate(zip(lists, weights, strict=True))])
    # Dealt out here: Spark would take the union's lists for dealt out alike, as each is by query.
    fused = all_.repartition("query_id", "id").groupBy("query_id", "id").agg(F.round(F.sum(F.col("w") / (k + F.col("rank"))), digits).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    return top_k(fused, top, F.desc("score"), F.col("first"), F.col("id")).drop("first")


def concatenated(*lists: DataFrame) -> DataFrame:
    """One ranking of several sources, one after the other: the second begins where the first ends. A table may hold several, told
    apart by a column source."""
    own = lambda x: (F.col("source") if "source" in x.columns else F.lit(0)).cast("int")
    all_ = reduce(DataFrame.union, [x.select("query_id", "id", F.lit(i).alias("_list"), own(x).alias("_source"), F.col("rank").alias("_rank")) for i, x in enumerate(lists)])
    return all_.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("_list", "_source", "_rank"))).drop("_list", "_source", "_rank")


def inject(fused: DataFrame, extra: DataFrame, cap: int) -> DataFrame:
    """The first `cap` rows of extra (query_id, id, rank) that fused does not have, after fused."""
    new = extra.join(fused.select("query_id", "id"), ["query_id", "id"], "left_anti")
    new = new.withColumn("_k", F.row_number().over(W.partitionBy("query_id").orderBy("rank", "id"))).where(F.col("_k") <= cap)
    size = fused.groupBy("query_id").agg(F.max("rank").alias("_n"))
    added = new.join(size, "query_id", "left").select("query_id", "id", (F.coalesce("_n", F.lit(0)) + F.col("_k")).alias("rank"), F.lit(True).alias("injected"))
    return fused.select("query_id", "id", "rank", F.lit(False).alias("injected")).unionByName(added)


def hybrid(lists: list[DataFrame], phrases: DataFrame | None = None, direct: DataFrame | None = None, *, k: int = 40) -> DataFrame:
    """query_id, id, rank, injected: lists of any number of searches fused to k, then what a direct lookup and a search for exact
    phrases found beside, up to a third and a quarter of k (two and three at least)."""
    found = rrf(*lists, top=k).select("query_id", "id", "rank", F.lit(False).alias("injected"))
    for extra, cap in ((direct, max(2, k // 3)), (phrases, max(3, k // 4))):
        if extra is not None:
            more = inject(found, extra, cap)
            found = more.join(found.select("query_id", "id", F.col("injected").alias("_was")), ["query_id", "id"], "left").select("query_id", "id", "rank", (F.col("injected") | F.coalesce("_was", F.lit(False))).alias("injected"))
    return found


def citations(ranked: DataFrame) -> DataFrame:
    """query_id, key, id, position, index: titles of the same trimmed lower-case form share the first one's index from 1."""
    keyed = ranked.withColumn("key", F.lower(F.trim(F.coalesce("title", F.lit("")))))
    first = keyed.groupBy("query_id", "key").agg(F.min("rank").alias("position"), F.min_by("id", "rank").alias("id"))
    return first.withColumn("index", F.row_number().over(W.partitionBy("query_id").orderBy("position")))


def cited_only(cits: Column, answer: Column) -> Column:
    """The citations (structs with an index) whose mark is in the answer."""
    return F.filter(cits, lambda c: F.array_contains(S.citation_marks(answer), c["index"]))


def renumbered(answer: Column) -> Column:
    """Marks [n] numbered by first appearance. One pass over the text's parts between marks."""
    marks = F.array_distinct(S.citation_marks(answer))
    parts = F.regexp_extract_all(answer, F.lit("(\\[\\d+\\]|[^\\[]+|\\[)"), F.lit(1))
    number = lambda p: F.array_position(marks, F.regexp_extract(p, "(\\d+)", 1).cast("int"))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^\\[\\d+\\]$"), F.concat(F.lit("["), number(p).cast("string"), F.lit("]"))).otherwise(p)), "")


def compressed(answer: Column) -> Column:
    """Runs of adjacent marks, sorted and joined: [1][2][3][5] becomes [1-3][5]; duplicates begin a new group."""
    parts = F.regexp_extract_all(answer, F.lit("((?:\\[\\d+\\])+|[^\\[]+|\\[)"), F.lit(1))
    zero = F.lit(None).cast("struct<a:int,b:int>")
    start = F.struct(F.array().cast("array<struct<a:int,b:int>>").alias("done"), zero.alias("now"))

    def step(acc, x):
        grows = acc["now"].isNotNull() & (x == acc["now"]["b"] + 1)
        done = F.when(grows | acc["now"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["now"]))
        now = F.when(grows, F.struct(acc["now"]["a"].alias("a"), x.alias("b"))).otherwise(F.struct(x.alias("a"), x.alias("b")))
        return F.struct(done.alias("done"), now.alias("now"))

    show = lambda g: F.when(g["a"] == g["b"], F.format_string("[%d]", g["a"])).otherwise(F.format_string("[%d-%d]", g["a"], g["b"]))
    run = lambda p: F.array_join(F.aggregate(F.sort_array(S.citation_marks(p)), start, step, lambda a: F.transform(F.array_append(a["done"], a["now"]), show)), "")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^\\[\\d+\\]"), run(p)).otherwise(p)), "")


def truncated(c: Column, limit: int = 1800) -> Column:
    """At most limit characters, cut after the last full sentence if that lies in the second half."""
    head = F.substring(c, 1, limit)
    last = F.length(head) - F.locate(" .", F.reverse(head))  # 1-based place of the full stop
    found = F.locate(" .", F.reverse(head)) > 0
    return F.when(F.length(c) <= limit, c).when(found & (last - 1 > limit // 2), F.substring(head, F.lit(1), last)).otherwise(head)


def rerank(candidates: DataFrame, score: Column, keep: int = 10) -> DataFrame:
    """Best `keep` candidates by a scorer's column; rows without a score keep their order after the scored ones."""
    w = W.partitionBy("query_id").orderBy(F.desc_nulls_last("new_score"), "rank")
    return candidates.withColumn("new_score", score).withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= keep)


def overlap_score(question: Column, text: Column) -> Column:
    """The deterministic stand-in of a cross-encoder: the share of the question's terms in the text."""
    q = terms(question, 3)
    return F.when(F.size(q) == 0, F.lit(None)).otherwise(F.round(F.size(F.array_intersect(q, terms(text, 3))) / F.size(q), 6))


def semantic_cache(requests: DataFrame, asked: DataFrame, *, least: float = 0.92, hours: int = 24, digits: int = 6) -> DataFrame:
    """request_id, hit_id, score: for each request of asked the most similar earlier one of all requests within the time limit, if
    similar enough. Both: request_id, ts, embedding. Exact: blocks of requests meet where their times are near enough."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    past = requests.withColumn("id", F.col("request_id"))
    now = asked.withColumn("query_id", F.col("request_id"))
    hits = nearest(past, now, 1, floor=least, digits=digits, at=at, query_at=at, span=int(hours) * 3_600_000_000)
    return top_k(hits, 1).select(F.col("query_id").alias("request_id"), F.col("id").alias("hit_id"), "score")


def quantised(vectors: DataFrame, quantile: float = 0.99) -> tuple[DataFrame, float]:
    """Vectors as bytes, scaled so that the exact quantile of absolute values is 127; and that scale."""
    scale = scale_of(vectors, quantile)
    return vectors.withColumn("code", coded(F.col("embedding"), scale)), scale


def signature(c: Column, bits: int = 16, seed: int = 7) -> Column:
    """Signs of a vector's projections, for coarse buckets: its numbers weighed by the CRC-32 of (seed, bit, place), less half."""
    weight = lambda i, b: F.crc32(F.concat_ws(",", F.lit(str(seed)), F.lit(str(b)), i.cast("string")).cast("binary")) - (1 << 31)
    side = lambda b: F.aggregate(F.transform(c, lambda x, i: x.cast("double") * weight(i, b)), F.lit(0.0), lambda s, x: s + x) > 0
    return reduce(lambda a, b: a.bitwiseOR(F.when(side(b), F.lit(1 << b)).otherwise(F.lit(0))), range(bits), F.lit(0))


def evidence_grade(strength: Column, direction: Column, tier: Column, doc_type: Column, publisher: Column) -> Column:
    """The label of the top candidate: its graded recommendation, else its tier, with its publisher."""
    base = F.when(F.coalesce(strength, F.lit("")) != "", F.when(F.coalesce(direction, F.lit("")) != "", F.concat(strength, F.lit(" recommendation ("), direction, F.lit(")"))))
    named = F.when(doc_type == "drug", "Prescribing Information").when(tier == 1, "Clinical Guideline").when(tier == 2, "Systematic Review").when(tier == 3, "RCT Evidence").otherwise("Clinical Reference")
    label = F.coalesce(base, named)
    return F.when(F.coalesce(publisher, F.lit("")) != "", F.concat(label, F.lit(" · "), publisher)).otherwise(label)


def prompt_context(ranked: DataFrame) -> DataFrame:
    """One numbered context for each query: '[n] title' and content, in the order of rank."""
    piece = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit("\n"), F.col("content"))
    return ranked.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", piece.alias("p")))), lambda x: x["p"]), "\n\n").alias("context"))


def ranges_to_chunks(request: Column, chunks: DataFrame, spark_rows: DataFrame) -> DataFrame:
    """JSON [{"doc_id", "chunk_ranges": [[a, b], ...]}] to chunks; overlapping ranges give a chunk again. spark_rows holds the
    requests; chunks: doc_id, idx."""
    kind = "array<struct<doc_id: string, chunk_ranges: array<array<int>>>>"
    asked = spark_rows.select(F.explode(F.from_json(request, kind)).alias("r")).select("r.doc_id", F.explode("r.chunk_ranges").alias("span"))
    asked = asked.select(F.col("doc_id").try_cast("bigint").alias("_d"), F.get("span", F.lit(0)).alias("_a"), F.get("span", F.lit(1)).alias("_b"))
    return chunks.join(asked, (F.col("doc_id") == F.col("_d")) & F.col("idx").between(F.col("_a"), F.col("_b"))).drop("_d", "_a", "_b")


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of padded letter trigrams."""
    x, y = grams(a), grams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
