"""Retrieval queries. Benchmark items are the questions, documents the chunks, embeddings the vectors."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import vocabulary as V
from ..operators import dictionary as D, fuzzy as Fz, labels as Lb, retrieval as R, vector_codes as C
from ..operators.text_index import TextIndex
from ..operators.vector_index import VectorIndex
from ..scratch import once
from .base import query, table

COS = "list_dot_product(a.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])))"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _asked(spark, d):
    """The query set of searches: every row whose id is divisible by 20, against all rows."""
    return _vectors(spark, d).where(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), "embedding")


def _item_vectors(spark, d):
    """A vector for each benchmark item: the one of the same id."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    return _vectors(spark, d).select(F.col("id").alias("query_id"), "embedding").join(items, "query_id", "left_semi")


def _knn_sql(k, where="true", asked="q.vec_id % 20 = 0"):
    return f"""SELECT query_id, id, score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
        SELECT q.vec_id AS query_id, a.vec_id AS id, round({COS}, 6) AS score FROM embeddings a, embeddings q WHERE {asked} AND {where}))
      WHERE rank <= {k}"""


@query("knn_topk", _knn_sql(40))
def knn_topk(spark, d):
    return R.knn(_vectors(spark, d), _asked(spark, d), 40)


@query("knn_batch", _knn_sql(10))
def knn_batch(spark, d):
    return R.knn(_vectors(spark, d), _asked(spark, d), 10)


@query("knn_filtered", _knn_sql(5, "a.label <> 3"))
def knn_filtered(spark, d):
    return R.knn(_vectors(spark, d).where("label <> 3"), _asked(spark, d), 5)


@query("knn_one_label", _knn_sql(5, "a.label = 3"))
def knn_one_label(spark, d):
    return R.knn(_vectors(spark, d).where("label = 3"), _asked(spark, d), 5)


@query("knn_score_floor", f"SELECT * FROM ({_knn_sql(40)}) WHERE score >= 0.3")
def knn_score_floor(spark, d):
    return R.knn(_vectors(spark, d), _asked(spark, d), 40, floor=0.3)


@query("knn_int8", _knn_sql(10))
def knn_int8(spark, d):
    """The rows of exact search, found over codes of a byte."""
    return C.knn_by_codes(_vectors(spark, d), _asked(spark, d), 10)


@query("knn_ann")
def knn_ann(spark, d):
    """The query set against the index of all vectors, sent to as many lists as a recall of 0.95 takes on a sample of the queries.
    The lists hang on the sample that they are trained on; tests measure the recall."""
    vectors, asked = _vectors(spark, d), _asked(spark, d)
    index = VectorIndex.build(vectors)
    return R.top_k(index.nearest(asked, 10, probes=index.probes_for(vectors, asked, 10)), 10)


def _chunks(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _questions(spark, d):
    """The words of five letters or more of each benchmark item."""
    words = R.terms(F.col("text"), 5)
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("terms")).where(F.size("terms") > 0)


_FTS = """qs AS (SELECT item_id AS query_id, list_distinct_ordered AS terms FROM (
    SELECT item_id, (SELECT list(w ORDER BY p) FROM (SELECT w, min(p) AS p FROM (SELECT unnest(l) AS w, unnest(range(len(l))) AS p) GROUP BY w)) AS list_distinct_ordered
    FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]{5,}') AS l FROM benchmark))),
ix AS (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{5,}')) AS term FROM documents) GROUP BY 1, 2),
w AS (SELECT query_id, unnest(terms) AS term FROM qs),
df AS (SELECT term, count(*) AS df FROM ix GROUP BY 1),
h AS (SELECT query_id, id, round(sum(tf * ln(1 + (SELECT count(*) FROM documents)::DOUBLE / df)), 6) AS score, count(*) AS matched FROM ix JOIN w USING (term) JOIN df USING (term) GROUP BY 1, 2)"""


def _index(spark, d):
    """The index of the documents, built once a session and read by all searches for terms and phrases."""
    return once(spark, ("documents", d), lambda: TextIndex.build(_chunks(spark, d)))


def _search(spark, d, k, every):
    index = _index(spark, d)
    return R.full_text(index.terms(5), _questions(spark, d), index.n_docs, k, every=every)


@query("fts_and_topk", f"WITH {_FTS} SELECT query_id, id, score, matched, rank FROM (SELECT h.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM h JOIN qs USING (query_id) WHERE matched = len(terms)) WHERE rank <= 12")
def fts_and_topk(spark, d):
    return _search(spark, d, 12, True)


@query("fts_any_topk", f"WITH {_FTS} SELECT query_id, id, score, matched, rank FROM (SELECT h.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM h) WHERE rank <= 12")
def fts_any_topk(spark, d):
    return _search(spark, d, 12, False)


_HYBRID = f"""WITH {_FTS},
t AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM h),
v AS (SELECT query_id, id, rank FROM ({_knn_sql(40, asked='q.vec_id IN (SELECT item_id FROM benchmark)')})),
l AS (SELECT query_id, id, 0 AS list, rank FROM v UNION ALL SELECT query_id, id, 1, rank FROM t WHERE rank <= 40 AND query_id IN (SELECT query_id FROM v)),
f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score, min((list, rank)) AS first FROM l GROUP BY 1, 2),
r AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, id) AS rank FROM f)
"""


def _fused(spark, d, top):
    vector = R.knn(_vectors(spark, d), _item_vectors(spark, d), 40)
    text = _search(spark, d, 40, False).join(_item_vectors(spark, d).select("query_id"), "query_id", "left_semi")
    return R.rrf(vector, text, top=top)


@query("rrf_fuse", _HYBRID + "SELECT * FROM r WHERE rank <= 40")
def rrf_fuse(spark, d):
    return _fused(spark, d, 40).select("query_id", "id", "score", "rank")


@query("hybrid_weighted", _HYBRID.replace("sum(1.0::DOUBLE / (60 + rank))", "sum((CASE list WHEN 0 THEN 0.6 ELSE 0.4 END)::DOUBLE / (60 + rank))") + "SELECT * FROM r WHERE rank <= 40")
def hybrid_weighted(spark, d):
    """Vectors and terms by the weights of the older search; names like the question's are found, and weigh nothing there."""
    vector = R.knn(_vectors(spark, d), _item_vectors(spark, d), 40)
    text = _search(spark, d, 40, False).join(_item_vectors(spark, d).select("query_id"), "query_id", "left_semi")
    return R.weighted({"dense": vector, "sparse": text}, {"dense": 0.6, "sparse": 0.4, "ilike": 0.0, "fuzzy": 0.0}).select("query_id", "id", "score", "rank")


@query("rrf_inject", _HYBRID + """, b AS (SELECT * FROM r WHERE rank <= 10), e AS (
  SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank, id) AS k FROM t WHERE (query_id, id) NOT IN (SELECT query_id, id FROM b) AND query_id IN (SELECT query_id FROM b) AND rank <= 40)
SELECT query_id, id, rank, false AS injected FROM b UNION ALL SELECT query_id, id, 10 + k, true FROM e WHERE k <= 3""")
def rrf_inject(spark, d):
    extra = _search(spark, d, 40, False).join(_item_vectors(spark, d).select("query_id"), "query_id", "left_semi")
    return R.inject(_fused(spark, d, 10), extra, 3)


@query("hybrid_search", f"""WITH {_FTS},
s3 AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id % 3 AS s FROM h WHERE query_id IN (SELECT vec_id FROM embeddings)),
t AS (SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id, s ORDER BY rank) AS rank FROM s3),
v AS (SELECT query_id, id, rank FROM ({_knn_sql(40, asked='q.vec_id IN (SELECT item_id FROM benchmark)')})),
v3 AS (SELECT query_id, id, rank FROM ({_knn_sql(12, 'a.label = 3', 'q.vec_id IN (SELECT item_id FROM benchmark)')})),
l AS (SELECT query_id, id, 0 AS list, rank FROM v UNION ALL SELECT query_id, id, 1, rank FROM v3 UNION ALL SELECT query_id, id, 2 + s, rank FROM t WHERE rank <= 12),
f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score, min((list, rank)) AS first FROM l GROUP BY 1, 2),
r AS (SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, id) AS rank FROM f) WHERE rank <= 40),
p AS (SELECT item_id AS query_id, doc_id AS id, row_number() OVER (PARTITION BY item_id ORDER BY length(d.text), doc_id) AS k FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text)) WHERE item_id IN (SELECT query_id FROM r)),
e AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY k, id) AS k FROM p WHERE k <= 4 AND (query_id, id) NOT IN (SELECT query_id, id FROM r)),
a AS (SELECT * FROM r UNION ALL SELECT e.query_id, e.id, n + k FROM e JOIN (SELECT query_id, max(rank) AS n FROM r GROUP BY 1) USING (query_id) WHERE k <= 10),
c AS (SELECT query_id, id, rank, lower(trim(coalesce(source, ''))) AS key FROM a JOIN documents ON doc_id = id)
SELECT query_id, key, min(rank) AS position, arg_min(id, rank) AS id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS index FROM c GROUP BY query_id, key""")
def hybrid_search(spark, d):
    """Five searches (all vectors, vectors of one label, terms in three sources) fused to forty, exact phrases injected, cited by
    source."""
    asked, docs = _item_vectors(spark, d), _chunks(spark, d)
    ids = asked.select("query_id")
    index = _index(spark, d)
    terms = R.full_text(index.terms(5), _questions(spark, d).join(ids, "query_id", "left_semi"), index.n_docs, 12, every=False, source=F.col("id") % 3)
    vectors = [R.knn(_vectors(spark, d), asked, 40), R.knn(_vectors(spark, d).where("label = 3"), asked, 12)]
    phrases = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("phrase")).join(ids, "query_id", "left_semi")
    found = R.hybrid([*vectors, terms], R.phrase_lookup(docs, phrases, index=index))
    titles = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"))
    return R.citations(found.join(titles, "id"))


@query("fts_source_concat", f"""WITH {_FTS}, t AS (SELECT query_id, id, id % 3 AS s, row_number() OVER (PARTITION BY query_id, id % 3 ORDER BY score DESC, id) AS k FROM h)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s, k) AS rank FROM t WHERE k <= 4""")
def fts_source_concat(spark, d):
    index = _index(spark, d)
    hits = R.full_text(index.terms(5), _questions(spark, d), index.n_docs, 4, every=False, source=F.col("id") % 3)
    return R.concatenated(hits)


STOP = ", ".join(f"'{w}'" for w in V.QUERY_STOP)


@query("query_normalise", rf"""SELECT item_id, array_to_string(list_filter(string_split_regex(regexp_replace(lower(text), '[?.,!;:()\[\]/+]', ' ', 'g'), '\s+'), lambda w: len(w) >= 3 AND w NOT IN ({STOP}) AND NOT regexp_matches(w, '^[0-9]+$')), ' ') AS terms FROM benchmark""")
def query_normalise(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(R.query_terms(F.col("text"), V.QUERY_STOP), " ").alias("terms"))


@query("phrase_lookup", """WITH p AS (SELECT item_id AS query_id, text AS phrase FROM benchmark)
SELECT query_id, phrase, id, rank FROM (SELECT query_id, phrase, doc_id AS id, row_number() OVER (PARTITION BY query_id, phrase ORDER BY length(text), doc_id) AS rank
FROM documents JOIN p ON contains(lower(text), lower(phrase))) WHERE rank <= 4""")
def phrase_lookup(spark, d):
    phrases = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("phrase"))
    return R.phrase_lookup(_chunks(spark, d), phrases, index=_index(spark, d))


#: Each item's first three words as a phrase without its last word, or its fourth word with a phrase of its fifth and sixth.
_WEB = """w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark),
t AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS place FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)),
df AS (SELECT term, ln(1 + (SELECT count(DISTINCT doc_id) FROM documents)::DOUBLE / count(DISTINCT doc_id)) AS idf FROM t GROUP BY term),
i AS (SELECT item_id, 0 AS alt, 0 AS item, false AS neg, w[1:3] AS p FROM w UNION ALL SELECT item_id, 0, 1, true, w[-1:] FROM w
      UNION ALL SELECT item_id, 1, 2, false, w[4:4] FROM w UNION ALL SELECT item_id, 1, 3, false, w[5:6] FROM w),
o AS (SELECT item_id, item, len(p) AS n, unnest(p) AS term, unnest(range(len(p))) AS off FROM i),
s AS (SELECT o.item_id, o.item, t.doc_id, t.place - o.off AS start, any_value(n) AS n, count(*) AS m FROM o JOIN t USING (term) GROUP BY ALL),
m AS (SELECT item_id, item, doc_id, count(*) AS tf FROM s WHERE m = n GROUP BY ALL),
k AS (SELECT item_id, item, sum(idf) AS weight FROM o JOIN df USING (term) GROUP BY ALL),
h AS (SELECT m.item_id, alt, doc_id, count(*) FILTER (NOT neg) AS has, count(*) FILTER (neg) AS barred, sum(CASE WHEN neg THEN 0 ELSE tf * weight END) AS x
      FROM m JOIN i USING (item_id, item) JOIN k USING (item_id, item) GROUP BY ALL)"""


@query("fts_websearch", f"""WITH {_WEB},
b AS (SELECT item_id, doc_id, round(max(x), 6) AS score FROM h WHERE barred = 0 AND has = alt + 1 GROUP BY ALL)
SELECT item_id AS query_id, doc_id AS id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM b) WHERE rank <= 12""")
def fts_websearch(spark, d):
    """Phrases, exclusion and alternatives in one query of each item."""
    w = F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1))
    at = lambda i: F.get(w, F.lit(i))
    asked = F.concat(F.lit('"'), at(0), F.lit(" "), at(1), F.lit(" "), at(2), F.lit('" -'), F.element_at(w, -1), F.lit(" OR "), at(3), F.lit(' "'), at(4), F.lit(" "), at(5), F.lit('"'))
    return _index(spark, d).web_search(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), asked.alias("text")), 12)


@query("phrase_counts", r"""WITH w AS (SELECT item_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS p FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark)),
p AS (SELECT DISTINCT unnest(p) AS phrase FROM w),
t AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS place FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)),
b AS (SELECT doc_id, term || ' ' || lead(term) OVER (PARTITION BY doc_id ORDER BY place) AS phrase FROM t)
SELECT phrase, count(DISTINCT doc_id) AS n_docs, count(*) AS n FROM b JOIN p USING (phrase) GROUP BY phrase""")
def phrase_counts(spark, d):
    """How many documents hold each pair of neighbouring words of the items, and how often, from the index alone."""
    w = F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1))
    pairs = table(spark, d, "benchmark").select(w.alias("w")).where("size(w) > 1").select(F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.array(F.get("w", i), F.get("w", i + 1)))).alias("terms")).distinct()
    found = _index(spark, d).matches(pairs.select(F.array_join("terms", " ").alias("key"), "terms"))
    return found.groupBy(F.col("key").alias("phrase")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tf").alias("n"))


@query("dictionary_mentions", """SELECT l_orderkey AS id, p_name AS name, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2""")
def dictionary_mentions(spark, d):
    """The names of all parts as the dictionary, in texts that list the parts of each order."""
    part = table(spark, d, "part")
    lines = table(spark, d, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey"))
    lines = lines.select("l_orderkey", "l_linenumber", "l_suppkey", "p_name").repartition("l_orderkey")  # before the lists, which would hold a task's whole part
    texts = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey", "p_name"))), lambda x: x["p_name"]), " ").alias("text"))
    return D.mentions(texts, part.select(F.col("p_name").alias("name")))


@query("fuzzy_names", """WITH g AS (SELECT p_partkey AS id, p_partkey % 20 = 0 AS asked, list_distinct(list_transform(range(1, length(p_name) + 2), lambda i: substr('  ' || lower(p_name) || ' ', i, 3))) AS g FROM part),
s AS (SELECT q.id AS query_id, a.id, len(list_intersect(q.g, a.g)) / (len(q.g) + len(a.g) - len(list_intersect(q.g, a.g))) AS s FROM g q, g a WHERE q.asked)
SELECT query_id, id, score, rank FROM (SELECT query_id, id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, id) AS rank FROM s WHERE s >= 0.3) WHERE rank <= 40""")
def fuzzy_names(spark, d):
    names = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return Fz.fuzzy(names, names.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 40)


NAMES = ["the", "than", "inthe", "that", "von", "que", "dans", "er"]


@query("lexicon_mentions", rf"""SELECT id, name, count(*) AS n FROM (SELECT doc_id AS id, lower(unnest(string_split_regex(text, '[^\pL\pM\pN_]+'))) AS name FROM documents) WHERE name IN ({', '.join(f"'{n}'" for n in NAMES)}) GROUP BY 1, 2""")
def lexicon_mentions(spark, d):
    return R.mentions(_chunks(spark, d), NAMES)


@query("part_mentions", r"""SELECT id, name, count(*) AS n FROM (SELECT p_partkey AS id, lower(unnest(regexp_extract_all(p_name, '(?i)\b(widget|small|ring|bolt|blue|red)\b', 1))) AS name FROM part) GROUP BY 1, 2""")
def part_mentions(spark, d):
    return R.mentions(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), ["red", "blue", "ring", "widget", "bolt", "small"])


@query("mention_weights", r"""SELECT name, sum(CASE WHEN p_size > 25 AND name = 'ring' THEN 2 ELSE 1 END)::BIGINT AS weight FROM (SELECT DISTINCT p_partkey AS id, p_size, lower(unnest(regexp_extract_all(p_name, '(?i)\b(widget|ring|bolt)\b', 1))) AS name FROM part) GROUP BY 1""")
def mention_weights(spark, d):
    found = R.mentions(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), ["ring", "widget", "bolt"])
    labels = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("id"), F.lit("ring").alias("name"), F.lit(True).alias("is_label"))
    return R.mention_weights(found, labels)


@query("semantic_cache_hits", f"""WITH r AS (SELECT vec_id AS request_id, TIMESTAMP '2024-01-01' + to_hours(vec_id::INT) AS ts, embedding FROM embeddings)
SELECT request_id, hit_id, score FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, hit_id) AS k FROM (
  SELECT a.request_id, q.request_id AS hit_id, round({COS}, 6) AS score FROM r a JOIN r q ON q.ts < a.ts AND q.ts >= a.ts - INTERVAL 240 HOURS WHERE a.request_id % 20 = 0) WHERE score >= 0.3) WHERE k = 1""")
def semantic_cache_hits(spark, d):
    """The stated query set against all earlier requests."""
    ts = F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, 0, cast(vec_id as int), 0, 0)")
    requests = table(spark, d, "embeddings").select(F.col("vec_id").alias("request_id"), ts.alias("ts"), "embedding")
    return R.semantic_cache(requests, requests.where("request_id % 20 = 0"), least=0.3, hours=240)


#: Marks behind the sentences of a conversation's texts, one group after another.
_MARKS = ["[3]", "[1][2]", "", "[2][1][3]", "[12]", "[1][1]", "[4][5][7][6]", "[x]", "[]"]
_MARKED_SQL = f"""SELECT conv_id, turn, array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || CASE WHEN i < len(p) THEN '. ' || ([{', '.join(f"'{m}'" for m in _MARKS)}])[(turn + i) % {len(_MARKS)} + 1] || ' ' ELSE '' END), '') AS t FROM (SELECT conv_id, turn, string_split(text, '. ') AS p FROM conversations)"""


def _marked(spark, d):
    marks = F.array(*map(F.lit, _MARKS))
    behind = lambda i: F.concat(F.lit(". "), F.element_at(marks, ((F.col("turn") + i) % len(_MARKS) + 1).cast("int")), F.lit(" "))
    parts = table(spark, d, "conversations").select("conv_id", "turn", F.split("text", "\\. ").alias("p"))
    return parts.select("conv_id", "turn", F.array_join(F.transform("p", lambda x, i: F.concat(x, F.when(i + 1 < F.size("p"), behind(i + 1)).otherwise(""))), "").alias("t"))


@query("citation_renumber", rf"""WITH m AS ({_MARKED_SQL}), a AS (SELECT *, regexp_extract_all(t, '\[(\d+)\]', 1) AS n FROM m),
f AS (SELECT conv_id, turn, list(x ORDER BY k) AS seen FROM (SELECT conv_id, turn, x, min(k) AS k FROM (SELECT conv_id, turn, unnest(n) AS x, unnest(range(len(n))) AS k FROM a) GROUP BY ALL) GROUP BY ALL)
SELECT a.conv_id, a.turn, CASE WHEN len(n) = 0 THEN t ELSE array_to_string(list_transform(regexp_extract_all(t, '(\[\d+\]|[^\[]+|\[)', 1), lambda p: CASE WHEN regexp_full_match(p, '\[\d+\]') THEN '[' || list_position(seen, p[2:-2]) || ']' ELSE p END), '') END AS answer FROM a LEFT JOIN f USING (conv_id, turn)""")
def citation_renumber(spark, d):
    return _marked(spark, d).select("conv_id", "turn", R.renumbered(F.col("t")).alias("answer"))


@query("citation_compress", rf"""WITH m AS ({_MARKED_SQL}), p AS (SELECT conv_id, turn, unnest(regexp_extract_all(t, '((?:\[\d+\])+|[^\[]+|\[)', 1)) AS s, unnest(range(len(regexp_extract_all(t, '((?:\[\d+\])+|[^\[]+|\[)', 1)))) AS k FROM m),
n AS (SELECT conv_id, turn, k, x, row_number() OVER (PARTITION BY conv_id, turn, k ORDER BY x) AS r FROM (SELECT conv_id, turn, k, unnest(regexp_extract_all(s, '\[(\d+)\]', 1))::INT AS x FROM p WHERE s LIKE '[%' AND s <> '[')),
i AS (SELECT *, sum(CASE WHEN x = before + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn, k ORDER BY r) AS g FROM (SELECT *, lag(x) OVER (PARTITION BY conv_id, turn, k ORDER BY r) AS before FROM n)),
s AS (SELECT conv_id, turn, k, g, CASE WHEN min(x) = max(x) THEN '[' || min(x) || ']' ELSE '[' || min(x) || '-' || max(x) || ']' END AS shown FROM i GROUP BY ALL),
j AS (SELECT conv_id, turn, k, string_agg(shown, '' ORDER BY g) AS shown FROM s GROUP BY ALL)
SELECT conv_id, turn, string_agg(coalesce(j.shown, p.s), '' ORDER BY k) AS answer FROM p LEFT JOIN j USING (conv_id, turn, k) GROUP BY ALL""")
def citation_compress(spark, d):
    return _marked(spark, d).select("conv_id", "turn", R.compressed(F.col("t")).alias("answer"))


@query("rerank_overlap", f"""WITH {_FTS}, c AS (SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM h) WHERE rank <= 40),
s AS (SELECT query_id, id, rank, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]{{3,}}')) AS a, list_distinct(regexp_extract_all(lower(d.text), '[a-z0-9]{{3,}}')) AS w FROM c JOIN benchmark b ON item_id = query_id JOIN documents d ON doc_id = id),
r AS (SELECT query_id, id, rank, CASE WHEN len(a) > 0 THEN round(len(list_intersect(a, w)) / len(a), 6) END AS new_score FROM s)
SELECT query_id, id, new_score, new_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY new_score DESC NULLS LAST, rank) AS new_rank FROM r) WHERE new_rank <= 10""")
def rerank_overlap(spark, d):
    """The forty candidates of each term search, scored again by the stand-in."""
    questions = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    candidates = _search(spark, d, 40, False).join(questions, "query_id").join(_chunks(spark, d), "id")
    return R.rerank(candidates, R.overlap_score(F.col("q"), F.col("text"))).select("query_id", "id", "new_score", "new_rank")


@query("rerank_truncate", r"""SELECT doc_id, CASE WHEN length(text) <= 300 THEN text WHEN length(regexp_extract(substr(text, 1, 300), '^(.*)\. ', 1, 's')) > 150 THEN regexp_extract(substr(text, 1, 300), '^(.*)\. ', 1, 's') || '.' ELSE substr(text, 1, 300) END AS t FROM documents""")
def rerank_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", R.truncated(F.col("text"), 300).alias("t"))


@query("chunk_range_join", """WITH r AS (SELECT unnest([(1, 2, 4), (1, 3, 9), (7, 1, 2), (33, 0, 3)]) AS x)
SELECT l_orderkey AS doc_id, l_linenumber AS idx, l_partkey FROM lineitem JOIN r ON l_orderkey = x[1] AND l_linenumber BETWEEN x[2] AND x[3]""")
def chunk_range_join(spark, d):
    asked = spark.createDataFrame([('[{"doc_id": "1", "chunk_ranges": [[2, 4], [3, 9]]}, {"doc_id": "7", "chunk_ranges": [[1, 2]]}, {"doc_id": "33", "chunk_ranges": [[0, 3]]}]',)], "request string")
    chunks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("idx"), "l_partkey")
    return R.ranges_to_chunks(F.col("request"), chunks, asked)


@query("prompt_context", """SELECT l_orderkey AS query_id, string_agg('[' || k || '] p' || l_partkey || chr(10) || l_suppkey, chr(10) || chr(10) ORDER BY k) AS context
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) GROUP BY 1""")
def prompt_context(spark, d):
    rows = table(spark, d, "lineitem").withColumn("rank", F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")))
    return R.prompt_context(rows.select(F.col("l_orderkey").alias("query_id"), "rank", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("title"), F.col("l_suppkey").cast("string").alias("content")))


@query("evidence_grade", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'strong recommendation (for)' WHEN o_orderkey % 7 = 0 THEN 'Prescribing Information'
 WHEN o_orderkey % 4 = 1 THEN 'Clinical Guideline' WHEN o_orderkey % 4 = 2 THEN 'Systematic Review' WHEN o_orderkey % 4 = 3 THEN 'RCT Evidence' ELSE 'Clinical Reference' END || CASE WHEN o_orderstatus = 'F' THEN '' ELSE ' · ' || o_orderpriority END AS label FROM orders""")
def evidence_grade(spark, d):
    k = F.col("o_orderkey")
    label = R.evidence_grade(F.when(k % 5 == 0, "strong"), F.when(k % 5 == 0, "for"), k % 4, F.when(k % 7 == 0, "drug"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")))
    return table(spark, d, "orders").select("o_orderkey", label.alias("label"))


@query("trigram_similarity", """WITH g AS (SELECT p_partkey, p_name, list_distinct(list_transform(range(1, length(p_name) + 2), lambda i: substr('  ' || lower(p_name) || ' ', i, 3))) AS x,
 list_distinct(list_transform(range(1, 9 + 2), lambda i: substr('  ' || 'blue ring' || ' ', i, 3))) AS y FROM part)
SELECT p_partkey, round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 6) AS s FROM g""")
def trigram_similarity(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(R.trigram_similarity(F.col("p_name"), F.lit("blue ring")), 6).alias("s"))


_SCALE = """a AS (SELECT abs(x)::DOUBLE AS x FROM (SELECT unnest(embedding) AS x FROM embeddings)),
z AS (SELECT 127.0::DOUBLE / x AS scale FROM (SELECT x, row_number() OVER (ORDER BY x) AS r FROM a) WHERE r = (SELECT ceil(0.99 * count(*)) FROM a))"""


@query("int8_quantise", f"WITH {_SCALE} SELECT vec_id AS id, list_transform(embedding, lambda x: greatest(-127, least(127, round(x::DOUBLE * scale)))::INT) AS code FROM embeddings, z")
def int8_quantise(spark, d):
    coded, _ = R.quantised(_vectors(spark, d))
    return coded.select("id", F.transform("code", lambda x: x.cast("int")).alias("code"))


_BITS = 12


@query("lsh_buckets", f"""WITH RECURSIVE tab(i, k, v) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM tab WHERE k < 8),
s AS (SELECT b, i, '7,' || b || ',' || i AS s FROM range({_BITS}) x(b), (SELECT unnest(range(max(len(embedding)))) AS i FROM embeddings)),
crc(b, i, s, p, v) AS (SELECT b, i, s, 0, 4294967295 FROM s UNION ALL SELECT crc.b, crc.i, crc.s, p + 1, xor(crc.v >> 8, t.v) FROM crc JOIN tab t ON t.k = 8 AND t.i = xor(crc.v, ascii(substr(s, p + 1, 1))) & 255 WHERE p < length(s)),
w AS (SELECT b, i, xor(v, 4294967295) - 2147483648 AS w FROM crc WHERE p = length(s)),
x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
d AS (SELECT vec_id, b, sum(x * w) > 0 AS side FROM x JOIN w USING (i) GROUP BY ALL)
SELECT vec_id AS id, sum(CASE WHEN side THEN 1 << b::INT ELSE 0 END)::INT AS bucket FROM d GROUP BY vec_id""")
def lsh_buckets(spark, d):
    return _vectors(spark, d).select("id", R.signature(F.col("embedding"), _BITS).alias("bucket"))


@query("cosine_zero_safe", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS a, list_transform(embedding, lambda x: CASE WHEN vec_id % 4 = 0 OR x < 0 THEN 0.0 ELSE x::DOUBLE END)::DOUBLE[] AS b FROM embeddings)
SELECT vec_id, CASE WHEN list_dot_product(b, b) > 0 THEN round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) ELSE 0.0 END AS s FROM e""")
def cosine_zero_safe(spark, d):
    """Each vector and its positive part; a quarter of these are zero vectors."""
    positive = F.transform("embedding", lambda x: F.when((F.col("vec_id") % 4 == 0) | (x < 0), F.lit(0.0)).otherwise(x.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", F.round(R.cosine(F.col("embedding"), positive), 6).alias("s"))


@query("embedding_sanity", "SELECT len(embedding) AS dims, count(*) AS n, sum(len(list_filter(embedding, lambda x: x <> 0)))::BIGINT AS non_zero FROM embeddings GROUP BY 1")
def embedding_sanity(spark, d):
    e = table(spark, d, "embeddings")
    return e.groupBy(F.size("embedding").cast("long").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(F.filter("embedding", lambda x: x != 0))).alias("non_zero"))


@query("embedding_decode", "SELECT vec_id, len(embedding) AS dims FROM embeddings")
def embedding_decode(spark, d):
    text = F.to_json(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.size(R.decode_vector(text)).cast("long").alias("dims"))


def _labels(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("section"))


_SECTIONS = ["ECONOMY", "SMALL", "LARGE", "STANDARD", "PROMO", "MEDIUM"]
_HINTS = ((["widget"], "PROMO"), (["bolt", "ring"], "STANDARD"))
_LABEL_SQL = """q AS (SELECT p_brand AS query_id, max(p_name) AS text FROM part GROUP BY 1),
h AS (SELECT query_id, text, CASE WHEN contains(text, 'bolt') OR contains(text, 'ring') THEN ['STANDARD', 'ECONOMY', 'SMALL', 'LARGE', 'PROMO', 'MEDIUM'] WHEN contains(text, 'widget') THEN ['PROMO', 'ECONOMY', 'SMALL', 'LARGE', 'STANDARD', 'MEDIUM']
  ELSE ['ECONOMY', 'SMALL', 'LARGE', 'STANDARD', 'PROMO', 'MEDIUM'] END AS ord FROM q),
w AS (SELECT query_id, unnest(list_filter(string_split(text, ' '), lambda x: length(x) >= 5)) AS word FROM q),
n AS (SELECT query_id, name FROM (SELECT query_id, word, name, row_number() OVER (PARTITION BY query_id, word ORDER BY name) AS k FROM w JOIN (SELECT DISTINCT p_name AS name FROM part) ON contains(lower(name), word)) WHERE k <= 3),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY name) AS nn FROM (SELECT DISTINCT query_id, name FROM n)),
l AS (SELECT query_id, p_partkey AS id, p_name AS name, p_type AS section, nn, list_position(ord, p_type) AS pos FROM part JOIN o ON name = p_name JOIN h USING (query_id) WHERE nn <= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, name ORDER BY pos, id) AS r FROM l WHERE pos BETWEEN 1 AND 5)"""


@query("label_direct_lookup", f"WITH {_LABEL_SQL} SELECT query_id, id, name, section, row_number() OVER (PARTITION BY query_id ORDER BY nn, pos, id) AS rank FROM r WHERE r <= 4")
def label_direct_lookup(spark, d):
    """Brands ask after a part by its name, part names are labels, part types their sections; some names hint at a section."""
    questions = table(spark, d, "part").groupBy(F.col("p_brand").alias("query_id")).agg(F.max("p_name").alias("text"))
    return Lb.direct_lookup(questions, _labels(spark, d), sections=_SECTIONS, hints=_HINTS)


@query("label_augment", r"""WITH f AS (SELECT p_brand AS query_id, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rank, p_name AS content FROM part WHERE p_type = 'ECONOMY'),
m AS (SELECT query_id, lower(p) AS key, count(*) AS w FROM (SELECT query_id, id, unnest(list_distinct(regexp_extract_all(lower(content), '\b(small ring|red widget|blue bolt)\b', 1))) AS p FROM f) GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, key) AS n FROM m),
a AS (SELECT query_id, n, p_partkey AS id, row_number() OVER (PARTITION BY query_id, key ORDER BY p_partkey) AS r FROM b JOIN part ON p_name = key AND p_type = 'SMALL' WHERE n <= 5)
SELECT query_id, id, rank, false AS added FROM f UNION ALL SELECT a.query_id, a.id, x.m + row_number() OVER (PARTITION BY a.query_id ORDER BY n, a.id), true FROM a JOIN (SELECT query_id, max(rank) AS m FROM f GROUP BY 1) x USING (query_id) WHERE r <= 8""".replace("\\\\", "\\"))
def label_augment(spark, d):
    w = W.partitionBy("p_brand").orderBy("p_partkey")
    found = table(spark, d, "part").where("p_type = 'ECONOMY'").select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("id"), F.row_number().over(w).alias("rank"), F.col("p_name").alias("content"))
    return Lb.augmented(found, _labels(spark, d), ["small ring", "red widget", "blue bolt"], sections=["SMALL"])
