"""Text, page and chunk queries over documents, pages and lines."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import display as Dsp, scalars as S, text as X, vocabulary as V
from ..operators import chunking as K
from ..sources import html as H
from .base import first_match_sql, literal, query, spliced, spliced_sql, table


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")


WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"


@query("word_counts", f"SELECT doc_id, len({WORDS}) AS words, length(text) AS chars FROM documents")
def word_counts(spark, d):
    return docs(spark, d).select("doc_id", S.word_count(F.col("text")).cast("long").alias("words"), F.length("text").cast("long").alias("chars"))


@query("chunk_words_400_50", f"""SELECT doc_id, i // 350 AS k, array_to_string(w[i + 1:i + 400], ' ') AS chunk FROM (SELECT doc_id, w, unnest(range(0, len(w), 350)) AS i FROM (SELECT doc_id, {WORDS} AS w FROM documents)) WHERE len(w[i + 1:i + 400]) >= 60""")
def chunk_words_400_50(spark, d):
    w = S.words(F.col("text"))
    return docs(spark, d).select("doc_id", F.posexplode(K.windows(w, 400, 350, 60)).alias("k", "chunk")).withColumn("k", F.col("k").cast("long"))


def packed_sql(pieces: str, size: str, most: int, overlap: int, joint: str = " ") -> str:
    """Chunks (key, k, chunk) of pieces (key, p: a list of texts), as the greedy rule is stated: a piece that does not fit closes
    the chunk, and the next one begins with the last whole pieces that fit in the overlap. One step of recursion for each piece."""
    return f"""(WITH RECURSIVE src AS (SELECT key, p, list_transform(p, lambda x: {size}) AS n FROM ({pieces}) WHERE len(p) > 0),
    pre AS (SELECT key, p, n, list_prepend(0::BIGINT, list_transform(range(1, len(n) + 1), lambda i: list_sum(n[1:i])::BIGINT)) AS s FROM src),
    st(key, i, a, cut) AS (
      SELECT key, 2::BIGINT, 1::BIGINT, NULL::BIGINT FROM pre
      UNION ALL
      SELECT key, i + 1, CASE WHEN NOT is_full THEN a ELSE coalesce(list_min(list_filter(range(a, i), lambda j: s[i] - s[j] <= {overlap})), i) END, CASE WHEN is_full THEN a END
      FROM (SELECT st.key, i, a, s, s[i + 1] - s[a] > {most} AS is_full FROM st JOIN pre USING (key) WHERE i <= len(pre.p))),
    ends AS (SELECT key, cut AS a, i - 1 AS b FROM st WHERE cut IS NOT NULL UNION ALL SELECT st.key, st.a, len(pre.p) + 1 FROM st JOIN pre USING (key) WHERE st.i = len(pre.p) + 1)
    SELECT key, row_number() OVER (PARTITION BY key ORDER BY a, b) - 1 AS k, array_to_string(p[a:b - 1], {literal(joint)}) AS chunk FROM ends JOIN pre USING (key))"""


N_WORDS = r"len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> ''))"
SENTENCES = r"string_split(regexp_replace({}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


def _windows_sql(rows: str, most: int, step: int, least: int) -> str:
    """(key, k, j, chunk) of rows (key, k, w: words)."""
    return f"SELECT key, k, j // {step} AS j, array_to_string(w[j + 1:j + {most}], ' ') AS chunk FROM (SELECT *, unnest(range(0, len(w), {step})) AS j FROM ({rows})) WHERE len(w[j + 1:j + {most}]) >= {least}"


_W = r"list_filter(string_split_regex({}, '\s+'), lambda w: w <> '')"
_PACKED = packed_sql(f"SELECT doc_id AS key, {SENTENCES.format('text')} AS p FROM documents WHERE len({_W.format('text')}) > 120", N_WORDS, 120, 20)
_LINED = packed_sql(f"SELECT (key, k) AS key, string_split(chunk, chr(10)) AS p FROM c WHERE len({_W.format('chunk')}) > 120", N_WORDS, 120, 20, "\n")
_SENTENCE_CHUNKS = f"""WITH c AS MATERIALIZED {_PACKED}, l AS MATERIALIZED {_LINED},
o AS (
  SELECT doc_id AS key, 0 AS k, 0 AS m, 0 AS j, text AS chunk FROM documents WHERE len({_W.format('text')}) BETWEEN 10 AND 120
  UNION ALL SELECT key, k, 0, 0, chunk FROM c WHERE len({_W.format('chunk')}) BETWEEN 10 AND 120
  UNION ALL SELECT key[1], key[2], k, 0, chunk FROM l WHERE len({_W.format('chunk')}) BETWEEN 10 AND 120
  UNION ALL SELECT key[1], key[2], k, j, chunk FROM ({_windows_sql(f"SELECT key, k, {_W.format('chunk')} AS w FROM l WHERE len({_W.format('chunk')}) > 120", 120, 100, 10)}))
SELECT key AS doc_id, (row_number() OVER (PARTITION BY key ORDER BY k, m, j) - 1)::INT AS k, chunk FROM o"""


@query("chunk_sentences", _SENTENCE_CHUNKS)
def chunk_sentences(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(K.word_chunks(F.col("text"), 120, 10, 20)).alias("k", "chunk"))


_HARD = packed_sql(f"SELECT (doc_id, i) AS key, {SENTENCES.format('t')} AS p FROM g WHERE n > 200", N_WORDS, 200, 0)
_PARAGRAPH_CHUNKS = f"""WITH g AS MATERIALIZED (SELECT doc_id, i, t, len({_W.format('t')}) AS n FROM (SELECT doc_id, unnest(range(len(l))) AS i, trim(unnest(l), ' ') AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE t <> ''),
h AS MATERIALIZED {_HARD},
p AS (SELECT doc_id, i, 0 AS k, 0 AS j, t FROM g WHERE n <= 200 UNION ALL SELECT key[1], key[2], k, 0, chunk FROM h WHERE len({_W.format('chunk')}) <= 200
  UNION ALL SELECT key[1], key[2], k, j, chunk FROM ({_windows_sql(f"SELECT key, k, {_W.format('chunk')} AS w FROM h WHERE len({_W.format('chunk')}) > 200", 200, 200, 1)})),
b AS (SELECT doc_id AS key, list(t ORDER BY i, k, j) AS p FROM p GROUP BY doc_id)
SELECT key AS doc_id, k::INT AS k, chunk FROM {packed_sql("SELECT * FROM b", N_WORDS, 120, 20, chr(10) * 2)}"""


@query("chunk_paragraph_fold", _PARAGRAPH_CHUNKS)
def chunk_paragraph_fold(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(K.paragraph_chunks(F.col("text"), 200, 120, 20, split="\\n")).alias("k", "chunk"))


_CHAR_CHUNKS = rf"""WITH g AS MATERIALIZED (SELECT doc_id, i, t FROM (SELECT doc_id, unnest(range(len(l))) AS i, trim(unnest(l), ' ') AS t FROM (SELECT doc_id, string_split_regex(text, '\n{{2,}}') AS l FROM documents)) WHERE t <> ''),
p AS (SELECT doc_id, i, 0 AS j, t FROM g WHERE length(t) <= 800 UNION ALL SELECT doc_id, i, j, substr(t, j, 800) FROM (SELECT doc_id, i, t, unnest(range(1, length(t) + 1, 700)) AS j FROM g WHERE length(t) > 800)),
b AS (SELECT doc_id AS key, list(t ORDER BY i, j) AS p FROM p GROUP BY doc_id)
SELECT key AS doc_id, k::INT AS k, chunk FROM {packed_sql("SELECT * FROM b", "length(x) + 1", 801, 0, chr(10) * 2)}"""


@query("chunk_chars", _CHAR_CHUNKS)
def chunk_chars(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(K.char_chunks(F.col("text"), 800, 100)).alias("k", "chunk"))


LINES = "SELECT doc_id, unnest(range(len(l))) AS seq, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"


def lines(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\\n")).alias("seq", "text"))


@query("chunk_numbering", f"SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS chunk_total FROM ({LINES})")
def chunk_numbering(spark, d):
    return K.numbered(lines(spark, d)).select("doc_id", "seq", "chunk_index", "chunk_total")


@query("recommendation_ids", f"SELECT doc_id, seq, CASE WHEN seq % 3 = 0 THEN 'R' || sum((seq % 3 = 0)::INT) OVER (PARTITION BY doc_id ORDER BY seq) END AS recommendation_id FROM ({LINES})")
def recommendation_ids(spark, d):
    typed = lines(spark, d).withColumn("chunk_type", F.when(F.col("seq") % 3 == 0, "recommendation").otherwise("background"))
    return K.recommendation_ids(typed).select("doc_id", "seq", "recommendation_id")


@query("section_fill_forward", f"""WITH l AS ({LINES}), s AS (SELECT *, length(text) < 40 AS h FROM l), n AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY seq) AS section FROM s)
SELECT doc_id, section::BIGINT AS section, max(text) FILTER (WHERE h) AS heading, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY seq) FILTER (WHERE NOT h), '') AS text FROM n GROUP BY doc_id, section""")
def section_fill_forward(spark, d):
    return K.filled_sections(lines(spark, d).withColumn("is_heading", F.length("text") < 40)).withColumn("section", F.col("section").cast("long"))


_CRUMBS = f"""WITH h AS (SELECT doc_id, seq, 1 + length(text) % 3 AS level, text AS heading FROM ({LINES})),
l AS (SELECT *, max(CASE WHEN level = 1 THEN seq END) OVER w AS s1, max(CASE WHEN level = 2 THEN seq END) OVER w AS s2 FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
j AS (SELECT l.*, a.heading AS h1, b.heading AS h2 FROM l LEFT JOIN h a ON a.doc_id = l.doc_id AND a.seq = s1 LEFT JOIN h b ON b.doc_id = l.doc_id AND b.seq = s2)
SELECT doc_id, seq::INT AS seq, level::INT AS level, heading, list_filter([CASE WHEN level > 1 THEN h1 END, CASE WHEN level = 3 AND s2 > coalesce(s1, -1) THEN h2 END, heading], lambda x: x IS NOT NULL) AS path FROM j"""


@query("heading_breadcrumbs", _CRUMBS)
def heading_breadcrumbs(spark, d):
    heads = lines(spark, d).select("doc_id", "seq", (1 + F.length("text") % 3).alias("level"), F.col("text").alias("heading"))
    return K.breadcrumbs(heads, 3)


@query("recommendation_segments", f"""WITH t AS (SELECT doc_id, text || ' We recommend this. ' || source || ' It is recommended too. (1B)' AS t FROM documents),
p AS (SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(regexp_replace(t, {literal('(' + V.RECOMMENDATION + ')')}, chr(1) || '\\1', 'g'), chr(1)) AS l FROM t))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS k, i > 0 AS is_match, trim(s, ' ') AS text FROM p WHERE trim(s, ' ') <> ''""")
def recommendation_segments(spark, d):
    t = F.concat_ws(" ", F.col("text"), F.lit("We recommend this."), F.col("source"), F.lit("It is recommended too. (1B)"))
    return docs(spark, d).select("doc_id", F.posexplode(K.segments(t)).alias("k", "s")).select("doc_id", "k", "s.is_match", "s.text")


_HEADED = rf"""SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '(?m)^(.{{1,30}})$', '## \1', 'g') ELSE regexp_replace(text, '(?m)^([A-Z].{{3,30}})$', '3.1 \1', 'g') END AS t FROM documents"""


@query("detected_sections", rf"""WITH h AS ({_HEADED}),
c AS (SELECT doc_id, source, t, list_transform(string_split(regexp_replace(t, '(?m)^(#{{1,3}})\s+(.+)$', chr(1) || '\1' || chr(2) || '\2' || chr(2), 'g'), chr(1))[2:], lambda p: string_split(p, chr(2))) AS one,
  list_transform(string_split(regexp_replace(t, '(?m)^(\d+(?:\.\d+)*\.?\s+[A-Z][^\n]{{3,60}})$', chr(1) || '\1' || chr(2), 'g'), chr(1))[2:], lambda p: string_split(p, chr(2))) AS three FROM h),
l AS (SELECT *, list_filter(three, lambda p: len(list_filter(string_split_regex(p[2], '\s+'), lambda w: w <> '')) >= 60) AS long FROM c),
r AS (SELECT doc_id, unnest(range(len(one))) AS k, unnest(list_transform(one, lambda p: {{'title': trim(p[2], ' '), 'depth': length(p[1]), 'method': 'markdown_heading', 'text': trim(p[3], ' ')}})) AS s FROM l WHERE len(one) >= 3
  UNION ALL SELECT doc_id, unnest(range(len(long))), unnest(list_transform(long, lambda p: {{'title': trim(p[1], ' '), 'depth': 1, 'method': 'numbered_heading', 'text': trim(p[2], ' ')}})) FROM l WHERE len(one) < 3 AND len(three) >= 3 AND len(long) > 0
  UNION ALL SELECT doc_id, 0, {{'title': source, 'depth': 1, 'method': 'sliding_window', 'text': trim(t, ' ')}} FROM l WHERE len(one) < 3 AND (len(three) < 3 OR len(long) = 0))
SELECT doc_id, k::INT AS k, s.title AS title, s.depth::INT AS depth, s.method AS method, s.text AS text FROM r""")
def detected_sections(spark, d):
    """Short lines as headings, of one kind in every second document and of the other in the rest. The corpus has no headings in
    capitals."""
    even = F.col("doc_id") % 2 == 0
    t = F.when(even, F.regexp_replace("text", "(?m)^(.{1,30})$", "## $1")).otherwise(F.regexp_replace("text", "(?m)^([A-Z].{3,30})$", "3.1 $1"))
    return docs(spark, d).select("doc_id", F.posexplode(K.sections(t, F.col("source"))).alias("k", "s")).select("doc_id", "k", "s.*")


SIG = "['recommend','suggest','evidence','treatment','therapy','patient','clinical','diagnosis','monitor','dose','mg','risk','guideline','standard','protocol']"


@query("confidence_score", f"""SELECT doc_id, round(0.5 * CASE WHEN n < 20 THEN 0.1 WHEN n < 50 THEN 0.5 WHEN n < 400 THEN 1.0 ELSE 0.8 END + 0.2 * CASE WHEN regexp_matches(rtrim(text, ' '), '[.!?):]$') THEN 1.0 ELSE 0.7 END
 + 0.3 * least(1.0, len(list_filter({SIG}, lambda s: contains(lower(text), s))) / 3), 6)::DOUBLE AS confidence FROM (SELECT *, len({WORDS}) AS n FROM documents)""")
def confidence_score(spark, d):
    return docs(spark, d).select("doc_id", F.round(X.confidence(F.col("text"), S.word_count(F.col("text"))), 6).alias("confidence"))


def _flat(rules):
    return [m for k, _ in rules for m in ([k] if isinstance(k, str) else k)]


_TYPE_MARKERS = [*_flat(V.CHUNK_TYPES), "nothing"]


@query("chunk_type", f"SELECT doc_id, {first_match_sql('t', V.CHUNK_TYPES, literal('background'))} AS kind FROM (SELECT doc_id, lower(({spliced_sql(_TYPE_MARKERS)}) || ' ' || source) AS t FROM documents)")
def chunk_type(spark, d):
    """Whole texts, each with a marker of one of the types."""
    return docs(spark, d).select("doc_id", X.chunk_type(spliced(F.col("text"), _TYPE_MARKERS), F.col("source")).alias("kind"))


_GRADE_MARKERS = [f"{a.capitalize()} it, {b}." for (a, _), (b, _) in zip([*V.STRENGTHS, ("so", "")], [*V.EVIDENCE, ("", "")], strict=False)] + [b for b, _ in V.EVIDENCE] + ["nothing"]


@query("grade_detect", f"SELECT doc_id, {first_match_sql('t', V.STRENGTHS)} AS strength, {first_match_sql('t', V.EVIDENCE)} AS evidence FROM (SELECT doc_id, lower({spliced_sql(_GRADE_MARKERS)}) AS t FROM documents)")
def grade_detect(spark, d):
    t = spliced(F.col("text"), _GRADE_MARKERS)
    return docs(spark, d).select("doc_id", X.strength(t).alias("strength"), X.evidence(t).alias("evidence"))


#: What stands before and behind a text: a number with a grade, a grade letter, a number alone, a grade in brackets, nothing.
_FORMS = [("1.2.3", "(1B)"), ("9.3a", "A"), ("R12:", ""), ("Offer it [Strong] now:", ""), ("Recommendation 4", "[conditional]"), ("2.1", ". (2c)"), ("", "")]
_FORM = f"length(text) % {len(_FORMS)} + 1"
_REC = f"""SELECT doc_id, ([{', '.join(literal(a) for a, _ in _FORMS)}])[{_FORM}] || ' ' || text || ' ' || ([{', '.join(literal(b) for _, b in _FORMS)}])[{_FORM}] AS c FROM documents"""
_GRADE_SQL = "CASE grade " + " ".join(f"WHEN {literal(k)} THEN {literal(v[0])}" for k, v in V.GRADES.items()) + " END AS strength, CASE grade " + " ".join(f"WHEN {literal(k)} THEN {literal(v[1])}" for k, v in V.GRADES.items() if v[1]) + " END AS quality"


def _pattern(p):
    return literal(p)


@query("recommendation_fields", f"""WITH r AS ({_REC}), p AS (SELECT doc_id, c, trim(c, ' ') AS t FROM r),
f AS (SELECT doc_id, CASE WHEN regexp_matches(c, {_pattern(V.RECOMMENDATION_NUMBERED)}) THEN 1 WHEN regexp_matches(t, {_pattern(V.RECOMMENDATION_LETTERED)}) THEN 2 ELSE 3 END AS kind, c, t FROM p),
g AS (SELECT doc_id, CASE kind WHEN 1 THEN regexp_extract(c, {_pattern(V.RECOMMENDATION_NUMBERED)}, 1) WHEN 2 THEN regexp_extract(t, {_pattern(V.RECOMMENDATION_LETTERED)}, 1) ELSE nullif(regexp_extract(c, {_pattern(V.RECOMMENDATION_PLAIN)}, 1), '') END AS id,
 CASE kind WHEN 1 THEN lower(regexp_extract(c, {_pattern(V.RECOMMENDATION_NUMBERED)}, 3)) WHEN 2 THEN lower(regexp_extract(t, {_pattern(V.RECOMMENDATION_LETTERED)}, 3)) ELSE nullif(lower(regexp_extract(c, {_pattern(V.RECOMMENDATION_BRACKET)}, 1)), '') END AS grade FROM f)
SELECT doc_id, id, grade, {_GRADE_SQL} FROM g""")
def recommendation_fields(spark, d):
    n = F.pmod(F.length("text"), F.lit(len(_FORMS))) + 1
    side = lambda k: F.element_at(F.array(*[F.lit(f[k]) for f in _FORMS]), n.cast("int"))
    rec = docs(spark, d).select("doc_id", X.recommendation(F.concat_ws(" ", side(0), F.col("text"), side(1))).alias("r"))
    return rec.select("doc_id", "r.id", "r.grade", X.grade(F.col("r.grade"))["strength"].alias("strength"), X.grade(F.col("r.grade"))["quality"].alias("quality"))


_TAG_MARKERS = ["all adults", "Adult care", "children", "a paediatric dose", "newborn", "in pregnancy", "MATERNAL", "adolescents", "PLHIV", "HIV-positive", "metformin and insulin", "INH", "ART", "ferrous salts", "nothing"]


def _tags_sql(patterns):
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'regexp_matches(t, {literal(p)})' for p in ps)} THEN {literal(name)} END" for name, ps in patterns.items()) + "], lambda x: x IS NOT NULL), ',')"


@query("population_tags", f"SELECT doc_id, {_tags_sql(V.POPULATIONS)} AS populations, {_tags_sql(V.INTERVENTIONS)} AS interventions FROM (SELECT doc_id, {spliced_sql(_TAG_MARKERS)} AS t FROM documents)")
def population_tags(spark, d):
    t = spliced(F.col("text"), _TAG_MARKERS)
    return docs(spark, d).select("doc_id", F.array_join(X.population_tags(t), ",").alias("populations"), F.array_join(X.intervention_tags(t), ",").alias("interventions"))


_PLACE_MARKERS = [*_flat(V.PLACES), "elsewhere", "nowhere", "at sea"]


@query("geo_scope", f"SELECT doc_id, {first_match_sql('t', V.PLACES, literal('global'))} AS scope FROM (SELECT doc_id, lower(source || ' ' || ({spliced_sql(_PLACE_MARKERS)})) AS t FROM documents)")
def geo_scope(spark, d):
    return docs(spark, d).select("doc_id", X.scope(F.col("source"), spliced(F.col("text"), _PLACE_MARKERS)).alias("scope"))


_TITLE_MARKERS = [*_flat(V.TITLE_MARKERS), "biology", "its causes"]
_KINDS = [*[k.title() for k in V.PUBLICATION_TYPES], "Other", "Lecture"]
_ARTICLES = [*_flat(V.ARTICLE_MARKERS), "", "", "paper"]
_CLASS_SQL = f"""SELECT doc_id, list_filter([{', '.join(map(literal, ['Other', 'Journal']))}, CASE WHEN length(text) % 3 = 0 THEN ([{', '.join(map(literal, _KINDS))}])[length(text) % {len(_KINDS)} + 1] END], lambda x: x IS NOT NULL) AS types,
 CASE WHEN length(text) % 3 = 1 THEN ([{', '.join(map(literal, _ARTICLES))}])[length(text) % {len(_ARTICLES)} + 1] ELSE '' END AS article, lower({spliced_sql(_TITLE_MARKERS)}) AS title FROM documents"""
_KNOWN_SQL = "list_filter(list_transform(types, lambda p: CASE lower(p) " + " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in V.PUBLICATION_TYPES.items()) + " END), lambda x: x IS NOT NULL)[1]"


@query("doc_classify", f"""WITH c AS ({_CLASS_SQL}), k AS (SELECT doc_id, {_KNOWN_SQL} AS known, {first_match_sql('article', V.ARTICLE_MARKERS)} AS by_article, {first_match_sql('title', V.TITLE_MARKERS, literal('research_article'))} AS by_title FROM c),
t AS (SELECT doc_id, coalesce(CASE WHEN known = '' THEN 'exclude' ELSE known END, by_article, by_title) AS type FROM k)
SELECT doc_id, type, CASE type {' '.join(f'WHEN {literal(k)} THEN {v}' for k, v in V.TYPE_TIERS.items())} ELSE 5 END AS tier FROM t""")
def doc_classify(spark, d):
    """A third of the texts has a publication type, a third an article type, all have markers in what stands for the title."""
    n = F.length("text")
    one = lambda names: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    types = F.filter(F.array(F.lit("Other"), F.lit("Journal"), F.when(n % 3 == 0, one(_KINDS))), lambda x: x.isNotNull())
    c = X.document_class(types, F.when(n % 3 == 1, one(_ARTICLES)).otherwise(""), spliced(F.col("text"), _TITLE_MARKERS))
    return docs(spark, d).select("doc_id", c["type"].alias("type"), c["tier"].alias("tier"))


_BODY_MARKERS = [*[f"the {m} board" for m, _ in V.BODIES], *V.THIRD_RANK, "a clinic", "a ward"]


@query("issuing_body", f"SELECT doc_id, coalesce({first_match_sql('lower(trim(n))', V.BODIES)}, n) AS body FROM (SELECT doc_id, {spliced_sql(_BODY_MARKERS)} AS n FROM documents)")
def issuing_body(spark, d):
    """The rule is a substring's, so it also finds letters inside the corpus's words."""
    return docs(spark, d).select("doc_id", X.issuing_body(spliced(F.col("text"), _BODY_MARKERS)).alias("body"))


@query("sanitize_rows", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'recommendation' WHEN 1 THEN 'table' ELSE 'background' END AS chunk_type, CASE event_id % 4 WHEN 0 THEN 'infectious_disease' WHEN 1 THEN 'hiv' ELSE 'general_medicine' END AS domain,
 least(3, greatest(1, event_id % 9))::BIGINT AS evidence_tier, CASE WHEN event_id % 300 + 1850 BETWEEN 1900 AND 2100 THEN event_id % 300 + 1850 END AS pub_year,
 CASE event_id % 3 WHEN 0 THEN '2024-01-01' WHEN 1 THEN '2023-05-06' END AS date_published, CASE event_id % 2 WHEN 0 THEN 'strong' END AS grade_strength, CASE event_id % 2 WHEN 0 THEN 'A' END AS grade_symbol FROM events""")
def sanitize_rows(spark, d):
    i = F.col("event_id")
    text = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (i % len(v) + 1).cast("int"))
    columns = {
        "chunk_type": text("recommendation_statement", "table", "odd"), "document_type": F.lit("formulary"), "domain": text(" TB ", "hiv", "none", ""), "evidence_framework": F.lit("aha/acc"), "geographic_scope": F.lit("East Africa"),
        "evidence_tier": (i % 9).cast("string"), "section_depth": F.lit("9"), "pub_year": (i % 300 + 1850).cast("string"), "date_published": text("2024", "2023-05-06", "May 2023"),
        "grade_strength": text("Strong for", ""), "grade_symbol": F.lit("A"), "content_tokens": F.lit(0), "content": F.lit("a b"),
    }
    fixed = X.sanitized(columns)
    return table(spark, d, "events").select("event_id", *[fixed[c].alias(c) for c in ("chunk_type", "domain", "evidence_tier", "pub_year", "date_published", "grade_strength", "grade_symbol")])


@query("ocr_quality", "SELECT l_orderkey, CASE WHEN a / n >= 0.9 THEN 'clean' WHEN b / n >= 0.3 THEN 'ocr_low' WHEN a / n >= 0.5 THEN 'mixed' ELSE 'ocr_good' END AS quality FROM (SELECT l_orderkey, count(*) AS n, sum((l_returnflag = 'A')::INT) AS a, sum((l_returnflag = 'R')::INT) AS b FROM lineitem GROUP BY 1)")
def ocr_quality(spark, d):
    method = F.when(F.col("l_returnflag") == "A", "pymupdf").when(F.col("l_returnflag") == "R", "claude_low").otherwise("mistral_ocr")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(X.ocr_quality(method).alias("quality"))


@query("metadata_gate", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN least(0.6, x) ELSE x END AS confidence, CASE WHEN raw >= 0.7 THEN 'metadata_extracted' ELSE 'metadata_review' END AS status FROM (SELECT o_orderkey, o_totalprice / 400000 AS raw, least(1.0, greatest(0.0, o_totalprice / 400000)) AS x FROM orders)")
def metadata_gate(spark, d):
    g = X.metadata_gate(F.col("o_totalprice") / 400000, F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")))
    return table(spark, d, "orders").select("o_orderkey", g["confidence"].alias("confidence"), g["status"].alias("status"))


@query("display_names", "SELECT c_custkey, coalesce(nullif(trim(concat_ws(' ', nullif(CASE WHEN c_custkey % 3 = 0 THEN 'Ann ' || c_custkey END, ''), nullif(CASE WHEN c_custkey % 2 = 0 THEN 'Lee' END, ''))), ''), nullif(CASE WHEN c_custkey % 5 = 0 THEN 'u' || c_custkey END, ''), 'New User') AS name FROM customer")
def display_names(spark, d):
    k = F.col("c_custkey")
    first, last = F.when(k % 3 == 0, F.concat(F.lit("Ann "), k.cast("string"))), F.when(k % 2 == 0, "Lee")
    mail = F.when(k % 5 == 0, F.concat(F.lit("u"), k.cast("string"), F.lit("@x.org")))
    return table(spark, d, "customer").select("c_custkey", S.first_present(F.trim(F.concat_ws(" ", first, last)), F.split_part(mail, F.lit("@"), F.lit(1)), F.lit("New User")).alias("name"))


@query("name_backfill", "SELECT c_custkey, string_split(c_name, '#')[1] AS first_name, substr(c_name, position('#' IN c_name) + 1) AS last_name FROM customer")
def name_backfill(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.split_part("c_name", F.lit("#"), F.lit(1)).alias("first_name"), F.expr("substring(c_name, position('#' in c_name) + 1)").alias("last_name"))


@query("content_hashes", "SELECT doc_id, sha256(text) AS content_hash, md5(text)[1:12] AS short_hash FROM documents")
def content_hashes(spark, d):
    return docs(spark, d).select("doc_id", S.content_id(F.col("text")).alias("content_hash"), F.substring(F.md5("text"), 1, 12).alias("short_hash"))


@query("canonical_urls", "SELECT page_id, string_split(regexp_replace(lower(trim(url)), '/+$', ''), '#')[1] AS url FROM pages")
def canonical_urls(spark, d):
    return table(spark, d, "pages").select("page_id", S.canonical_url(F.col("url")).alias("url"))


@query("link_discovery", """SELECT page_id, len(list_distinct(list_transform(regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1), lambda h: string_split(string_split(h, '?')[1], '#')[1]))) AS n_links FROM pages""".replace("\\\\", "\\"))
def link_discovery(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(H.links(F.col("html"))).cast("long").alias("n_links"))


@query("js_rendered", r"""SELECT page_id, len(list_filter(regexp_extract_all(html, '(?is)<p(?:\s[^>]*)?>(.*?)</p>', 1), lambda p: length(trim(regexp_replace(p, '<[^>]*>', '', 'g'), ' ')) > 50)) < 3 AS js_rendered FROM pages""")
def js_rendered(spark, d):
    return table(spark, d, "pages").select("page_id", H.is_script_rendered(F.col("html")).alias("js_rendered"))


@query("html_sections")
def html_sections(spark, d):
    return H.html_sections(table(spark, d, "pages"), "page_id", "html")


@query("title_case", "SELECT p_partkey, upper(p_name[1:1]) || substr(p_name, 2, position(' ' IN p_name) - 1) || upper(substr(p_name, position(' ' IN p_name) + 1, 1)) || substr(p_name, position(' ' IN p_name) + 2) AS title FROM part")
def title_case(spark, d):
    return table(spark, d, "part").select("p_partkey", S.title_case(F.col("p_name")).alias("title"))


_SUGGESTED = r"""SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN 'Is ' ELSE 'What about the ' END || CASE WHEN w = '' THEN '' ELSE upper(w[1]) || lower(w[2:]) END || CASE WHEN doc_id % 3 = 0 THEN ' dose' ELSE ' of this' END || CASE WHEN doc_id % 7 = 0 THEN ' one.' ELSE ' one?' END AS s
FROM (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN f ELSE reverse(f) END AS w FROM (SELECT doc_id, text, coalesce(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')[1], '') AS f FROM documents))"""


@query("suggestion_grounding", rf"""WITH q AS ({_SUGGESTED}),
n AS (SELECT *, list_filter(string_split_regex(s, '[^\pL\pM\pN_]+'), lambda w: regexp_full_match(w, '[A-Z][A-Za-z]{{4,}}') AND lower(w) NOT IN ({', '.join(map(literal, V.SUGGESTION_STOP))})) AS names FROM q)
SELECT doc_id, ends_with(trim(s, ' '), '?') AND len(list_filter(string_split_regex(s, '\s+'), lambda w: w <> '')) >= 5
 AND (NOT regexp_matches(s, {literal(V.DRUG_QUESTION)}) OR (NOT ({' OR '.join(f"contains(lower(s), {literal(x)})" for x in V.NUTRITION)}) AND regexp_matches(text, {literal(V.DRUG_MARKERS)})))
 AND len(list_filter(names, lambda w: NOT contains(lower(text), lower(w)))) = 0 AS grounded FROM n""")
def suggestion_grounding(spark, d):
    """Suggestions from each text's first word, half of them with its letters turned round, some too short, some about doses."""
    k, first = F.col("doc_id"), F.coalesce(F.try_element_at(S.words(F.col("text")), F.lit(1)), F.lit(""))
    word = S.capitalised(F.when(k % 2 == 0, first).otherwise(F.reverse(first)))
    s = F.concat(F.when(k % 5 == 0, "Is ").otherwise("What about the "), word, F.when(k % 3 == 0, " dose").otherwise(" of this"), F.when(k % 7 == 0, " one.").otherwise(" one?"))
    return docs(spark, d).select("doc_id", X.grounded(s, F.col("text")).alias("grounded"))


@query("table_prose", "SELECT l_orderkey, 'key | part' || chr(10) || string_agg('key: ' || l_linenumber || '; part: ' || l_partkey, chr(10) ORDER BY l_linenumber, l_partkey) AS prose FROM lineitem GROUP BY 1")
def table_prose(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("r"))
    cells = F.transform("r", lambda x: F.array(x["l_linenumber"].cast("string"), x["l_partkey"].cast("string")))
    return rows.select("l_orderkey", K.table_prose(F.concat(F.array(F.array(F.lit("key"), F.lit("part"))), cells)).alias("prose"))


@query("font_headings", "SELECT count(*) AS n, sum((p_size >= 1.2 * u)::INT)::BIGINT AS headings FROM part JOIN (SELECT p_brand, min(s) AS u FROM (SELECT p_brand, p_size AS s, count(*) AS c, max(count(*)) OVER (PARTITION BY p_brand) AS m FROM part GROUP BY 1, 2) WHERE c = m GROUP BY 1 HAVING count(*) = 1) USING (p_brand)")
def font_headings(spark, d):
    """Brands with one commonest size only, as ties have no order."""
    p = table(spark, d, "part")
    counted = p.groupBy("p_brand", "p_size").count().withColumn("m", F.max("count").over(W.partitionBy("p_brand"))).where("count = m")
    single = counted.groupBy("p_brand").count().where("count = 1").select("p_brand")
    spans = p.join(single, "p_brand").select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("seq"), F.col("p_size").alias("size"), F.col("p_name").alias("text"))
    return K.font_sections(spans).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_heading").cast("long")).alias("headings"))


@query("authority_rank", f"""SELECT doc_id, coalesce(({first_match_sql('n', V.RANKS)})::INT, CASE WHEN length(text) % 5 = 0 OR {' OR '.join(f'contains(n, {literal(t)})' for t in V.THIRD_RANK)} THEN 3 ELSE 4 END) AS rank
FROM (SELECT doc_id, text, lower(([{', '.join(map(literal, _BODY_MARKERS))}])[length(text) % {len(_BODY_MARKERS)} + 1] || ' of ' || source) AS n FROM documents)""")
def authority_rank(spark, d):
    n = F.length("text")
    body = F.concat(F.element_at(F.array(*map(F.lit, _BODY_MARKERS)), (n % len(_BODY_MARKERS) + 1).cast("int")), F.lit(" of "), F.col("source"))
    return docs(spark, d).select("doc_id", X.authority_rank(body, F.when(n % 5 == 0, "clinical_practice_guideline").otherwise("research_article")).alias("rank"))


@query("built_chunks")
def built_chunks(spark, d):
    """Documents with a recommendation behind each, chunked and enriched."""
    t = F.concat_ws(" ", F.col("text"), F.lit("We recommend 5 mg for adults twice daily; the dose is strong."), F.col("text"))
    return K.built_chunks(docs(spark, d).select("doc_id", F.col("source").alias("title"), t.alias("text")), most=120, least=10, overlap=20)


@query("source_pills", """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'WHO 2020' WHEN 1 THEN 'ABC' WHEN 2 THEN 'Lancet 2020' ELSE s_name[1:12] || '…' END AS pill FROM supplier""")
def source_pills(spark, d):
    k = F.col("s_suppkey") % 4
    publisher = F.when(k == 0, "the who office").when(k == 1, "Association of Big Clinics (ABC)").when(k == 2, "Lancet group")
    return table(spark, d, "supplier").select("s_suppkey", Dsp.source_pill(publisher, F.when(k % 2 == 0, 2020), F.col("s_name"), F.lit(1)).alias("pill"))


@query("listed_boxes", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'x' || chr(10) || '- a' || chr(10) || '- ' || p_name ELSE p_name END AS text FROM part")
def listed_boxes(spark, d):
    t = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("x\n☐ a. ☐ "), F.col("p_name"), F.lit("."))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", Dsp.listed_boxes(t).alias("text"))


@query("history_with_sources", """SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN text || chr(10) || chr(10) || 'Referenced sources:' || chr(10) || '[1] T — P · 2020' || chr(10) || '    Content: b' ELSE text END AS content FROM conversations""")
def history_with_sources(spark, d):
    cits = F.when(F.col("role") == "assistant", F.array(F.struct(F.lit(1).alias("index"), F.lit("T").alias("title"), F.lit("P").alias("publisher"), F.lit(2020).alias("year"), F.lit("b").alias("body"))))
    return table(spark, d, "conversations").select("conv_id", "turn", Dsp.with_sources(F.col("text"), cits).alias("content"))
