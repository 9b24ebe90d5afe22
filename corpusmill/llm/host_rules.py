"""Quality rules with a host level, in DataFrame functions only.

Each text gets counts and rule failures. The failures are summed by host, each host's rate is shrunk towards the other
hosts by a beta prior fitted to all host rates (empirical Bayes, by moments), and a host whose shrunk rate of any rule is
above the limit is rejected with all its documents.

Defined cases: null text counts as a text without words; a null host is the host ''; repeated rows count each time; with
one host, or hosts of equal rates, the prior has FALLBACK_STRENGTH; an empty table gives an empty table. Columns of the
input are taken by name and do not clash with the results' names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch, sized

#: Characters that separate words.
SPACES = " \t\n\x0b\x0c\r"
SPLIT = "[\\x20\\x09-\\x0D]+"
WINDOW = 5
#: Pseudo-documents behind the prior where the host rates do not spread.
FALLBACK_STRENGTH = 10.0
#: Bounds of the prior's strength.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1e6


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row even where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text; [''] for a text without words."""
    return F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES)), SPLIT)


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash is found twice or more: windows sorted by hash, those equal to a neighbour kept, their
    positions sorted again and the union of [position, position + WINDOW) measured by a fold."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def flagged(s: Column) -> Column:
        last = F.size(s) - 1
        same = lambda e, k: ((k > 0) & (F.get(s, k - 1)["h"] == e["h"])) | ((k < last) & (F.get(s, k + 1)["h"] == e["h"]))
        marked = F.transform(s, lambda e, k: F.when(same(e, k), e["i"]).otherwise(F.lit(-1)))
        return F.sort_array(F.filter(marked, lambda i: i >= 0))

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("int").alias("end"))
    step = lambda a, i: F.struct((a["n"] + (i + WINDOW) - F.greatest(i, a["end"])).cast("long").alias("n"), (i + WINDOW).cast("int").alias("end"))
    return let(ordered, lambda s: F.aggregate(flagged(s), start, step, lambda a: a["n"]))


def repeat_words(words: Column, n: Column) -> Column:
    """Words in WINDOW-word windows that occur twice or more in the text. Windows are compared by 64-bit hashes of their
    words; only texts in which two hashes are equal take the sorting path."""
    window = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)])
    hashes = F.transform(F.sequence(F.lit(0), n.cast("int") - WINDOW), window)
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(h)))
    return F.when(n < WINDOW, F.lit(0).cast("long")).otherwise(found)


def text_counts(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """doc id, host and the counts; the text itself is left behind here."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("words", words_of(F.col("text")))
    n = F.when(F.get("words", F.lit(0)) == "", F.lit(0)).otherwise(F.size("words")).cast("long")
    base = base.withColumn("n_words", n)
    lines = F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    return base.select(
        "doc_id",
        "host",
        "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        repeat_words(F.col("words"), F.col("n_words")).alias("n_repeat_words"),
    )


def failures() -> dict[str, Column]:
    """The rules, as failure conditions on the counts. They multiply rather than divide, so that no text has a rate of 0/0."""
    n = F.col("n_words")
    return {
        "short": n < 10,
        "repeats": 100 * F.col("n_repeat_words") > 20 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "dup_lines": 10 * F.col("n_dup_lines") > n,
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
    }


def host_verdicts(counts: DataFrame, max_rate: float) -> DataFrame:
    """host, n_docs, the shrunk failure rate of each rule, host_ok."""
    rules = failures()
    hosts = counts.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(c.cast("long")).alias(r) for r, c in rules.items()])
    rates = {r: F.col(r) / F.col("n_docs") for r in rules}
    # One row of sums and moments over the hosts, whatever their number.
    moments = hosts.agg(*[x for r in rules for x in (F.avg(rates[r]).alias(f"{r}_m"), F.var_pop(rates[r]).alias(f"{r}_v"))]).first()
    shrunk = []
    for r in rules:
        m, v = moments[f"{r}_m"] or 0.0, moments[f"{r}_v"] or 0.0
        strength = min(max(m * (1 - m) / v - 1, LEAST_STRENGTH), MOST_STRENGTH) if v > 1e-12 else FALLBACK_STRENGTH
        shrunk.append(((F.col(r) + F.lit(m * strength)) / (F.col("n_docs") + F.lit(strength))).alias(f"{r}_rate"))
    out = hosts.select("host", "n_docs", *shrunk)
    return out.withColumn("host_ok", F.greatest(*[F.col(f"{r}_rate") for r in rules]) <= max_rate)


def apply_host_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = 0.5) -> DataFrame:
    """A row for each document: its counts, base_failed, host, host_ok and kept.

    max_rate: a host whose shrunk failure rate of a rule is above it is rejected.
    The counts are written once and read twice, by the sum over hosts and by the join, which moves no text. The verdicts are
    written before the join: where the hosts fit they are broadcast, and beyond that both sides of the join are plain exchanges
    of written tables, of which Spark splits a host with a third of all documents.
    """
    scratch = Scratch(docs.sparkSession, "host-rules")
    counts = scratch.save(text_counts(docs, id_col, text_col, host_col), "counts")
    verdicts = sized(scratch.save(host_verdicts(counts, max_rate).select("host", "host_ok"), "verdicts"))
    rules = failures()
    failed = counts.withColumn("base_failed", rules["short"] | rules["repeats"])
    return failed.join(verdicts, "host", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("host_ok")).alias("kept"), "host", "host_ok"
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
win AS (SELECT k, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (SELECT k, i FROM win WHERE (k, g) IN (SELECT (k, g) FROM win GROUP BY k, g HAVING count(*) > 1)),
cov AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY k),
ln AS (SELECT k, l FROM (SELECT k, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT k, sum(c - 1) AS n FROM (SELECT k, l, count(*) AS c FROM ln GROUP BY k, l) GROUP BY k),
c AS (
  SELECT doc_id, host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cov USING (k) LEFT JOIN dup USING (k)),
f AS (
  SELECT *, n_words < 10 AS r1, 100 * n_repeat_words > 20 * n_words AS r2, 10 * n_symbols > n_words AS r3,
         10 * n_dup_lines > n_words AS r4, word_chars < 2 * n_words OR word_chars > 15 * n_words AS r5
  FROM c),
h AS (
  SELECT host, rule, count(*) AS n, sum(bad::INT) AS x
  FROM (SELECT host, unnest([1, 2, 3, 4, 5]) AS rule, unnest([r1, r2, r3, r4, r5]) AS bad FROM f) GROUP BY host, rule),
m AS (SELECT rule, avg(x / n) AS m, var_pop(x / n) AS v FROM h GROUP BY rule),
p AS (SELECT rule, m, CASE WHEN v > 1e-12 THEN least(greatest(m * (1 - m) / v - 1, 1.0), 1e6) ELSE 10.0 END AS s FROM m),
o AS (SELECT host, max((x + m * s) / (n + s)) <= 0.5 AS host_ok FROM h JOIN p USING (rule) GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (r1 OR r2) AS base_failed,
       (NOT (r1 OR r2) AND host_ok) AS kept, host, host_ok
FROM f JOIN o USING (host)
"""
