"""Secrets in texts, found by a trigram inverted index, in DataFrame functions only.

Each rule is a regular expression. From its syntax tree comes a Boolean query on trigrams: an OR of ANDs of the strings of three
characters that every match must hold, in lower case. Texts are scanned once for the trigrams that any query names; the postings
(trigram, document) are written in order of trigram, so that a search reads those of its rules alone and a frequent trigram lies in
many files. A document's postings meet in an aggregate on the document, the ANDs and ORs are taken there, and only the candidates'
texts are searched with the rule. Rules without a trigram that every match must hold, such as runs of hexadecimal digits, are
searched for in all texts, in the scan that finds the trigrams. An index of all trigrams would give the same candidates.

Spark's functions tell what matches, not where. The matches and the pieces between them give the places: matches become rows, and
sums along a document turn their lengths into code points.

The trigrams of a text are taken in lower case, which maps A-Z to a-z and may map other characters to these: that adds candidates,
and loses none. Candidates are broadcast where they were weighed and found small; beyond that they meet the texts in a shuffle.

Defined cases: null text is empty; rows that repeat id and text each get a row; rows that share an id, null included, and not a
text are told apart by a hash of the text; spans of several rules may overlap; texts without secrets have the hash of the empty
string; very long texts are searched whole; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as token, _parser as syntax

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .host_rules import let
from .scratch import Scratch, sized


def either_case(word: str) -> str:
    """A pattern of an ASCII word in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """kind: its name; pattern: in the syntax that Java, RE2 and Python share; least: characters that a match needs (in `group`;
    matches with fewer are dropped after the search goes on behind them)."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


_NAMES = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), f"{either_case('api')}_?{either_case('key')}"])
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", "AKIA[A-Z0-9]+", 18),
    # Runs are maximal, so that the least length can stand in the pattern.
    Rule("hex", "[0-9a-f]{16,}"),
)
MORE = (
    Rule("pem", "-----BEGIN (?:[A-Z]+ ){0,4}PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,900}\.eyJ[A-Za-z0-9_-]{8,900}\.[A-Za-z0-9_-]{8,900}"),
    Rule("login", r"[a-z][a-z0-9+.-]{1,15}://[^\x00-\x20/?#:@]{1,128}:[^\x00-\x20/?#@]{1,128}@[A-Za-z0-9.-]+"),
    Rule("bearer", either_case("bearer") + r"\x20+[A-Za-z0-9._~+/=-]{20,}"),
)
RULES = BASE + MORE

#: An OR of ANDs of trigrams; TRUE holds for any text.
Query = frozenset[frozenset[str]]
TRUE: Query = frozenset([frozenset()])
#: Strings that are kept apart while a pattern is read, and ANDs of a query; beyond them a query says less, never more.
STRINGS, ANDS = 48, 64


def _least(query) -> Query:
    """Without ANDs that a shorter one makes needless."""
    return frozenset(a for a in query if not any(b < a for b in query))


def _and(a: Query, b: Query) -> Query:
    both = _least({x | y for x, y in product(a, b)})
    return both if len(both) <= ANDS else min(a, b, key=len)


def _or(parts) -> Query:
    found = _least(frozenset().union(*parts))
    return found if len(found) <= ANDS else TRUE


def _held(strings) -> Query:
    """What texts hold that have one of the strings."""
    return _or({frozenset(s[i : i + 3] for i in range(len(s) - 2))} for s in strings)


def _characters(items) -> set[str] | None:
    """The characters of a class in lower case; None for large or negated ones."""
    found: set[str] = set()
    for kind, value in items:
        if kind is token.LITERAL:
            found.add(chr(value).lower())
        elif kind is token.RANGE and value[1] - value[0] < STRINGS:
            found.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return None
    return found if len(found) <= 8 else None


def _read(tree) -> tuple[set[str] | None, Query]:
    """(the strings that a part of a pattern can be, or None if they are many; what must be held beside them)."""
    strings, query, whole = {""}, TRUE, True
    for kind, value in tree:
        part, beside = None, TRUE
        if kind is token.LITERAL:
            part = {chr(value).lower()}
        elif kind is token.IN:
            part = _characters(value)
        elif kind is token.SUBPATTERN:
            part, beside = _read(value[3])
        elif kind is token.BRANCH:
            read = [_read(x) for x in value[1]]
            if all(s is not None and q == TRUE for s, q in read):
                part = set().union(*(s for s, _ in read))
            else:
                beside = _or(_and(q, _held(s)) if s is not None else q for s, q in read)
        elif kind in (token.MAX_REPEAT, token.MIN_REPEAT):
            low, high, inner = value
            some, must = _read(inner)
            if some is not None and must == TRUE and high != token.MAXREPEAT and high <= 3 and len(some) ** high <= STRINGS:
                part = {"".join(x) for n in range(low, high + 1) for x in product(some, repeat=n)}
            elif low:
                beside = _and(must, _held(some)) if some is not None else must
        elif kind is token.AT:
            continue
        if part is not None and beside == TRUE and len(strings) * len(part) <= STRINGS:
            strings = {a + b for a, b in product(strings, part)}
            continue
        # Here the strings at hand end, and others begin.
        query, whole = _and(query, _and(_held(strings), beside)), False
        strings = part if part is not None and beside == TRUE else {""}
    return (strings, TRUE) if whole else (None, _and(query, _held(strings)))


def trigram_query(pattern: str) -> Query:
    """The trigrams, in lower case, that texts with a match of the pattern hold: an OR of ANDs. TRUE: such texts may hold any."""
    strings, query = _read(syntax.parse(pattern))
    return _held(strings) if strings is not None else query


def _scanned(text: Column, rule: Rule, number: int) -> Column:
    """kind, and for each match what lies before it, its length, and whether it is long enough."""
    size = lambda x: F.length(x)
    matches = lambda g: F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(g)), size)
    gaps = F.transform(F.split(text, rule.pattern, -1), size)
    return F.struct(F.lit(number).alias("kind"), F.arrays_zip(gaps.alias("gap"), matches(0).alias("size"), matches(rule.group).alias("told")).alias("at"))


def _found(text: Column, rules: dict[int, Rule], asked) -> Column:
    """An array of _scanned() for the rules that are asked for and match."""
    return F.array_compact(F.array(*[F.when(asked(n) & F.rlike(text, F.lit(r.pattern)), _scanned(text, r, n)) for n, r in rules.items()]))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def forward(texts: DataFrame, trigrams: list[str], scan: dict[int, Rule]) -> DataFrame:
    """doc_id, th, the trigrams that the text holds, and the matches of the rules that scan all texts."""
    named = F.array(*map(F.lit, trigrams)) if trigrams else F.array().cast("array<string>")
    held = let(F.lower("text"), lambda low: F.filter(named, lambda t: F.contains(low, t)))
    return texts.select("doc_id", "th", held.alias("trigrams"), _found(F.col("text"), scan, lambda n: F.lit(True)).alias("found") if scan else F.lit(None).alias("found"))


def postings(index: DataFrame) -> DataFrame:
    """The index inverted: a row for each trigram and document, in order of trigram."""
    return index.select(F.explode("trigrams").alias("trigram"), "doc_id", "th").repartitionByRange("trigram", "th").sortWithinPartitions("trigram", "th")


def candidates(posted: DataFrame, queries: dict[int, Query]) -> DataFrame:
    """doc_id, th and the numbers of the rules whose queries hold: a document's postings are intersected by bits."""
    named = sorted(set().union(*(a for q in queries.values() for a in q)))
    word, bit = {t: i // 62 for i, t in enumerate(named)}, {t: 1 << i % 62 for i, t in enumerate(named)}
    sets = [F.bit_or(F.coalesce(*[F.when(F.col("trigram") == t, F.lit(bit[t])) for t in named if word[t] == w], F.lit(0)).cast("long")).alias(f"w{w}") for w in range(len(named) // 62 + 1) if any(v == w for v in word.values())]
    held = posted.where(F.col("trigram").isin(named)).groupBy("doc_id", "th").agg(*sets)

    def conjunction(trigrams) -> Column:
        masks: dict[int, int] = {}
        for t in trigrams:
            masks[word[t]] = masks.get(word[t], 0) | bit[t]
        return reduce(Column.__and__, [F.col(f"w{w}").bitwiseAND(F.lit(m).cast("long")) == m for w, m in masks.items()])

    holds = {n: reduce(Column.__or__, [conjunction(a) for a in sorted(map(sorted, q))]) for n, q in queries.items()}
    return held.select("doc_id", "th", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in holds.items()])).alias("rules")).where(F.size("rules") > 0)


def scan_secrets(df: DataFrame, *, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, and spans: an array of (start, kind, end), by start and then in the order of the rules; code points, end exclusive;
    kind is the rule's number."""
    spark = df.sparkSession
    scratch = Scratch(spark, "secret-index")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    queries = {n: trigram_query(r.pattern) for n, r in enumerate(rules)}
    indexed = {n: q for n, q in queries.items() if q != TRUE}
    scan = {n: rules[n] for n in queries if n not in indexed}
    named = sorted(set().union(*(a for q in indexed.values() for a in q))) if indexed else []
    index = scratch.save(forward(texts, named, scan), "index")
    found = []
    if indexed:
        posted = scratch.save(postings(index), "postings")
        chosen = sized(scratch.save(candidates(posted, indexed), "candidates"))
        verified = texts.join(chosen, _same(texts, chosen)).select(texts["doc_id"], texts["th"], _found(texts["text"], {n: rules[n] for n in indexed}, lambda n: F.array_contains("rules", n)).alias("found"))
        found.append(verified)
    if scan:
        found.append(index.select("doc_id", "th", "found"))
    if not found:
        return index.select("doc_id", F.array().cast("array<struct<start:long,kind:int,end:long>>").alias("spans"))
    each = [f.select("doc_id", "th", F.explode("found").alias("f")).select("doc_id", "th", "f.kind", "f.at") for f in found]
    # Rows that repeat id and text have the same matches: one of them stands for all.
    once = reduce(DataFrame.union, each).groupBy("doc_id", "th", "kind").agg(F.first("at").alias("at"))
    rows = once.select("doc_id", "th", "kind", F.posexplode("at").alias("place", "m")).where("m.size is not null")
    upto = W.partitionBy("doc_id", "th", "kind").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("kind") + 1)
    rows = rows.withColumn("end", F.sum(F.col("m.gap") + F.col("m.size")).over(upto)).where(F.col("m.told") >= least)
    spans = rows.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct((F.col("end") - F.col("m.size")).alias("start"), "kind", "end"))).alias("spans"))
    spans = spans.select("doc_id", "th", "spans")
    spans = scratch.save(spans, "spans")
    spans = sized_spans(spans)
    out = index.select("doc_id", "th")
    return out.join(spans, _same(out, spans), "left").select(out["doc_id"], F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("spans"))


def sized_spans(spans: DataFrame) -> DataFrame:
    """Broadcast where the spans fit."""
    return sized(spans)


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> DataFrame:
    """The spans as text, their numbers, and a hash of those of the first rules."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    shown = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda n: F.size(F.filter("spans", lambda s: s["kind"] == n)).cast("long")
    first = F.filter("spans", lambda s: s["kind"] < base)
    return found.select("doc_id", *[of(n).alias(f"n_{r.kind}") for n, r in enumerate(rules[:base])], F.sha2(shown(first), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def oracle_sql(rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> str:
    """The same rows by searching every text with every rule."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    scans = " UNION ALL ".join(
        f"""SELECT k, {n} AS kind, {r.least} AS least, unnest(range(1, len(m) + 1)) AS i, unnest(g[1:len(m)]) AS gap, unnest(m) AS m, unnest(told) AS told
      FROM (SELECT k, string_split_regex(t, {quoted(r.pattern)}) AS g, regexp_extract_all(t, {quoted(r.pattern)}, 0) AS m, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS told FROM d)"""
        for n, r in enumerate(rules)
    )
    names = "[" + ", ".join(f"'{r.kind}'" for r in rules) + "]"
    counts = ", ".join(f"coalesce(count(*) FILTER (kind = {n}), 0)::BIGINT AS n_{r.kind}" for n, r in enumerate(rules[:base]))
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT k, kind, least, length(told) AS told, length(m) AS size, sum(length(gap) + length(m)) OVER (PARTITION BY k, kind ORDER BY i) AS e FROM ({scans})),
p AS (SELECT k, kind, e - size AS a, {names}[kind + 1] || ':' || (e - size)::BIGINT || ':' || e::BIGINT AS span FROM s WHERE told >= least),
g AS (SELECT k, {counts}, string_agg(span, ',' ORDER BY a, kind) FILTER (kind < {base}) AS base, string_agg(span, ',' ORDER BY a, kind) AS spans FROM p GROUP BY k)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in rules[:base])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (k)
"""
