"""How sources of one language differ in their words: mergeable radix tries of terms, with a counter for each source at the leaves.

Each partition counts the terms of its texts in byte tries, one for each language. A trie is kept as arrays, in the order in which
a walk over its bytes meets the leaves: the leaves' paths, and for each leaf its documents and its (source, occurrences) counters.
Terms become numbers in the trie's dictionary at once, without a Python object for a term. Tries are merged by prefix range: leaves
go to ranges of (language, bytes), so that a crowded prefix is split as any other, and each range merges what the partitions have
on the fly. Kept terms are written in blocks in the order of the walk; a second walk over the blocks streams the sums of all pairs
of sources, and the candidates of each source, whose ties fall to the term that the walk meets first.

All numbers are integers: p = 1 + floor(UNIT * (count + SMOOTH) / (N + SMOOTH * V)), by long division, so nothing overflows.

Memory is bounded: a partition's trie is sent off at CELLS counters and begun anew, long texts are counted in pieces, merging keeps
one batch and one term, blocks of counts have DENSE cells at most. A language with most of the rows only has more leaves, and a
leaf of a partition is one row however often its term occurs. The result has a row for each pair of sources of a language, so
sources must be few enough for that; their list is broadcast where it fits and joined where it does not.

Defined cases: null text, language and source are ''; texts without terms count as documents of their group; repeated rows each
count; a group without terms gives its pairs (0 where the language keeps no term) and no term rows; of equal values the item whose
UTF-8 bytes are less comes first; very long texts and terms are whole; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from . import textvec as tv
from .scratch import Scratch, sized

MIN_DOCS = 30
TOP = 50
UNIT = 1_000_000_000
SMOOTH = 5
#: Bytes of text that are counted at once; counters of a partition's tries; terms of a block; cells of a block's dense counts.
CHUNK, CELLS, BLOCK, DENSE = 1 << 21, 1_200_000, 512, 1 << 20
#: Sums of pairs that a task gathers for a language; with more sources each block's sums are sent off at once.
GATHERED = 1 << 20

_INSIDE = np.zeros(256, bool)
_INSIDE[ord("A") : ord("Z") + 1] = _INSIDE[ord("a") : ord("z") + 1] = _INSIDE[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _binary(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def _grouped(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct keys in order, their weights' sums)."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(weight[order], first) if len(first) else weight[:0]


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(the terms of texts, lower-cased; the text of each)."""
    part, at = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    inside = _INSIDE[part]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    begins = at[:-1][at[:-1] < at[1:]]
    starts[begins] = inside[begins]
    places = np.flatnonzero(starts)
    count = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    ends = np.concatenate([count[places], count[-1:]])
    return _binary(ends, _LOWER[part[inside]]), np.searchsorted(at, places, side="right") - 1


class Trie:
    """Tries of several languages: the leaves, sorted by language and bytes, and their counters, sorted by leaf and source."""

    def __init__(self, lang: np.ndarray, term: pa.Array, docs: np.ndarray, leaf: np.ndarray, source: np.ndarray, n: np.ndarray):
        self.lang, self.term, self.docs, self.leaf, self.source, self.n = lang, term, docs, leaf, source, n

    @classmethod
    def of(cls, lang, term: pa.Array, docs, leaf, source, n) -> Trie:
        """From leaves and counters in any order, equal ones included."""
        coded = pc.dictionary_encode(term)
        number, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        order = pc.sort_indices(distinct).to_numpy(zero_copy_only=False)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        key = lang * len(order) + rank[number]
        path, docs = _grouped(key, docs)
        width = int(source.max()) + 1 if len(source) else 1
        cell, n = _grouped(np.searchsorted(path, key[leaf]) * width + source, n)
        return cls(path // max(len(order), 1), distinct.take(pa.array(order[path % max(len(order), 1)])), docs, cell // width, cell % width, n)

    @classmethod
    def merged(cls, tries: list[Trie]) -> Trie:
        if len(tries) == 1:
            return tries[0]
        base = np.cumsum([0, *(len(t.docs) for t in tries)])
        join = lambda name: np.concatenate([getattr(t, name) for t in tries])
        leaf = np.concatenate([t.leaf + b for t, b in zip(tries, base, strict=False)])
        return cls.of(join("lang"), pa.concat_arrays([t.term for t in tries]), join("docs"), leaf, join("source"), join("n"))

    @classmethod
    def of_texts(cls, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray, source: np.ndarray) -> Trie:
        term, text = _tokens(data, offsets)
        coded = pc.dictionary_encode(term)
        number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        size = max(len(coded.dictionary), 1)
        pair, n = _grouped(text * size + number, np.ones(len(number), np.int64))  # a document's term once
        text, number = pair // size, pair % size
        return cls.of(lang[text], coded.dictionary.take(pa.array(number)), np.ones(len(pair), np.int64), np.arange(len(pair)), source[text], n)

    @classmethod
    def of_long_text(cls, data: np.ndarray, begin: int, end: int, lang: np.ndarray, source: np.ndarray) -> Trie:
        """A text of any length, cut between terms."""
        tries = []
        while begin < end:
            cut = min(begin + CHUNK, end)
            while cut < end and _INSIDE[data[cut - 1]]:  # a term goes on here
                more = _INSIDE[data[cut : min(cut + CHUNK, end)]]
                cut += len(more) if more.all() else int(np.argmin(more)) + 1
            tries.append(cls.of_texts(data, np.array([begin, cut]), lang, source))
            tries = [cls.merged(tries)]
            begin = cut
        tries[0].docs = np.minimum(tries[0].docs, 1)
        return tries[0]


def _chunks(offsets: np.ndarray):
    """(first, end) of runs of texts, CHUNK bytes together; a longer text is alone."""
    a = 0
    while a < len(offsets) - 1:
        b = max(int(np.searchsorted(offsets, offsets[a] + CHUNK, side="right")) - 1, a + 1)
        yield a, b
        a = b


_LEAVES = "lang string, term binary, docs long, source array<int>, n array<long>"


def _lists(begin: np.ndarray, values: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(values, kind))


def _sent(trie: Trie, names: list[str]):
    for a in range(0, len(trie.docs), 20_000):
        b = min(a + 20_000, len(trie.docs))
        begin = np.searchsorted(trie.leaf, np.arange(a, b + 1))
        cells = slice(begin[0], begin[-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(names).take(pa.array(trie.lang[a:b])), trie.term.slice(a, b - a).cast(pa.binary()), pa.array(trie.docs[a:b]), _lists(begin - begin[0], trie.source[cells], pa.int32()), _lists(begin - begin[0], trie.n[cells], pa.int64())],
            ["lang", "term", "docs", "source", "n"],
        )


def _count(batches):
    """lang, source number and text, to a row for each leaf of the partition's tries."""
    names: dict[str, int] = {}
    held: list[Trie] = []
    size = 0
    for batch in batches:
        data, offsets = tv.bytes_of(batch.column("text"))
        lang = np.array([names.setdefault(x, len(names)) for x in batch.column("lang").to_pylist()], np.int64)
        source = batch.column("source").to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b in _chunks(offsets):
            if offsets[b] == offsets[a]:
                continue
            whole = Trie.of_texts(data, offsets[a : b + 1], lang[a:b], source[a:b]) if offsets[b] - offsets[a] <= CHUNK else Trie.of_long_text(data, offsets[a], offsets[b], lang[a:b], source[a:b])
            held.append(whole)
            size += len(whole.n)
            if size > CELLS:
                held = [Trie.merged(held)]
                size = len(held[0].n)
                if size > CELLS // 2:
                    yield from _sent(held.pop(), list(names))
                    size = 0
    if held:
        yield from _sent(Trie.merged(held), list(names))


_BLOCKS = "lang string, terms array<binary>, cells array<int>, source array<int>, n array<long>"


def _merge(min_docs: int):
    """Leaves in order of language and bytes, to blocks of kept terms with their counters, in that order."""

    def blocks(lang: str, terms: list, counters: list):
        for a in range(0, len(terms), BLOCK):
            cells = counters[a : a + BLOCK]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([terms[a : a + BLOCK]], pa.list_(pa.binary())), pa.array([[len(s) for s, _ in cells]], pa.list_(pa.int32())), pa.array([np.concatenate([s for s, _ in cells])], pa.list_(pa.int32())), pa.array([np.concatenate([n for _, n in cells])], pa.list_(pa.int64()))],
                ["lang", "terms", "cells", "source", "n"],
            )

    def run(batches):
        lang, terms, counters = None, [], []
        last = None  # (lang, term, documents, counters so far) of the newest term, which may go on in the next batch

        def flat(batch, name):
            return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64)

        def ended():
            nonlocal lang, terms, counters
            if last is None or last[2] < min_docs:
                return
            if (lang is not None and last[0] != lang) or len(terms) >= BLOCK:
                yield from blocks(lang, terms, counters)
                terms, counters = [], []
            lang = last[0]
            terms.append(last[1])
            counters.append(_grouped(np.concatenate([s for s, _ in last[3]]), np.concatenate([n for _, n in last[3]])))

        for batch in batches:
            if not batch.num_rows:
                continue
            same = np.zeros(batch.num_rows, bool)
            for name in ("lang", "term"):
                column = batch.column(name)
                equal = pc.equal(column.slice(1), column.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
                same[1:] = equal if name == "lang" else same[1:] & equal
            first = np.flatnonzero(~same)
            docs = np.add.reduceat(batch.column("docs").to_numpy(zero_copy_only=False), first)
            begin = np.concatenate([[0], np.cumsum(batch.column("source").value_lengths().to_numpy(zero_copy_only=False))])
            source, n = flat(batch, "source"), flat(batch, "n")
            ends = np.concatenate([first[1:], [batch.num_rows]])
            for k in np.unique(np.concatenate([[0], np.flatnonzero(docs >= min_docs), [len(first) - 1]])):  # other terms end within the batch, and are not kept
                at = int(first[k])
                key = (batch.column("lang")[at].as_py(), batch.column("term")[at].as_py())
                cells = slice(begin[at], begin[ends[k]])
                mine = (source[cells], n[cells])
                if last is not None and last[:2] == key:
                    gathered = [*last[3], mine]
                    if len(gathered) > 64:
                        gathered = [_grouped(np.concatenate([s for s, _ in gathered]), np.concatenate([c for _, c in gathered]))]
                    last = (*key, last[2] + int(docs[k]), gathered)
                else:
                    yield from ended()
                    last = (*key, int(docs[k]), [mine])
        yield from ended()
        if terms:
            yield from blocks(lang, terms, counters)

    return run


def shares(count: np.ndarray, total) -> np.ndarray:
    """1 + floor(UNIT * (count + SMOOTH) / total) without an overflow: long division in two steps. total: N + SMOOTH * V."""
    if np.max(total, initial=0) >= 1 << 46:
        count, total = count.astype(object), np.asarray(total).astype(object)
    wide = (count + SMOOTH) * 100_000
    high = wide // total
    rest = wide - high * total
    return 1 + high * (UNIT // 100_000) + rest * (UNIT // 100_000) // total


_DIVERGED = "lang string, source int, sums array<long>, terms array<binary>, values array<long>"


def _walk(top: int):
    """Blocks of terms with their language's totals, to sums over the terms for each pair of sources, and each source's best terms."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        best: dict[tuple[str, int], list] = {}

        def row(lang, source, pairs, found):
            return pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([source + 1], pa.int32()), pa.array([pairs], pa.list_(pa.int64())), pa.array([[t for _, t in found]], pa.list_(pa.binary())), pa.array([[v for v, _ in found]], pa.list_(pa.int64()))],
                ["lang", "source", "sums", "terms", "values"],
            )

        for batch in batches:
            for at in range(batch.num_rows):
                get = lambda name: batch.column(name)[at].values  # noqa: B023, E731
                lang, terms = batch.column("lang")[at].as_py(), get("terms")
                totals = get("totals").to_numpy(zero_copy_only=False) + SMOOTH * batch.column("v")[at].as_py()
                lang_total = int(batch.column("lang_n")[at].as_py() + SMOOTH * batch.column("v")[at].as_py())
                size = len(totals)
                owner = np.repeat(np.arange(len(terms)), get("cells").to_numpy(zero_copy_only=False))
                source, n = get("source").to_numpy(zero_copy_only=False) - 1, get("n").to_numpy(zero_copy_only=False)
                step = max(1, DENSE // size)
                for a in range(0, len(terms), step):
                    b = min(a + step, len(terms))
                    mine = slice(*np.searchsorted(owner, [a, b]))
                    counts = np.zeros((b - a, size), np.int64)
                    counts[owner[mine] - a, source[mine]] = n[mine]
                    p, q = shares(counts, totals), shares(counts.sum(1), lang_total)
                    kept = size * size <= GATHERED
                    held = sums.setdefault(lang, np.zeros((size, size), np.int64)) if kept else None
                    for i in range(size):
                        apart = np.abs(p - p[:, i : i + 1]).sum(0).astype(np.int64)
                        if kept:
                            held[i] += apart
                        else:
                            yield row(lang, i, apart, [])
                    over = (counts > 0) & (p > q[:, None])
                    for i in np.flatnonzero(over.any(0)):
                        where = np.flatnonzero(over[:, i])
                        value = (p[where, i] - q[where]).astype(np.int64)
                        order = np.argsort(-value, kind="stable")[:top]
                        found = best.setdefault((lang, int(i)), [])
                        found += [(int(value[o]), terms[a + int(where[o])].as_py()) for o in order]
                        found.sort(key=lambda x: (-x[0], x[1]))
                        del found[top:]
                if len(best) * top > 1_000_000:
                    for (of, i), found in best.items():
                        yield row(of, i, None, found)
                    best.clear()
        for lang, held in sums.items():
            for i in range(len(held)):
                yield row(lang, i, held[i], best.pop((lang, i), []))
        for (lang, i), found in best.items():
            yield row(lang, i, None, found)

    return run


def numbered_groups(docs: DataFrame) -> DataFrame:
    """lang, name and source: each source of a language, with its number in the language by its bytes, from 1."""
    groups = docs.select("lang", F.col("source").alias("name")).distinct()
    return groups.withColumn("source", F.row_number().over(W.partitionBy("lang").orderBy("name")))


def audit(df: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank.

    pair: item is each other source of the language, value the sum over the kept terms of how far both shares are apart.
    term: item is a kept term that the source has a greater share of than the language, value how much greater; the first `top`.
    min_docs: a language keeps the terms in at least so many of its documents.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "source-tries")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = df.select(name(lang_col).alias("lang"), name(source_col).alias("source"), name(text_col).cast("binary").alias("text"))
    groups = sized(scratch.save(numbered_groups(docs), "groups"))
    placed = docs.withColumnRenamed("source", "name").join(groups, ["lang", "name"]).select("lang", "source", "text")
    leaves = scratch.save(placed.mapInArrow(_count, _LEAVES), "leaves")
    ordered = leaves.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    blocks = scratch.save(ordered.mapInArrow(_merge(min_docs), _BLOCKS), "blocks")
    scratch.drop("leaves")

    cells = blocks.select("lang", F.explode(F.arrays_zip("source", "n")).alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"))
    v = blocks.groupBy("lang").agg(F.sum(F.size("terms")).alias("v"))
    whole = groups.join(cells, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("s"), F.coalesce(F.sum("n"), F.lit(0)).alias("lang_n"))
    totals = scratch.save(whole.join(v, "lang", "left").select("lang", F.col("s.n").alias("totals"), "lang_n", F.coalesce("v", F.lit(0)).alias("v")), "totals")
    diverged = scratch.save(blocks.join(sized(totals), "lang").mapInArrow(_walk(top), _DIVERGED), "diverged")

    sums = diverged.where("sums is not null").select("lang", "source", F.posexplode("sums").alias("other", "value")).withColumn("other", F.col("other") + 1)
    # Languages that keep no term have their pairs too.
    bare = totals.where("v = 0").join(groups, "lang").select("lang", "source", F.explode(F.sequence(F.lit(1), F.size("totals"))).alias("other"), F.lit(0).cast("long").alias("value"))
    pairs = sums.union(bare).where(F.col("source") != F.col("other")).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    pairs = pairs.join(groups.select("lang", F.col("source").alias("other"), F.col("name").alias("item")), ["lang", "other"])
    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    found = diverged.select("lang", "source", F.explode(F.arrays_zip("terms", "values")).alias("t")).select("lang", "source", F.lit("term").alias("part"), F.col("t.terms").cast("string").alias("item"), F.col("t.values").alias("value"))
    terms = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return pairs.union(terms).join(groups, ["lang", "source"]).select("lang", F.col("name").alias("source"), "part", "item", "value", "rank")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
o AS (SELECT k, lang, source, t, count(*) AS n FROM (SELECT k, lang, source, unnest(w) AS t FROM d) GROUP BY ALL),
kept AS (SELECT lang, t FROM o GROUP BY lang, t HAVING count(*) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, t, sum(n)::BIGINT AS n FROM o JOIN kept USING (lang, t) GROUP BY lang, source, t),
cells AS (SELECT g.lang, g.source, kept.t, coalesce(c.n, 0) AS n FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = kept.t),
p AS (
  SELECT lang, source, t, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v)::HUGEINT AS p
  FROM cells JOIN v USING (lang)),
q AS (
  SELECT lang, t, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v)::HUGEINT AS q
  FROM (SELECT lang, t, sum(n) AS n FROM cells GROUP BY lang, t) JOIN v USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, p.source, p.t AS item, p.p - q.q AS value FROM p JOIN q ON p.lang = q.lang AND p.t = q.t WHERE p.n > 0 AND p.p > q.q),
r AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""
