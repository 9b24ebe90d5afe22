"""Dictionaries of any size against texts, by tries kept as arrays.

A dictionary comes from a table. PART_BYTES of it at a time become a trie: sorted edges (node, byte) and the phrase that ends at each
node. It is broadcast, a few megabytes whatever the dictionary's size, and walked from all places of a chunk of texts at once, a byte
deeper in each step for the places that are still on a path. A larger dictionary takes more passes over the texts.

Texts and phrases are compared in lower case. Characters of a word are ASCII letters, digits, the underscore, and all beyond ASCII.
Defined cases: null texts and null or empty phrases match nothing; very long texts are walked whole, CHUNK bytes at a time.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

PART_BYTES = 4 << 20
CHUNK = 1 << 20
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True


class PhraseTrie:
    """first: the node behind each first byte, or -1; edges and children: node * 256 + byte, sorted, and where they lead; ends: the
    phrase that ends at a node, or -1; longest: of the phrases, in bytes."""

    def __init__(self, phrases: list[str]):
        self.phrases = sorted(phrases)
        raw = [p.encode() for p in self.phrases]
        size = np.array([len(r) for r in raw], np.int64)
        begin = np.concatenate([[0], np.cumsum(size)])
        data = np.frombuffer(b"".join(raw), np.uint8)
        node, nodes = np.zeros(len(raw), np.int64), 1
        edges, children = [], []
        for depth in range(int(size.max(initial=0))):
            on = np.flatnonzero(size > depth)
            key, at = np.unique(node[on] << 8 | data[begin[on] + depth], return_inverse=True)
            edges.append(key)
            children.append(nodes + np.arange(len(key)))
            node[on] = nodes + at
            nodes += len(key)
        self.edges, self.children = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (edges, children))
        order = np.argsort(self.edges)
        self.edges, self.children = self.edges[order], self.children[order]
        self.ends = np.full(nodes, -1, np.int64)
        self.ends[node] = np.arange(len(raw))
        self.ends[0] = -1
        self.first = np.full(256, -1, np.int64)
        roots = np.searchsorted(self.edges, 256)
        self.first[self.edges[:roots]] = self.children[:roots]
        self.longest = int(size.max(initial=0))

    def walk(self, data: np.ndarray, starts: np.ndarray, limits: np.ndarray):
        """(start, end, phrase) of all matches that begin at starts and end by their limits, in order of length."""
        node = self.first[data[starts]]
        depth = 1
        while True:
            on = node >= 0
            starts, limits, node = starts[on], limits[on], node[on]
            if not len(starts):
                return
            done = self.ends[node]
            if (hit := done >= 0).any():
                yield starts[hit], starts[hit] + depth, done[hit]
            more = starts + depth < limits
            starts, limits, node = starts[more], limits[more], node[more]
            key = node << 8 | data[starts + depth]
            at = np.minimum(np.searchsorted(self.edges, key), max(len(self.edges) - 1, 0))
            node = np.where(self.edges[at] == key, self.children[at], -1) if len(self.edges) else np.full(len(key), -1)
            depth += 1


def _matches(trie: PhraseTrie, column: pa.Array, words: bool):
    """(row, start, end, phrase) of all matches in a column of texts; start and end in bytes. words: only whole words."""
    texts = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, raw = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    parts = []
    for a in range(int(at[0]), int(at[-1]), CHUNK):
        b = min(a + CHUNK, int(at[-1]))
        starts = a + np.flatnonzero(trie.first[data[a:b]] >= 0)
        row = np.searchsorted(at, starts, side="right") - 1
        inside = lambda p, r: _WORD[data[np.maximum(p - 1, 0)]] & _WORD[data[np.minimum(p, len(data) - 1)]] & (p > at[r]) & (p < at[r + 1])
        if words:
            fine = ~inside(starts, row)
            starts, row = starts[fine], row[fine]
        for start, end, phrase in trie.walk(data, starts, at[row + 1]):
            r = np.searchsorted(at, start, side="right") - 1
            if words:
                fine = ~inside(end, r)
                start, end, phrase, r = start[fine], end[fine], phrase[fine], r[fine]
            parts.append(np.stack([r, start - at[r], end - at[r], phrase]))
    return np.concatenate(parts, axis=1) if parts else np.zeros((4, 0), np.int64)


def _passes(phrases: DataFrame):
    """The dictionary's tries, PART_BYTES of phrases each, broadcast one after the other."""
    own = phrases.where(F.length("phrase") > 0).select(F.lower("phrase").alias("phrase")).distinct()
    n = -(-(own.agg(F.sum(F.octet_length("phrase") + 8)).first()[0] or 0) // PART_BYTES)
    for i in range(n):
        some = [r["phrase"] for r in own.where(F.pmod(F.xxhash64("phrase"), F.lit(n)) == i).collect()]
        if some:
            yield phrases.sparkSession.sparkContext.broadcast(PhraseTrie(some))


def containing(rows: DataFrame, phrases: DataFrame) -> DataFrame:
    """phrase and the columns of rows: each row once for each distinct phrase (any case) that its text contains, words or parts of
    words. rows: text and others."""
    texts = rows.withColumn("_text", F.lower("text"))
    kept = [c for c in texts.columns if c != "_text"]
    schema = T.StructType([T.StructField("phrase", T.StringType()), *[texts.schema[c] for c in kept]])

    def found(trie):
        def run(batches):
            for batch in batches:
                row, _, _, phrase = _matches(trie.value, batch.column("_text"), False)
                pairs = np.unique(np.stack([row, phrase]), axis=1) if len(row) else np.zeros((2, 0), np.int64)
                names = pa.array(trie.value.phrases, pa.string()).take(pa.array(pairs[1]))
                yield pa.RecordBatch.from_arrays([names, *(batch.column(c).take(pa.array(pairs[0])) for c in kept)], ["phrase", *kept])

        return run

    parts = [texts.mapInArrow(found(trie), schema) for trie in _passes(phrases)]
    return reduce(DataFrame.union, parts) if parts else texts.select(F.lit("").alias("phrase"), *kept).limit(0)


def _first(batches):
    """Matches of a text in order of start, longest first: those that begin where the one before has ended."""
    last, end = None, 0
    for batch in batches:
        keep = []
        ids = batch.column("id").to_pylist()
        for i, (key, a, b) in enumerate(zip(ids, batch.column("start").to_pylist(), batch.column("end").to_pylist(), strict=True)):
            if key != last:
                last, end = key, 0
            if a >= end:
                keep.append(i)
                end = b
        yield batch.take(pa.array(keep, pa.int64()))


def leftmost_longest(docs: DataFrame, names: DataFrame) -> DataFrame:
    """id, start, end, name: whole-word matches of the names in each text, from left to right, the longest of those that begin
    together, none over another. docs: id (each its own), text; names: name. start and end are bytes of the lower-case text."""
    texts = docs.select("id", F.lower("text").alias("text"))
    schema = T.StructType([texts.schema["id"], T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("name", T.StringType())])

    def found(trie):
        def run(batches):
            for batch in batches:
                row, start, end, phrase = _matches(trie.value, batch.column("text"), True)
                names = pa.array(trie.value.phrases, pa.string()).take(pa.array(phrase))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), pa.array(start), pa.array(end), names], ["id", "start", "end", "name"])

        return run

    parts = [texts.mapInArrow(found(trie), schema) for trie in _passes(names.select(F.col("name").alias("phrase")))]
    if not parts:
        return texts.select("id", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit("").alias("name")).limit(0)
    # A text's matches come from several passes: they meet in order, and no more than one is held.
    return reduce(DataFrame.union, parts).repartition("id").sortWithinPartitions("id", "start", F.desc("end")).mapInArrow(_first, schema)


def mentions(docs: DataFrame, names: DataFrame) -> DataFrame:
    """id, name, n: how often each text mentions each name (lower-case), by leftmost_longest()."""
    return leftmost_longest(docs, names).groupBy("id", "name").agg(F.count(F.lit(1)).alias("n"))
