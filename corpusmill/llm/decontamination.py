"""Benchmark decontamination: MinHash containment search, partitioned by item size, verified by exact shingle containment.

Short items hide in long documents, where the Jaccard similarity of the two sets is near zero, so the search estimates
containment from the item's side: an item's signature is its `k` least shingle hashes, a random sample of its set, and a
document is a candidate where it has one of them. Items are partitioned by size in powers of two, and each partition's k is
one more than the shingles that its largest item may miss; so an item that is contained to the least share always has a
signature hash in the document, and the search loses nothing. Candidates are verified on the shingles' own words.

The items' index goes to the executors in blocks of at most BLOCK_CHARS characters of text; a larger benchmark is searched in
several passes, one for each block, and the passes' hits are joined to the documents.

Defined cases: null or wordless texts and items contain nothing and are in nothing; an item with fewer words than a shingle is
one shingle of its own length; repeated items each report their id; repeated documents each get a row; an empty benchmark
leaves all documents clean. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textvec as tv
from .scratch import Scratch, sized

BLOCK_CHARS = 8_000_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_BITS = 20


def word_shingles(text: str, k: int) -> set[tuple[str, ...]]:
    w = WORD.findall(text.translate(_LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else set()


class Index:
    """The signatures and sets of a block of items."""

    def __init__(self, items: list[tuple[int, str]], shingle: int, percent: int):
        by_set = defaultdict(list)
        for item, text in items:
            n = len(WORD.findall(text or ""))
            if n:
                by_set[(min(n, shingle), frozenset(word_shingles(text, min(n, shingle))))].append(item)
        self.percent = percent
        self.sets = [(k, s, sorted(ids)) for (k, s), ids in by_set.items()]
        probes = defaultdict(list)
        for number, (k, s, _) in enumerate(self.sets):
            largest = 2 ** len(s).bit_length() - 1  # of the item's size partition
            least = largest * (100 - percent) // 100 + 1
            for h in np.sort(self._hashes(s, k))[:least]:
                probes[k].append((h, number))
        self.probes = {}
        for k, found in probes.items():
            keys = np.array([h for h, _ in found], np.uint64)
            order = np.argsort(keys, kind="stable")
            sieve = np.zeros(1 << _BITS, bool)
            sieve[(keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.probes[k] = (keys[order], np.array([n for _, n in found])[order], sieve)

    @staticmethod
    def _hashes(s, k: int) -> np.ndarray:
        data = " ".join(" ".join(words) for words in sorted(s)).encode("utf-8", "surrogatepass")
        raw = np.frombuffer(data, np.uint8)
        h, _ = tv.words(raw, np.array([0, len(raw)]))
        return tv.shingles(h, k)[::k]

    def search(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """For each text with an item in it: (number of the set, shingles found, shingles)."""
        h, first = tv.words(data, offsets)
        candidates = defaultdict(set)
        for k, (keys, numbers, sieve) in self.probes.items():
            every = tv.shingles(h, k)
            maybe = np.flatnonzero(sieve[(every >> np.uint64(64 - _BITS)).astype(np.int64)])
            left, right = (np.searchsorted(keys, every[maybe], side) for side in ("left", "right"))
            hit = left < right
            for at, a, b in zip(maybe[hit], left[hit], right[hit], strict=True):
                text = int(np.searchsorted(first, at, "right")) - 1
                if at + k <= first[text + 1]:
                    candidates[text].update(numbers[a:b].tolist())
        found = {}
        for text, numbers in candidates.items():
            words = bytes(data[offsets[text] : offsets[text + 1]]).decode("utf-8", "replace")
            sets = {k: word_shingles(words, k) for k in {self.sets[n][0] for n in numbers}}
            hits = [(n, len(self.sets[n][1] & sets[self.sets[n][0]]), len(self.sets[n][1])) for n in sorted(numbers)]
            if hits := [x for x in hits if 100 * x[1] >= self.percent * x[2]]:
                found[text] = hits
        return found


def _search(index):
    def run(batches):
        own = index.value
        for batch in batches:
            data, offsets = tv.bytes_of(batch.column("text"))
            ids, share = [[] for _ in range(len(batch))], [0.0] * len(batch)
            for a, b in tv.chunks(offsets):
                for text, hits in own.search(data, offsets[a : b + 1]).items():
                    ids[a + text] = sorted(i for n, _, _ in hits for i in own.sets[n][2])
                    share[a + text] = max(x / y for _, x, y in hits)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(ids, pa.list_(pa.int64())), pa.array(share)], ["doc_id", "th", "items", "share"])

    return run


def find_items(docs: DataFrame, benchmark: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, th (xxhash64 of the text), items (ids of the items contained to percent or more), share (the largest
    containment found, else 0)."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).where(F.col("text").isNotNull())
    blocks = -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars) or 1
    passes = []
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()  # about block_chars characters
        index = spark.sparkContext.broadcast(Index([(r["item"], r["text"]) for r in rows], shingle, percent))
        passes.append(source.mapInArrow(_search(index), "doc_id long, th long, items array<long>, share double"))
    if blocks == 1:
        return passes[0]
    scratch = Scratch(spark, "decontamination")
    hits = None
    for block, one in enumerate(passes):
        hit = scratch.save(one.where("share > 0").distinct(), f"hits-{block}")
        hits = hit if hits is None else hits.union(hit)
    hits = hits.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.array_sort(F.flatten(F.collect_list("items"))).alias("items"), F.max("share").alias("share"))
    joined = source.select("doc_id", "th").join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    return joined.select("doc_id", "th", F.coalesce("items", F.array().cast("array<long>")).alias("items"), F.coalesce("share", F.lit(0.0)).alias("share"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no item was found, with their own columns."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    hit = find_items(docs, benchmark, **options).where("share > 0").select(F.col("doc_id").alias("_hit"), F.col("th").alias("_th")).distinct()
    hit = Scratch(docs.sparkSession, "decontamination").save(hit, "hit")
    return docs.join(sized(hit), docs[id_col].cast("long").eqNullSafe(hit["_hit"]) & (F.xxhash64(docs[text_col]) == hit["_th"]), "left_anti")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
i AS (
  SELECT row_number() OVER () AS j, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM benchmark),
q AS (SELECT DISTINCT j, item_id, z, array_to_string(w[p:p+z-1], ' ') AS g
      FROM (SELECT j, item_id, w, least(len(w), 5) AS z, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS p FROM i WHERE len(w) > 0)),
n AS (SELECT j, count(*) AS n FROM q GROUP BY j),
z AS (SELECT DISTINCT z FROM q),
s AS (SELECT DISTINCT k, z, array_to_string(w[p:p+z-1], ' ') AS g
      FROM (SELECT k, z, w, unnest(range(1, len(w) - z + 2)) AS p FROM d CROSS JOIN z WHERE len(w) >= z)),
x AS (SELECT k, j, item_id, count(*) AS c FROM s JOIN q USING (z, g) GROUP BY k, j, item_id),
h AS (SELECT k, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS item_ids, count(*) AS n_items, max(c / n) AS containment
      FROM x JOIN n USING (j) WHERE 100 * c >= 80 * n GROUP BY k)
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(item_ids, '') AS item_ids,
       coalesce(containment, 0.0)::DOUBLE AS containment
FROM d LEFT JOIN h USING (k)
"""
