"""Near-duplicate documents by SuperMinHash signatures, banding, exact verification and distributed union-find.

A signature slot holds the least rank that an element gets there: at level j an element takes the j-th place of its own random
permutation of the slots, with rank j + r, so ranks are correlated across slots and vary less than independent ones. Levels
stop for a text once every slot has a rank below the level.

Equal sets are one node. Nodes that share a band meet in a bucket. Each bucket has a pivot, the member whose buckets are the
fullest, and all its members are compared with the pivot on their full shingle sets. The members of a pivot's buckets that it
does not link are then compared with the others in blocks: members are cut by their distance to the pivot, and as Jaccard
distance is a metric, only blocks whose distances differ by at most the allowed distance meet. So no pair within a bucket is
left out, no task holds more than two blocks, and no pairs are written but links. (Where very many texts are alike but not alike
enough, as under one long common page head, the blocks of their pivot still meet each other, in as many tasks.) Two sets of the
least similarity meet in no bucket with probability at most MISS. Full sets are sets of 64-bit hashes of shingles, not of words:
two shingles of one text pair share a hash with probability below 2**-40.

Defined cases: null or wordless text has an empty set and no links; a text with fewer words than a shingle is one shingle; a
document's component is the least id reachable; null ids are never the least and their rows are not kept unless the component
has only null ids; repeated rows are each returned. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textvec as tv
from .scratch import Scratch, sized

ROWS = 4
MISS = 1e-6
#: Shingles in a block of members.
BLOCK = 100_000
#: Members that are compared with one copy of their pivot's text.
STAR = 512
SEED = np.uint64(0x5EED0F5EED)


def bands_for(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))


def signatures(elements: np.ndarray, sizes: np.ndarray, m: int) -> np.ndarray:
    """One row of m ranks (level << 32 | random) for each set; elements holds the sets one after another."""
    U = np.uint64
    n = len(sizes)
    slots = np.full(n * m, U(m) << U(32), U)
    owner = np.repeat(np.arange(n), sizes)
    seed, perm = tv.mix(elements ^ SEED), None
    for j in range(m):
        if j:
            active = (slots.reshape(n, m) >= (U(j) << U(32))).any(axis=1) & (sizes > 0)
            keep = active[owner]
            if not keep.any():
                break
            if perm is None:
                seed, owner, first = seed[keep], owner[keep], first[keep]
                perm = np.tile(np.arange(m, dtype=np.uint8), (len(seed), 1))
                perm[np.arange(len(seed)), first] = 0
            elif not keep.all():
                seed, owner, perm = seed[keep], owner[keep], perm[keep]
        x = tv.mix(seed + U((j + 1) * int(tv.GOLDEN) % 2**64))
        at = (j + (((x & U(0xFFFFFFFF)) * U(m - j)) >> U(32)).astype(np.int64)).astype(np.int64)
        if j:
            rows = np.arange(len(seed))
            slot = perm[rows, at].astype(np.int64)
            perm[rows, at] = perm[:, j]
        else:
            slot = first = at
        np.minimum.at(slots, owner * m + slot, (U(j) << U(32)) | (x >> U(32)))
    return slots.reshape(n, m)


def _band_hashes(signature: np.ndarray, bands: int) -> np.ndarray:
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), bands)).copy()
    for r in range(ROWS):
        h = tv.mix(h * tv.GOLDEN + signature[:, r::ROWS])
    return h.view(np.int64)


def _sets(column, k: int):
    """Distinct shingle hashes of each text of an Arrow column, a chunk of texts at a time."""
    data, offsets = tv.bytes_of(column)
    for a, b in tv.chunks(offsets):
        h, first = tv.words(data, offsets[a : b + 1])
        every = tv.shingles(h, k)
        yield a, b, [tv.text_shingles(h, every, first[i], first[i + 1], k) for i in range(b - a)]


def _digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _sign(k: int, bands: int):
    def run(batches):
        for batch in batches:
            for a, b, sets in _sets(batch.column("text"), k):
                sizes = np.array([len(s) for s in sets])
                signature = signatures(np.concatenate(sets), sizes, bands * ROWS)
                flat = _band_hashes(signature, bands).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("th").slice(a, b - a), pa.array(sizes, pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), lists],
                    ["doc_id", "th", "n", "node", "bands"],
                )

    return run


def _verify(k: int):
    """Sizes of a member's set, and of its intersection and union with the pivot's. Rows come sorted, the pivot's text before its
    members, and its set is kept until the next pivot's."""

    def run(batches):
        own = np.zeros(0, np.uint64)
        for batch in batches:
            pivot_row = batch.column("side").to_numpy(zero_copy_only=False) == 0
            for a, b, sets in _sets(batch.column("text"), k):
                at, size, inter, union = [], [], [], []
                for i, s in enumerate(sets, a):
                    if pivot_row[i]:
                        own = s
                        continue
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    at.append(i)
                    size.append(len(s))
                    inter.append(both)
                    union.append(len(own) + len(s) - both)
                rows = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("pivot").take(rows), batch.column("node").take(rows), *(pa.array(x, pa.int64()) for x in (size, inter, union))], ["pivot", "node", "n", "inter", "union"])

    return run


def _block_links(k: int, percent: int):
    """Links between members of two blocks that are not yet linked through the pivot: a forest of them, no more than members."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "node"]).reset_index(drop=True)
        sets = [s for _, _, part in _sets(pa.array(pdf["text"].tolist(), pa.string()), k) for s in part]
        sizes = np.array([len(s) for s in sets])
        linked, side, nodes = pdf["linked"].to_numpy(), pdf["side"].to_numpy(), pdf["node"].tolist()
        _, word, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        keep = many[word] > 1
        word, owner = word[keep], owner[keep]
        order = np.argsort(word, kind="stable")
        by_word, starts = owner[order], np.searchsorted(word[order], np.arange(len(many) + 1))
        at = np.searchsorted(owner, np.arange(len(sets) + 1))
        parent = list(range(len(sets)))

        def root(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        one = (side == 0).all()
        out = []
        for x in np.flatnonzero(~linked):  # of two linked members the pivot has both already
            mine = word[at[x] : at[x + 1]]
            if not len(mine):
                continue
            shared = np.bincount(np.concatenate([by_word[starts[w] : starts[w + 1]] for w in mine]), minlength=len(sets))
            other = (side == side[x]) if one else (side != side[x])
            close = np.flatnonzero(other & (100 * shared >= percent * (sizes[x] + sizes - shared)))
            for y in close:
                if y != x and root(x) != root(y):
                    parent[root(x)] = root(y)
                    out.append((nodes[x], nodes[y]))
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label: the least node reachable. Least neighbour and pointer jumping in turn, each round written to the shared
    folder; the rounds grow with the logarithm of the longest chain. Only the count of changes comes to the driver."""
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = scratch.save(edges.select(ways.alias("w")).select("w.a", "w.b").distinct(), "edges")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("l")).select("node", F.least("node", "l").alias("label")), "labels-0")
    turn = 0
    while True:
        seen = labels.select(F.col("node").alias("b"), F.col("label").alias("seen"))
        least = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("least"))
        hooked = labels.join(least, "node").select("node", "label", F.least("label", "least").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("far"))
        moved = hooked.join(jump, "to", "left").select("node", F.least("to", F.coalesce("far", "to")).alias("label"), (F.least("to", F.coalesce("far", "to")) != F.col("label")).alias("moved"))
        turn += 1
        saved = scratch.save(moved, f"labels-{turn}")
        scratch.drop(f"labels-{turn - 1}")
        labels = saved.select("node", "label")
        if saved.where("moved").isEmpty():
            scratch.drop("edges")
            return labels


def group_near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (xxhash64 of the text), n_shingles, component_id, kept. Documents are linked where 100 * intersection >=
    percent * union."""
    scratch = Scratch(docs.sparkSession, "superminhash")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bands = bands_for(percent / 100)
    signed = source.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(_sign(shingle, bands), "doc_id long, th long, n long, node binary, bands array<long>")
    signed = scratch.save(signed, "signed")
    nodes = signed.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("rep"), F.max("n").alias("n"), F.first("bands").alias("bands"))
    nodes = scratch.save(nodes.select("node", "rep.doc_id", "rep.th", "n", "bands"), "nodes")

    met = nodes.select("node", F.explode("bands").alias("key"))
    # Sums are written before they are joined: only joins of two plain exchanges have their skewed partitions split.
    full = scratch.save(met.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "full")
    met = scratch.save(met.join(sized(full), "key"), "met")
    score = met.groupBy("node").agg(F.sum("size").alias("score"))
    best = met.join(score, "node").groupBy("key").agg(F.max(F.struct("score", "node")).alias("best"), F.max("size").alias("size"))
    best = scratch.save(best.select("key", F.col("best.node").alias("pivot"), "size"), "best")
    pairs = met.select("node", "key").join(sized(best), "key").where("node != pivot").groupBy("pivot", "node").agg(F.max("size").alias("size"))
    # A pivot's members are dealt out to cells of about STAR, so that the pivot's text travels once a cell and each member's once.
    cells = F.ceil(F.col("size") / STAR).cast("int")
    pairs = scratch.save(pairs.select("pivot", "node", F.hash(cells, F.pmod(F.xxhash64("node"), cells)).alias("cell")), "pairs")
    scratch.drop("met", "full", "best")

    roles = pairs.select("node", "pivot", "cell", F.lit(1).alias("side")).union(pairs.select(F.col("pivot").alias("node"), "pivot", "cell", F.lit(0).alias("side")).distinct())
    where = scratch.save(nodes.join(roles.select("node").distinct(), "node", "left_semi").select("node", F.col("doc_id").alias("d"), F.col("th").alias("t")), "needed")
    texts = source.join(sized(where), F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("t"))).select("node", "text")
    texts = scratch.save(texts, "texts")
    cast = texts.join(roles, "node").select("pivot", "cell", "side", "node", "text").repartition("pivot", "cell").sortWithinPartitions("pivot", "cell", "side")
    star = cast.mapInArrow(_verify(shingle), "pivot binary, node binary, n long, inter long, union long")
    star = scratch.save(star.distinct(), "star")  # equal texts of repeated rows
    linked = F.col("inter") * 100 >= F.col("union") * percent
    found = star.where(linked).select(F.col("pivot").alias("a"), F.col("node").alias("b"))

    found = found.union(_rest(star.withColumn("linked", linked), texts, shingle, percent, scratch))
    labels = components(found, scratch)
    # Nodes without a link have their own least id; those with one, that of their component.
    ids = nodes.select("node", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = ids.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("nodes"), F.first("node").alias("node"))
    least = scratch.save(least, "least")
    linked = labels.join(least.where("nodes > 1").select("label", "component_id"), "label").select("node", "component_id")
    of_node = scratch.save(least.where("nodes = 1").select("node", "component_id").union(linked), "of_node")
    scratch.drop("texts", "star", "pairs", "nodes")
    out = signed.select("doc_id", "th", "n", "node").join(of_node, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents, all columns, with one of each group: the least id, and of rows that repeat id and text one."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    scratch = Scratch(docs.sparkSession, "superminhash")
    groups = group_near_duplicates(docs, **options)
    same = lambda t: docs[id_col].cast("long").eqNullSafe(t["_id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == t["_th"])
    named = groups.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.count(F.lit(1)).alias("rows"), F.min("kept").alias("kept"), F.max("n_shingles").alias("n"))
    changed = scratch.save(named.where("not kept or rows > 1 and n > 0").select("_id", "_th", "kept"), "changed")
    left = docs.join(sized(changed.select("_id", "_th")), same(changed), "left_anti")
    twice = changed.where("kept").select("_id", "_th")
    if twice.isEmpty():
        return left
    return left.unionByName(docs.join(sized(twice), same(twice), "left_semi").dropDuplicates([id_col, text_col]))


def _rest(star: DataFrame, texts: DataFrame, shingle: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links among a pivot's members of which at least one is not linked to the pivot itself."""
    members = star.select("pivot", "node", "n", "linked", (1 - F.col("inter") / F.col("union")).alias("d"))
    open_ = members.groupBy("pivot").agg(F.count(F.lit(1)).alias("members"), F.sum((~F.col("linked")).cast("int")).alias("outside"), F.sum("n").alias("total"))
    open_ = scratch.save(open_.where("outside > 0 and members > 1").select("pivot", "total"), "open")
    step = 1.95 / (1 - percent / 100) if percent < 100 else 1.0  # distances that may link differ by less than two steps
    members = members.join(sized(open_), "pivot").withColumn("cut", F.when(F.col("total") <= BLOCK, 0).otherwise(F.floor(F.col("d") * step)).cast("int"))
    members = scratch.save(members, "members")
    cuts = scratch.save(members.groupBy("pivot", "cut").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("subs"), F.min("linked").alias("all_linked")), "cuts")
    members = members.join(sized(cuts.select("pivot", "cut", "subs")), ["pivot", "cut"]).withColumn("sub", F.pmod(F.xxhash64("node"), F.col("subs")).cast("int"))
    blocks = cuts.select("pivot", "cut", "all_linked", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"))
    other = blocks.select("pivot", F.col("cut").alias("cut2"), F.col("sub").alias("sub2"), F.col("all_linked").alias("all_linked2"))
    meet = blocks.join(other, "pivot").where("(cut2 > cut or cut2 = cut and sub2 >= sub) and cut2 - cut <= 2 and not (all_linked and all_linked2)")
    meet = meet.select("pivot", "cut", "sub", "cut2", "sub2")
    key = ["pivot", "cut", "sub", "cut2", "sub2"]
    one = members.join(meet, ["pivot", "cut", "sub"]).select(*key, "node", "linked", F.lit(0).alias("side"))
    second = meet.where("cut2 != cut or sub2 != sub").select("pivot", F.col("cut").alias("cut1"), F.col("sub").alias("sub1"), F.col("cut2").alias("cut"), F.col("sub2").alias("sub"))
    two = members.join(second, ["pivot", "cut", "sub"]).select("pivot", F.col("cut1").alias("cut"), F.col("sub1").alias("sub"), F.col("cut").alias("cut2"), F.col("sub").alias("sub2"), "node", "linked", F.lit(1).alias("side"))
    return texts.join(one.union(two), "node").groupBy(*key).applyInPandas(_block_links(shingle, percent), "a binary, b binary")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, array_to_string(w[i:i+2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 2)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * x >= 85 * (na.n + nb.n - x)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, least(min(b), a) AS c FROM r GROUP BY a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, doc_id)::BIGINT AS component_id, coalesce(c.c, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
