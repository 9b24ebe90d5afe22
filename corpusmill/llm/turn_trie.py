"""The prefix trie of conversations, by partition refinement.

A node is a class: the conversations that start with the same turns. Refinement starts with one class, the root, and splits the
active classes by their members' next turn, a round for each depth. A class of one sequence is retired: its tail is a unary chain,
written without further rounds. At the end the sums over subtrees are folded back from the deepest round to the root.

Conversations that are equal from end to end are one sequence with a number of copies, so that thousands of copies do not keep a
class active. Turns are compared by a digest of role and text. A class whose members have no more than `local` turns to go is
finished within a task by the same refinement; larger ones go on in rounds, each a few joins and sums over the active members
alone, so a common first turn is split by the second turn in the next round and never gathered.

No conversation is sorted as a whole: turns are numbered in blocks of turn numbers, and bytes summed in blocks of places. Hashes of
the conversations that end at a node need all their ids in order: ids are written out by ranges of RANGE ids, which many tasks do,
and one task then hashes a node's pieces as they come, holding one at a time.

Defined cases: turns are ordered by turn, null first, then by role and text; null role or text is empty; repeated rows are turns of
their own; rows without a conversation id belong to no conversation and are left out; a conversation without turns ends at the
root; an empty table has no conversation and gives no node; very long texts and conversations are whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .scratch import Scratch, sized

BLOCK = 64
SPAN = 1024
RANGE = 4096
#: Turns to go of a class that is finished within a task.
LOCAL = 20_000
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def numbered(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, place (from 0), role, text: the turns in order, without nulls."""
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = df.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), clean(role_col).alias("role"), clean(text_col).alias("text"))
    turns = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 61)).cast("long")))
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = turns.groupBy("conv_id", "block").count().select("conv_id", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return turns.withColumn("row", F.row_number().over(inside) - 1).join(blocks, ["conv_id", "block"]).select("conv_id", (F.col("base") + F.col("row")).alias("place"), "role", "text")


def digested(turns: DataFrame) -> DataFrame:
    """conv_id, place, turn (a digest of role and text), bytes of the text."""
    key = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return turns.select("conv_id", "place", F.unhex(F.md5(key.cast("binary"))).alias("turn"), F.octet_length("text").cast("long").alias("bytes"))


def regrouped(turns: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Every conversation c anew: the first h turns of conversation c - c % group, then its own after its first h; h is the CRC-32
    of its number modulo `most`. Returns (conversations, turns) as conv_id and conv_id, place, turn, bytes."""
    convs = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("head"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"))
    heads = turns.where(F.col("place") < most - 1).select(F.col("conv_id").alias("head"), "place", "turn", "bytes")
    kept = heads.join(convs, "head").where(F.col("place") < F.col("h"))
    # How many turns a conversation takes over, where its head is shorter than h.
    taken = kept.groupBy("conv_id").agg(F.count(F.lit(1)).alias("taken"))
    convs = convs.join(taken, "conv_id", "left").select("conv_id", "h", F.coalesce("taken", F.lit(0)).alias("taken"))
    return kept.select("conv_id", "place", "turn", "bytes"), convs


def _rebuilt(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    kept, convs = regrouped(turns)
    kept, convs = scratch.save(kept, "kept"), scratch.save(convs, "convs")
    own = turns.join(sized(convs), "conv_id").where(F.col("place") >= F.col("h")).select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "turn", "bytes")
    return convs.select("conv_id"), scratch.save(kept.union(own), "rebuilt")


def _ends(batches):
    """Pieces of a sequence's ids in order, to the sequence's smallest id, their number, and the hash of the whole list."""
    last, out = None, []

    def done():
        out.append((*last[0], last[1], last[2], last[3].hexdigest()))

    names = ["size", "x", "y", "rep", "n", "ends"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
    for batch in batches:
        for size, x, y, least, n, ids in zip(*(batch.column(c).to_pylist() for c in ("size", "x", "y", "least", "n", "ids")), strict=True):
            if last is not None and last[0] == (size, x, y):
                last[2] += n
                last[3].update(b"," + ids.encode())
            else:
                if last is not None:
                    done()
                last = [(size, x, y), least, n, hashlib.sha256(ids.encode())]
        if len(out) > 5000:
            yield pack()
            out.clear()
    if last is not None:
        done()
    if out:
        yield pack()


def sequences(convs: DataFrame, turns: DataFrame, scratch: Scratch) -> DataFrame:
    """rep, n, size, ends: each distinct sequence of turns, its smallest conversation, how many conversations have it, how many
    turns it has, and the hash of their ids."""
    whole = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("place", "turn")).alias("x"), F.bit_xor(F.xxhash64("turn", F.lit("again"), "place")).alias("y"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    each = convs.join(whole, "conv_id", "left").select("conv_id", zero("size"), zero("x"), zero("y"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = each.groupBy("size", "x", "y", F.floor(F.col("conv_id") / RANGE).alias("piece")).agg(F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("n"), ids.alias("ids"))
    pieces = scratch.save(pieces, "pieces").repartition("size", "x", "y").sortWithinPartitions("size", "x", "y", "piece")
    found = pieces.mapInArrow(_ends, "size long, x long, y long, rep long, n long, ends string")
    return scratch.save(found.select("rep", "n", "size", "ends"), "sequences")


def summed(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """rep, place, turn, bytes, before (bytes of the turns before it): in blocks of SPAN places, whose sums run along a sequence."""
    spans = turns.withColumn("span", F.floor(F.col("place") / SPAN))
    inside = W.partitionBy("rep", "span").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    along = W.partitionBy("rep").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    bases = spans.groupBy("rep", "span").agg(F.sum("bytes").alias("b")).select("rep", "span", F.coalesce(F.sum("b").over(along), F.lit(0)).alias("base"))
    return spans.withColumn("in", F.coalesce(F.sum("bytes").over(inside), F.lit(0))).join(bases, ["rep", "span"]).select("rep", "place", "turn", "bytes", (F.col("base") + F.col("in")).alias("before"))


def refine(members: list, top: int, depth: int) -> tuple[list[list], int, int, int]:
    """Partition refinement of one class. members: (rep, n, ends, [(turn, bytes), ...] behind the class's depth); top: its smallest
    conversation. Returns the nodes below it, and its children, leaves below it, and bytes saved below it."""
    nodes: list[list] = [[top, depth, None, 0, 0, 0, 0, EMPTY, -1, 0]]  # the last two: the parent's place, the last turn's bytes
    active = [(0, members)]
    while active:
        grown = []
        for at, inside in active:
            conv, level = nodes[at][0], nodes[at][1]
            split: dict[bytes, list] = {}
            for m in inside:
                if len(m[3]) == level - depth:
                    nodes[at][7] = m[2]
                else:
                    split.setdefault(m[3][level - depth][0], []).append(m)
            for part in split.values():
                least, n = min(m[0] for m in part), sum(m[1] for m in part)
                nodes.append([least, level + 1, conv, n, 0, 0, 0, EMPTY, at, part[0][3][level - depth][1]])
                if len(part) > 1:
                    grown.append((len(nodes) - 1, part))
                    continue
                for _, size in part[0][3][level - depth + 1 :]:  # one sequence: the rest is a chain
                    nodes.append([least, nodes[-1][1] + 1, least, n, 0, 0, 0, EMPTY, len(nodes) - 1, size])
                nodes[-1][7] = part[0][2]
        active = grown
    for x in reversed(nodes[1:]):
        x[5] = x[5] or 1
        x[6] += (x[3] - 1) * x[9]
        above = nodes[x[8]]
        above[4] += 1
        above[5] += x[5]
        above[6] += x[6]
    return [x[:8] for x in nodes[1:]], *nodes[0][4:7]


_NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, top boolean"


def _finish(batches):
    """Turns to go of small classes, by class, sequence and place; a row for each node below a class, and one for the class itself
    (top) with what it has of them."""
    kinds = [pa.int64()] * 7 + [pa.string(), pa.bool_()]
    out: list[list] = []
    key, members = None, []
    pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [*NODE, "top"])

    def done():
        nodes, children, leaves, saved = refine(members, *key)
        out.extend([*x, False] for x in nodes)
        out.append([*key, None, 0, children, leaves, saved, "", True])

    for batch in batches:
        for top, depth, rep, n, ends, turn, size in zip(*(batch.column(c).to_pylist() for c in ("top", "depth", "rep", "n", "ends", "turn", "bytes")), strict=True):
            if key != (top, depth):
                if key is not None:
                    done()
                key, members = (top, depth), []
            if not members or members[-1][0] != rep:
                members.append((rep, n, ends, []))
            if turn is not None:
                members[-1][3].append((turn, size))
            if len(out) > 5000:
                yield pack()
                out.clear()
    if key is not None:
        done()
    if out:
        yield pack()


def build(convs: DataFrame, turns: DataFrame, *, local: int = LOCAL, scratch: Scratch | None = None) -> DataFrame:
    """The trie's nodes. convs: conv_id, every conversation; turns: conv_id, place (from 0), turn (a digest), bytes.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    scratch = scratch or Scratch(convs.sparkSession, "turn-trie")
    found = sequences(convs, turns, scratch)
    root = found.agg(F.min("rep"), F.sum("n"), F.count(F.lit(1)), F.sum("size")).first()
    # One row for each distinct sequence's turn; those of sequences with copies have their bytes summed.
    mine = turns.withColumnRenamed("conv_id", "rep").join(sized(found.select("rep", F.col("n"))), "rep")
    copied = summed(mine.where("n > 1"), scratch)
    single = mine.where("n = 1").select("rep", "place", "turn", "bytes", F.lit(0).cast("long").alias("before"))
    turns = scratch.save(single.union(copied).repartitionByRange("place", "rep").sortWithinPartitions("place", "rep"), "places")
    total = scratch.save(turns.groupBy("rep").agg(F.sum("bytes").alias("total")), "total")

    # tops: the nodes that the rounds made, by depth; below: what classes that are retired have below them.
    spark = convs.sparkSession
    tops = [scratch.save(found.where("size = 0").groupBy().agg(F.max("ends").alias("e")).select(*[F.lit(v).cast("long").alias(c) for c, v in (("conv_id", root[0]), ("depth", 0), ("parent_conv_id", None), ("n_convs", root[1]))], F.lit(0).cast("long").alias("bytes"), F.coalesce("e", F.lit(EMPTY)).alias("ends_sha256")).where(F.col("conv_id").isNotNull()), "top-0")]
    active = scratch.save(found.select(F.lit(root[0]).cast("long").alias("top"), "rep", "n", "size", "ends", F.lit(root[2]).cast("long").alias("members"), F.lit(root[3]).cast("long").alias("left")), "members-0")
    chains, smalls = [], []
    depth = 0
    while True:
        # Retire classes of one sequence, hand over the small ones, split the others.
        alive = active.where(F.col("size") > depth)
        chains.append(active.where("members = 1").select("top", F.lit(depth).cast("long").alias("depth"), "rep", "n", "size", "ends"))
        small = (F.col("members") > 1) & (F.col("left") <= local)
        smalls.append(active.where(small).select("top", F.lit(depth).cast("long").alias("depth"), "rep", "n", "size", "ends"))
        alive = alive.where((F.col("members") > 1) & ~small)
        if alive.isEmpty():
            break
        at = turns.where(F.col("place") == depth).select("rep", "turn", "bytes")
        stepped = scratch.save(alive.join(at, "rep"), f"stepped-{depth}")
        split = stepped.groupBy("top", "turn").agg(F.min("rep").alias("child"), F.sum("n").alias("n_convs"), F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("members"), F.sum(F.col("size") - depth - 1).alias("left"), F.max(F.when(F.col("size") == depth + 1, F.col("ends"))).alias("e"))
        split = scratch.save(split, f"split-{depth}")
        depth += 1
        tops.append(split.select(F.col("child").alias("conv_id"), F.lit(depth).cast("long").alias("depth"), F.col("top").alias("parent_conv_id"), "n_convs", "bytes", F.coalesce("e", F.lit(EMPTY)).alias("ends_sha256")))
        joined = stepped.select("top", "turn", "rep", "n", "size", "ends").join(sized(split.select("top", "turn", "child", "members", "left")), ["top", "turn"])
        active = scratch.save(joined.select(F.col("child").alias("top"), "rep", "n", "size", "ends", "members", "left"), f"members-{depth}")

    # Chains: every turn behind the class's depth is a node; what is saved below it is known from the running sums.
    chain = scratch.save(reduce(DataFrame.union, chains), "chains")
    links = turns.join(sized(chain.select("top", "depth", "rep", "n", "size", "ends")), "rep").where(F.col("place") >= F.col("depth")).join(sized(total), "rep")
    last = F.col("place") + 1 == F.col("size")
    tails = links.select(
        F.col("rep").alias("conv_id"), (F.col("place") + 1).cast("long").alias("depth"), F.col("rep").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("n") - 1) * (F.col("total") - F.col("before"))).alias("saved_tokens"), F.when(last, F.col("ends")).otherwise(EMPTY).alias("ends_sha256"), F.lit(False).alias("top"),
    )
    heads = links.where(F.col("place") == F.col("depth")).select(F.col("top").alias("conv_id"), "depth", F.lit(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("n") - 1) * (F.col("total") - F.col("before"))).alias("saved_tokens"))

    small = scratch.save(reduce(DataFrame.union, smalls), "smalls")
    togo = small.join(turns.select("rep", "place", "turn", "bytes"), "rep").where(F.col("place") >= F.col("depth")).select("top", "depth", "rep", "n", "ends", "place", "turn", "bytes")
    # A sequence that ends at its class has no turns to go.
    done = small.where("size = depth").select("top", "depth", "rep", "n", "ends", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("long").alias("bytes"))
    finished = scratch.save(togo.union(done).repartition("top", "depth").sortWithinPartitions("top", "depth", "rep", "place").mapInArrow(_finish, _NODES), "finished")

    below = scratch.save(heads.union(finished.where("top").select(*heads.columns)), "below")
    folded, level = [], None
    for d in range(depth, -1, -1):
        sums = below.where(F.col("depth") == d).select("conv_id", "n_children", "n_leaves", "saved_tokens")
        if level is not None:
            sums = sums.union(level.where("parent_conv_id is not null").groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")))
        joined = tops[d].join(sums, "conv_id", "left")
        zero = lambda c: F.coalesce(c, F.lit(0))
        level = scratch.save(joined.select("conv_id", "depth", "parent_conv_id", "n_convs", zero("n_children").alias("n_children"), F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), (zero("saved_tokens") + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"), "ends_sha256"), f"folded-{d}")
        folded.append(level)
    upper = reduce(DataFrame.union, folded)
    return upper.union(tails.select(*NODE)).union(finished.where("not top").select(*NODE))


def last_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes with role and text of the turn that leads to them. turns: conv_id, place, role, text of the built conversations."""
    return nodes.join(turns.select("conv_id", (F.col("place") + 1).alias("depth"), "role", "text"), ["conv_id", "depth"], "left")


def prefix_trie(df: DataFrame, **columns) -> DataFrame:
    """The trie of conversations as they are. columns: conv_col, turn_col, role_col, text_col."""
    scratch = Scratch(df.sparkSession, "turn-trie")
    turns = scratch.save(digested(numbered(df, **columns)), "turns")
    return build(turns.select("conv_id").distinct(), turns, scratch=scratch)


def rebuilt_trie(df: DataFrame, *, local: int = LOCAL, **columns) -> DataFrame:
    """The trie of conversations that share heads: see regrouped()."""
    scratch = Scratch(df.sparkSession, "turn-trie")
    convs, turns = _rebuilt(scratch.save(digested(numbered(df, **columns)), "turns"), scratch)
    return build(convs, turns, local=local, scratch=scratch)


ORACLE_SQL = """
WITH RECURSIVE tab(i, k, v) AS (
  SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM tab WHERE k < 8),
ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
crc(c, s, p, v) AS (
  SELECT c, c::VARCHAR, 0, 4294967295 FROM ids
  UNION ALL SELECT c, s, p + 1, xor(crc.v >> 8, t.v) FROM crc JOIN tab t ON t.k = 8 AND t.i = xor(crc.v, ascii(substr(s, p + 1, 1))) & 255 WHERE p < length(s)),
h AS (SELECT c, xor(v, 4294967295) % 9 AS h FROM crc WHERE p = length(s)),
o AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
r AS (
  SELECT h.c, 0 AS own, o.place, role, text FROM h JOIN o ON o.c = h.c - h.c % 5 AND o.place < h.h
  UNION ALL SELECT h.c, 1, o.place, role, text FROM h JOIN o ON o.c = h.c AND o.place >= h.h),
t AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, place) AS d, length(role) || ':' || role || length(text) || ':' || text AS turn, strlen(text) AS bytes FROM r),
pre AS (
  SELECT c, 0 AS d, '' AS path, 0 AS bytes FROM h
  UNION ALL SELECT c, d, string_agg(turn, '') OVER (PARTITION BY c ORDER BY d), bytes FROM t),
m AS (SELECT *, min(c) OVER (PARTITION BY d, path) AS node, max(d) OVER (PARTITION BY c) AS size FROM pre),
n AS (
  SELECT node AS conv_id, d AS depth, count(*) AS n_convs, max(bytes) AS bytes, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (size = d), '')) AS ends_sha256
  FROM m GROUP BY node, d),
parent AS (SELECT n.conv_id, n.depth, m.node AS parent FROM n JOIN m ON m.c = n.conv_id AND m.d = n.depth - 1),
kids AS (SELECT parent AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM parent GROUP BY ALL),
sub AS (
  SELECT m.node AS conv_id, m.d AS depth, count(*) FILTER (kids.n_children IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved_tokens
  FROM n JOIN m ON m.c = n.conv_id AND m.d <= n.depth LEFT JOIN kids ON kids.conv_id = n.conv_id AND kids.depth = n.depth GROUP BY ALL)
SELECT n.conv_id, n.depth::BIGINT AS depth, parent AS parent_conv_id, n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM n JOIN sub ON sub.conv_id = n.conv_id AND sub.depth = n.depth LEFT JOIN kids ON kids.conv_id = n.conv_id AND kids.depth = n.depth
LEFT JOIN parent ON parent.conv_id = n.conv_id AND parent.depth = n.depth
"""
