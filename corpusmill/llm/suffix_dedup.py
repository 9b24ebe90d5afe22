"""Removal of byte strings of a least length that start more than once in the collection, by column-wise suffix sorting.

Two equal strings of L bytes have the same anchor: the K-byte gram with the least hash among their grams (the first of
equals). Neighbouring window starts share an anchor, so a text is cut into runs of window starts, one for each anchor; runs
of the same anchor hash anywhere in the collection are aligned at the anchor. A run whose whole text is found twice is
repeated as a whole. What is left are anchors with runs of different texts: those texts are sorted column by column, from the
right end to the left. Each round puts one symbol before every text of the group, moves the texts to their new order by a
stable sort on it, as the Burrows-Wheeler transform of the collection does, and updates the array of common prefixes of
neighbours. A window start is repeated where its common prefix with a neighbour is L or more. The rounds are bounded by the
runs' length (less than 2 * L), not by the longest document; runs, transforms and intervals pass between the steps as files
of the shared folder and shuffles.

A group of more than GROUP different texts (a passage in very many documents) is not sorted in one task: its runs are cut into
narrower cells of window starts, keyed by the text that all windows of the cell share, and these are resolved in the same way,
down to single windows, where equal keys are equal windows and a count decides.

Defined cases: null text is empty; texts shorter than L lose nothing; equal texts, also repeated rows, lose all their bytes
from L bytes on; matches never cross documents; other columns of the input are ignored. Runs and documents are told apart by
64-bit hashes of document id and text; the texts of runs by 128 bits, anchor and digest together.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import textvec as tv
from .scratch import Scratch, fits

CHUNK = 1 << 18
GROUP = 2_000
#: Widths of cells of window starts after the runs themselves; a cell of one window needs no sorting.
WIDTHS = (16, 1)
#: A run packed in one long: start of the first window, then its anchor's distance from there, then the number of further windows.
_FIELD = 15
RUN = "key long, digest long, ref long, run long, times int, spans array<struct<a: long, b: long>>"
_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _pack(start, lead, more):
    return (start << (2 * _FIELD)) | (lead << _FIELD) | more


def _unpack(run):
    return run >> (2 * _FIELD), (run >> _FIELD) & ((1 << _FIELD) - 1), run & ((1 << _FIELD) - 1)


def gram_of(length: int) -> int:
    return max(4, length // 8)


def ref(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def _digest64(view) -> int:
    return int.from_bytes(hashlib.blake2b(view, digest_size=8).digest(), "little", signed=True)


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours, from the least of prefixes and suffixes of blocks of w."""
    blocks = -(-len(x) // w)
    full = np.full(blocks * w, np.iinfo(x.dtype).max, x.dtype)
    full[: len(x)] = x
    block = full.reshape(blocks, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: len(x) - w + 1], ahead[w - 1 : len(x)])


def text_runs(data: np.ndarray, offsets: np.ndarray, length: int):
    """(text number, anchor hash, start, anchor's distance, further windows) of each run of the texts in data, as arrays."""
    K, U = gram_of(length), np.uint64
    at = offsets - offsets[0]
    n, w = len(data), length - gram_of(length) + 1
    if n >> 28 or w >> _FIELD:  # places and distances have so many bits
        raise ValueError("a text has less than 256 MB, a length less than 32,768 windows")
    if n < length:
        return (np.zeros(0, np.int64),) * 5
    up, down = tv._POWERS.upto(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum(_SYMBOL[data] * up[:-1], out=sums[1:])
    gram = tv.mix((sums[K:] - sums[:-K]) * down[: n - K + 1])
    place = np.arange(len(gram), dtype=U)
    least = sliding_least((gram & ~U((1 << 28) - 1)) | place, w)
    sizes = np.diff(at)
    text = np.repeat(np.arange(len(sizes)), np.maximum(sizes - length + 1, 0))
    shift = np.cumsum(np.maximum(sizes - length + 1, 0)) - np.maximum(sizes - length + 1, 0)
    start = np.arange(len(text)) - shift[text] + at[:-1][text]
    anchor = (least[start] & U((1 << 28) - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]) if len(text) else np.zeros(0, np.int64)
    more = np.diff(np.r_[first, len(text)]) - 1
    return text[first], gram[anchor[first]].view(np.int64), start[first] - at[:-1][text[first]], anchor[first] - start[first], more


_SYMBOL = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _emit_runs(length: int):
    """A row for each different run of a text: runs of a text that are equal (in periodic texts nearly all are) have one row with
    their number and what they cover, as they are repeated whatever other texts have."""

    def run(batches):
        for batch in batches:
            data, offsets = tv.bytes_of(batch.column("text"))
            refs = batch.column("ref").to_numpy(zero_copy_only=False)
            for a, b in tv.chunks(offsets, CHUNK):
                part = np.ascontiguousarray(data[offsets[a] : offsets[b]])
                text, key, start, lead, more = text_runs(part, offsets[a : b + 1], length)
                view, base = memoryview(part), (offsets[a:b] - offsets[a])[text] + start
                digest = np.array([_digest64(view[i:j]) for i, j in zip(base.tolist(), (base + more + length).tolist(), strict=True)], np.int64)
                order = np.lexsort((start, digest, key, text))
                text, key, digest, start, lead, more = (x[order] for x in (text, key, digest, start, lead, more))
                first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])]) if len(text) else np.zeros(0, np.int64)
                times = np.diff(np.r_[first, len(text)])
                spans = [None] * len(first)
                for i in np.flatnonzero(times > 1).tolist():
                    own = slice(first[i], first[i] + times[i])
                    spans[i] = [{"a": a, "b": b} for a, b in _merged(zip(start[own].tolist(), (start[own] + more[own] + length).tolist(), strict=True))]
                run = pa.array(_pack(start, lead, more)[first])
                yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(digest[first]), pa.array(refs[a:b][text[first]]), run, pa.array(times.astype(np.int32)), pa.array(spans, _SPANS)], ["key", "digest", "ref", "run", "times", "spans"])

    return run


def _emit_fragments(length: int):
    def run(batches):
        for batch in batches:
            texts, lists = batch.column("text"), batch.column("runs").to_pylist()
            refs = batch.column("ref").to_pylist()
            out = [], [], [], [], []
            for i, runs in enumerate(lists):
                text = texts[i].as_py()
                for x in runs:
                    start, _, more = _unpack(x["run"])
                    for column, value in zip(out, (x["key"], x["single"], refs[i], x["run"], text[start : start + more + length]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["key", "single", "ref", "run", "text"])

    return run


def _emit_cells(length: int, width: int):
    """Runs cut at multiples of width before the anchor. The key of a cell is the text that all its windows share."""

    def run(batches):
        for batch in batches:
            texts, lists, refs = batch.column("text"), batch.column("runs").to_pylist(), batch.column("ref").to_pylist()
            out = [], [], [], []
            for i, runs in enumerate(lists):
                view = memoryview(texts[i].as_py())
                for x in runs:
                    start, lead, more = _unpack(x["run"])
                    anchor, s = start + lead, start
                    while s <= start + more:
                        cell = (anchor - s) // width  # windows at distances cell * width to cell * width + width - 1
                        latest, earliest = anchor - cell * width, anchor - cell * width - width + 1
                        last = min(latest, start + more)
                        core = hashlib.blake2b(view[latest : earliest + length], digest_size=8, salt=(cell * 64 + width).to_bytes(8, "little")).digest()
                        for column, value in zip(out, (int.from_bytes(core, "little", signed=True), _digest64(view[s : last + length]), refs[i], _pack(s, anchor - s, last - s)), strict=True):
                            column.append(value)
                        s = last + 1
            once = [pa.array(np.ones(len(out[0]), np.int32)), pa.nulls(len(out[0]), _SPANS)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out), *once], ["key", "digest", "ref", "run", "times", "spans"])

    return run


def repeated_windows(group: np.ndarray, texts: list[bytes], lead: np.ndarray, length: int) -> np.ndarray:
    """A row for each text and a column for each distance of a window start before the anchor: is the window repeated in its
    group? group is sorted. Texts are aligned at their anchors and sorted column by column from the right."""
    n, reach = len(texts), int(lead.max()) if len(lead) else 0
    sizes = np.array([len(t) for t in texts])
    columns = reach + int((sizes - lead).max())
    symbol = np.zeros((columns, n), np.int16)  # 0: outside the text; sorts first and matches nothing
    for i, t in enumerate(texts):
        a = reach - lead[i]
        symbol[a : a + sizes[i], i] = np.frombuffer(t, np.uint8)
        symbol[a : a + sizes[i], i] += 1
    order, common = np.arange(n), np.zeros(n, np.int32)
    low = group.astype(np.int64) * 257
    out = np.zeros((n, reach + 1), bool)
    for c in range(columns - 1, -1, -1):
        x = symbol[c][order]
        rank = low[order] + x
        to = np.argsort(rank, kind="stable")
        same = np.r_[False, rank[to][1:] == rank[to][:-1]] & (x[to] > 0)
        new = np.zeros(n, np.int32)
        pairs = np.flatnonzero(same)
        if len(pairs):
            bounds = np.empty(2 * len(pairs), np.int64)
            bounds[::2], bounds[1::2] = to[pairs - 1] + 1, to[pairs] + 1
            padded = np.append(common, np.int32(0))
            new[pairs] = np.minimum.reduceat(padded, bounds)[::2] + 1
        order, common = order[to], new
        if c <= reach:
            far = np.maximum(common, np.append(common[1:], 0)) >= length
            out[order[far], reach - c] = True
    return out


def _sort_groups(length: int):
    """Covered intervals of the texts that occur once. Batches come sorted by key; a group that a batch cuts is kept for the
    next one."""

    def intervals(rows):
        _, group = np.unique(np.array(rows["key"]), return_inverse=True)
        start, lead, _ = _unpack(np.array(rows["run"], dtype=np.int64))
        hit = repeated_windows(group, rows["text"], lead, length)[:, ::-1]  # by window start
        hit &= np.array(rows["single"])[:, None]
        wide = np.zeros((len(hit), hit.shape[1] + 2), np.int8)
        wide[:, 1:-1] = hit
        step = np.diff(wide, axis=1)
        (row, a), (_, b) = np.nonzero(step == 1), np.nonzero(step == -1)
        first = (start + lead - (hit.shape[1] - 1))[row]
        refs = np.array(rows["ref"], dtype=np.int64)[row]
        return pa.RecordBatch.from_arrays([pa.array(refs), pa.array(first + a), pa.array(first + b - 1 + length)], ["ref", "a", "b"])

    def run(batches):
        kept = {c: [] for c in ("key", "single", "ref", "run", "text")}
        for batch in batches:
            for c, column in kept.items():
                column += batch.column(c).to_pylist()
            cut = next((i for i in range(len(kept["key"]) - 1, 0, -1) if kept["key"][i] != kept["key"][i - 1]), 0)
            if cut:
                yield intervals({c: column[:cut] for c, column in kept.items()})
                kept = {c: column[cut:] for c, column in kept.items()}
        if kept["key"]:
            yield intervals(kept)

    return run


def _beside(source: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """source with the lists (ref and one array) of its documents. Where the ids can be broadcast, only texts with a list are
    shuffled, to meet it; other texts stay where they are."""
    ids = lists.select("ref")
    if not fits(ids):
        return source.join(lists, "ref", how)
    met = source.join(F.broadcast(ids), "ref", "left_semi").join(lists, "ref")
    if how == "inner":
        return met
    return met.unionByName(source.join(F.broadcast(ids), "ref", "left_anti"), allowMissingColumns=True)


def _with_runs(source: DataFrame, runs: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """Documents with the list of their runs in question; a list is bounded by its text."""
    lists = runs.groupBy("ref").agg(F.collect_list(F.struct("key", "single", "run")).alias("runs"))
    return _beside(source.select("ref", "text"), scratch.save(lists, label), "inner")


def repeated_intervals(source: DataFrame, length: int, scratch: Scratch, group: int = GROUP) -> DataFrame:
    """ref, a, b: the bytes from a to b of a document are repeated. Intervals of a document may overlap."""
    fragments = _emit_fragments(length)
    runs = source.where(F.octet_length("text") >= length).mapInArrow(_emit_runs(length), RUN)
    covers = None
    widths = [w for w in WIDTHS if w < length]
    for level in range(len(widths) + 1):
        at = f"{length}-{level}"
        runs = scratch.save(runs, f"runs-{at}")
        own = runs.where("times > 1").select("ref", F.explode("spans").alias("s")).select("ref", "s.a", "s.b")
        own = scratch.save(own, f"own-{at}")
        covers = own if covers is None else covers.union(own)
        runs = runs.drop("spans")
        # Sums are written before they are joined: only joins of two plain exchanges have their skewed partitions split.
        keys = scratch.save(runs.groupBy("key").agg(F.sum("times").alias("n")).where("n > 1").select("key"), f"keys-{at}")
        shared = scratch.save(runs.join(keys, "key"), f"shared-{at}")
        scratch.drop(f"runs-{at}", f"keys-{at}")
        scratch.release()
        cells = shared.groupBy("key", "digest").agg(F.sum("times").alias("n"), F.min(F.struct("ref", "run")).alias("one"))
        cells = scratch.save(cells.select("key", "digest", "n", "one.ref", "one.run"), f"cells-{at}")
        whole = shared.where("times = 1").join(cells.where("n > 1").select("key", "digest"), ["key", "digest"])
        start, more = F.shiftright("run", 2 * _FIELD), F.col("run").bitwiseAND(F.lit((1 << _FIELD) - 1))
        whole = scratch.save(whole.select("ref", start.cast("long").alias("a"), (start + more + length).cast("long").alias("b")), f"whole-{at}")
        scratch.drop(f"shared-{at}")
        covers = covers.union(whole)
        if level == len(widths):
            return covers
        mixed = scratch.save(cells.groupBy("key").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1"), f"mixed-{at}")
        left = scratch.save(cells.join(mixed, "key").select("key", "ref", "run", (F.col("n") == 1).alias("single"), (F.col("texts") > group).alias("large")), f"left-{at}")
        small = _with_runs(source, left.where("not large").select("key", "ref", "run", "single"), scratch, f"small-{at}")
        frames = small.mapInArrow(fragments, "key long, single boolean, ref long, run long, text binary")
        sorted_ = frames.repartition(F.col("key")).sortWithinPartitions("key")
        covers = covers.union(scratch.save(sorted_.mapInArrow(_sort_groups(length), "ref long, a long, b long"), f"sorted-{at}"))
        scratch.drop(f"cells-{at}", f"small-{at}")
        scratch.release()
        large = left.where("large").select("key", "ref", "run", "single")
        if large.isEmpty():
            return covers
        runs = _with_runs(source, large, scratch, f"large-{at}").mapInArrow(_emit_cells(length, widths[level]), RUN)
    return covers


def _merged(intervals) -> list[tuple[int, int]]:
    """The maximal runs of a union of intervals, which come in order."""
    out: list[tuple[int, int]] = []
    for a, b in intervals:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _spans(pairs) -> list[tuple[int, int]]:
    return _merged(sorted((x["a"], x["b"]) for x in pairs or ()))


def _cut(text: bytes, spans: list[tuple[int, int]], whole_characters: bool) -> bytes:
    """The text without its spans. whole_characters: a span is narrowed to the characters that lie in it as a whole."""
    kept, at = [], 0
    for a, b in spans:
        if whole_characters:
            while a < b and text[a] & 0xC0 == 0x80:
                a += 1
            while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
                b -= 1
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


_DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _digests(passages: bool):
    def run(batches):
        for batch in batches:
            texts, columns = batch.column("text").to_pylist(), {"doc_id": batch.column("doc_id")}
            spans = [_spans(pairs) for pairs in batch.column("cover").to_pylist()]
            columns["n_bytes"] = pa.array([len(t) for t in texts], pa.int64())
            columns["n_removed"] = pa.array([sum(b - a for a, b in s) for s in spans], pa.int64())
            columns["n_spans"] = pa.array([len(s) for s in spans], pa.int64())
            columns["kept_sha256"] = pa.array([hashlib.sha256(_cut(t, s, False)).hexdigest() for t, s in zip(texts, spans, strict=True)], pa.string())
            if passages:
                columns["n_passage_bytes"] = pa.array([sum(b - a for a, b in _spans(pairs)) for pairs in batch.column("passages").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _texts(batches):
    for batch in batches:
        kept = [_cut(t, _spans(p), True).decode("utf-8", "replace") for t, p in zip(batch.column("text").to_pylist(), batch.column("cover").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.string())], ["row", "text"])


def _with_covers(docs: DataFrame, length: int, id_col: str, text_col: str, group: int, row: Column, passage: int | None = None) -> DataFrame:
    """text (bytes), cover (intervals), row and, where passage is given, the intervals of strings of passage bytes as passages."""
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(ref(F.col(id_col), text).alias("ref"), text.cast("binary").alias("text"), row.alias("row"))
    out = source
    for name, least in (("cover", length), ("passages", passage)):
        if least:
            covers = repeated_intervals(source, least, scratch, group).groupBy("ref").agg(F.collect_list(F.struct("a", "b")).alias(name))
            out = _beside(out, scratch.save(covers, name), "left")
            scratch.drop(*[f"{kind}-{least}-{level}" for kind in ("own", "whole", "sorted", "left", "mixed", "large") for level in range(len(WIDTHS) + 1)])
            scratch.release()
    return out.drop("ref")


def repeats(docs: DataFrame, *, length: int = 400, passage: int | None = None, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: each byte in a string of length bytes that also starts elsewhere goes.
    passage: another length; n_passage_bytes is then the bytes in strings of so many bytes that also start elsewhere. They stay."""
    found = _with_covers(docs, length, id_col, text_col, group, F.col(id_col).cast("long"), passage)
    return found.withColumnRenamed("row", "doc_id").mapInArrow(_digests(bool(passage)), _DIGESTS + ", n_passage_bytes long" * bool(passage))


def without_repeats(docs: DataFrame, *, length: int = 400, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """The documents, all columns, their texts without repeated strings; characters that are cut in part stay; null stays null."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.col(text_col).isNull().alias("_null_text"))
    found = _with_covers(docs, length, id_col, text_col, group, row)
    kept = found.mapInArrow(_texts, f"row {found.schema['row'].dataType.simpleString()}, text string")
    columns = [F.when(~F.col("row._null_text"), F.col("text")).alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns]
    return kept.select(*columns)


def _islands_sql(length: int, name: str) -> str:
    """The maximal runs of bytes in strings of length bytes that start more than once: a to b of document k."""
    return f"""
w{name} AS (SELECT k, i, md5(substr(h, 2 * i + 1, {2 * length})) AS g FROM (SELECT k, h, unnest(range(0, n - {length - 1})) AS i FROM d WHERE n >= {length})),
r{name} AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY g) AS c FROM w{name}) WHERE c > 1),
j{name} AS (SELECT k, i, CASE WHEN i - lag(i) OVER (PARTITION BY k ORDER BY i) <= {length} THEN 0 ELSE 1 END AS new FROM r{name}),
{name} AS (SELECT k, min(i) AS a, max(i) + {length} AS b FROM (SELECT k, i, sum(new) OVER (PARTITION BY k ORDER BY i) AS island FROM j{name}) GROUP BY k, island)"""


def oracle_sql(length: int = 400, passage: int = 200) -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),{_islands_sql(length, "x")},{_islands_sql(passage, "y")},
s AS (SELECT k, a, b, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS before FROM x),
c AS (SELECT k, count(*) AS spans, sum(b - a) AS removed, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM s JOIN d USING (k) GROUP BY k),
p AS (SELECT k, sum(b - a) AS passages FROM y GROUP BY k)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256, coalesce(passages, 0)::BIGINT AS n_passage_bytes
FROM d LEFT JOIN c USING (k) LEFT JOIN p USING (k)
"""
