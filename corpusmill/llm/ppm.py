"""Prediction by partial matching over bytes, and a smoothed word unigram beside it.

Training counts every run of ORDER + 1 bytes of the training texts (A-Z lower-cased, with an end symbol after and start symbols
before each text) in all partitions; sums of them are the trie's lower orders. A symbol is coded in the longest context seen;
where it did not follow there, an escape of the context's estimate d / (n + d) is coded (d distinct symbols, n in all) and
the next shorter context is asked with the symbols of the longer one excluded; below order 0 the symbols never seen are
equally likely. A shorter context counts a symbol once for each longer context that it followed, as it is only asked where
the longer ones did not know. As contexts are nested, what is excluded depends on the longer context alone, so the code length of a byte is
a few lookups, done for whole batches.

The trie is whole however many strings it has (a caller may bound each order by `nodes`). It is dealt out by the two symbols
before the newest: what the coding of a string looks up at orders from 2 up shares them, and orders 0 and 1 have a fixed size
and are sent to all. Two symbols with over CROWDED strings are dealt out by the third symbol before the newest, those of three by
the fourth, and so on, and each such part gets a copy of the few shorter strings that it looks up; where all symbols but one are
shared, a context has 258 * 258 strings at most, so no part grows with the texts. So each distinct string of the texts is coded
once, in its part of the trie. Scorers hold the code lengths
of the most frequent strings (at most CODES), and the rest meet theirs in a join. Word counts are whole in the same way:
scorers hold the most frequent words (at most WORDS), and the rest meet their counts in a join.

Defined cases: null text is empty, its only token is the end; a null id counts as the empty string; without training texts all
counts are 0 and each symbol of a text is coded with 1 / 257; repeated rows each train and each get a row. Words are told
apart by 64-bit hashes. Other columns of the input are ignored.

adaptive_log10() codes a text by itself, with a trie that begins empty and learns each byte after it is coded.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textvec as tv
from .scratch import Scratch, sized

ORDER = 5
CODES = 2_000_000
WORDS = 65_536
#: Strings of the dealt trie, and asked ones, in a part.
PART = 500_000
#: Asked strings of a context that stay in one part.
CROWDED = 100_000
#: Bytes that are scored at once, and distinct keys that a counting task holds.
CHUNK, HELD = 1 << 19, 2_000_000
END, START, ALPHABET = 256, 257, 257
#: Words hash to 64 bits; the end token of the unigram has this fixed one.
END_TOKEN = np.uint64(0x0E0D0E0D0E0D0E0D)
_BITS = np.uint64(9)
_LOW = np.arange(258, dtype=np.uint64)
_LOW[ord("A") : ord("Z") + 1] += np.uint64(32)
_GRAM = "key long, n long"
#: Nine bits for a symbol, in a positive long.
MOST_ORDER = 6


def held_out(doc_id, remainder: int = 1):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == remainder


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(order + 1 symbols in one number for each byte and end, newest in the lowest bits; where each text's numbers begin).
    offsets are into data."""
    data, at = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    n = np.diff(at)
    pad = order + 1
    begin = at[:-1] + np.arange(len(n)) * pad  # of each text's start symbols
    symbols = np.full(len(data) + len(n) * pad, START, np.uint64)
    text = np.repeat(np.arange(len(n)), n)
    symbols[np.arange(len(data)) + (text + 1) * pad - 1] = _LOW[data]
    symbols[begin + order + n] = END
    packed = symbols[order:].copy()
    for j in range(1, order + 1):
        packed |= symbols[order - j : len(symbols) - j] << (_BITS * np.uint64(j))
    wanted = np.ones(len(packed), bool)
    wanted[(begin[1:, None] + np.arange(order) - order).ravel()] = False  # runs that end in the next text's start symbols
    return packed[wanted], at[:-1] + np.arange(len(n))


def _count(column, of):
    """Sums by key of a partition; what is held is merged, and if need be sent on, at HELD keys."""

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            data, offsets = tv.bytes_of(batch.column(column))
            for a, b in tv.chunks(offsets, CHUNK):
                keys, counts = np.unique(of(data, offsets[a : b + 1]), return_counts=True)
                parts.append((keys, counts))
                held += len(keys)
                if held > HELD:
                    parts = [tv.add_up(parts)]
                    held = len(parts[0][0])
                if held > HELD:
                    yield from out(parts)
                    parts, held = [], 0
        if parts:
            yield from out([tv.add_up(parts)])

    def out(parts):
        keys, counts = parts[0]
        for i in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000].view(np.int64)), pa.array(counts[i : i + 100_000])], ["key", "n"])

    return run


def _tokens(data, offsets):
    h, _ = tv.words(data, offsets)
    return np.append(h, np.full(len(offsets) - 1, END_TOKEN))


def _least_power(table: DataFrame, limit: int) -> int:
    """The least power of two that at most limit rows reach with their n."""
    sizes = table.groupBy(F.floor(F.log2(F.col("n"))).alias("p")).count().orderBy(F.desc("p")).collect()  # 64 rows at most
    kept, power = 0, 0
    for r in sizes:
        if kept + r["count"] > limit:
            return 2 ** (r["p"] + 1)
        kept, power = kept + r["count"], r["p"]
    return 2**power if sizes else 1


class Trie:
    """Sorted strings of each order with their counts, and what coding needs of each context."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]]):
        self.order = len(tables) - 1
        self.levels = []
        below = None
        for k, (keys, counts) in enumerate(tables):  # from order 0 up
            context = keys >> _BITS
            first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(keys) else np.zeros(0, np.int64)
            own = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.r_[first, len(keys)]))
            n = np.bincount(own, weights=counts, minlength=len(first))
            d = np.bincount(own, minlength=len(first)).astype(float)
            level = {"keys": keys, "counts": counts.astype(np.float32), "own": own, "contexts": context[first], "n": n, "d": d}
            if k and len(keys):
                part = keys & np.uint64((1 << (9 * k)) - 1)  # the same string without its oldest symbol
                at = np.searchsorted(below["keys"], part)
                excluded = np.bincount(own, weights=below["counts"][at], minlength=len(first))
                parent = below["own"][at[first]]
                level["rest_n"], level["rest_d"] = below["n"][parent] - excluded, below["d"][parent] - d
            self.levels.append(level)
            below = level
        self.lookups = [(tv.Lookup(x["keys"]), tv.Lookup(x["contexts"])) for x in self.levels]

    def log10(self, packed: np.ndarray) -> np.ndarray:
        """log10 probability of the newest symbol of each string of order + 1 symbols."""
        out = np.zeros(len(packed))
        left = np.arange(len(packed))
        escaped = np.full(len(packed), -1)  # the context of the order above that was escaped from
        for k in range(self.order, -1, -1):
            if not len(left):
                break
            level = self.levels[k]
            key = packed[left] & np.uint64((1 << (9 * (k + 1))) - 1)
            at = self.lookups[k][0].find(key)
            seen = at >= 0
            after = escaped >= 0
            n, d = np.zeros(len(left)), np.zeros(len(left))
            if after.any():
                above = self.levels[k + 1]
                n[after], d[after] = above["rest_n"][escaped[after]], above["rest_d"][escaped[after]]
            own = np.full(len(left), -1)
            own[seen] = level["own"][at[seen]]
            missing = ~seen
            own[missing] = self.lookups[k][1].find(key[missing] >> _BITS)
            fresh = ~after & (own >= 0)
            n[fresh], d[fresh] = level["n"][own[fresh]], level["d"][own[fresh]]
            out[left[seen]] += np.log10(level["counts"][at[seen]] / (n[seen] + d[seen]))
            escape = missing & (own >= 0) & (d > 0)
            out[left[escape]] += np.log10(d[escape] / (n[escape] + d[escape]))
            left, escaped = left[missing], own[missing]
        if len(left):
            out[left] -= math.log10(max(1, ALPHABET - len(self.levels[0]["keys"])))
        return out


def _sorted(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = part["key"].to_numpy().view(np.uint64)
    at = np.argsort(keys)
    return keys[at], part["m"].to_numpy()[at]


def _code(low, order):
    """log10 of the asked strings (level -1) of a part, by the part's strings of the orders from 2 up and all of low."""

    def run(batches):
        batches = list(batches)
        if not batches:
            return
        rows = pa.Table.from_batches(batches)
        level = rows["level"].to_numpy()
        asked = rows.filter(pa.array(level < 0))
        if not len(asked):
            return
        trie = Trie(low.value + [_sorted(rows.filter(pa.array(level == k))) for k in range(len(low.value), order + 1)])
        for batch in asked.to_batches(100_000):
            code = trie.log10(batch.column("key").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("m"), pa.array(code)], ["key", "n", "code"])

    return run


def dealt(rows: DataFrame, scratch: Scratch, order: int, crowded: int | None = None) -> DataFrame:
    """rows (level, key, m; asked strings have level -1) with depth and context: the symbols before the newest that a part shares.
    A context with more than `crowded` asked strings is dealt out by one symbol more; strings too short to tell which are copied
    to each, 257 times 258 rows at most."""
    crowded = CROWDED if crowded is None else crowded
    of = lambda depth: F.shiftright("key", 9).bitwiseAND(F.lit((1 << (9 * depth)) - 1))
    depth, rows, done = 2, rows.withColumn("context", of(2)), []
    while depth < order - 1:
        hot = scratch.save(rows.where("level = -1").groupBy("context").count().where(F.col("count") > crowded).select("context"), f"crowded-{depth}")
        if hot.isEmpty():
            break
        hot = sized(hot)
        done.append(rows.join(hot, "context", "left_anti").select(F.lit(depth).alias("depth"), "context", "level", "key", "m"))
        within = rows.join(hot, "context", "left_semi")
        longer = (F.col("level") < 0) | (F.col("level") > depth)
        parts = sized(scratch.save(within.where("level = -1").select("context", of(depth + 1).alias("next")).distinct(), f"parts-{depth}"))
        copied = within.where(~longer).join(parts, "context").select("level", "key", "m", F.col("next").alias("context"))
        depth += 1
        rows = within.where(longer).select("level", "key", "m", of(depth).alias("context")).union(copied)
    return reduce(DataFrame.union, [*done, rows.select(F.lit(depth).alias("depth"), "context", "level", "key", "m")])


def codes(source: DataFrame, scratch: Scratch, order: int = ORDER, nodes: int | None = None) -> DataFrame:
    """key, n, code: each distinct string of order + 1 symbols of source's texts (column text, bytes), how often it occurs, and
    the log10 probability of its newest symbol by the trie of the texts that are not held out."""
    if not 0 <= order <= MOST_ORDER:
        raise ValueError(f"order is 0 to {MOST_ORDER}")
    count = lambda df: df.select("text").mapInArrow(_count("text", lambda data, offsets: grams(data, offsets, order)[0]), _GRAM)
    training, rest = count(source.where(~F.col("held_out"))), count(source.where(F.col("held_out")))
    every = training.withColumn("all", F.col("n")).union(rest.select("key", F.lit(0).cast("long"), "n"))
    every = scratch.save(every.groupBy("key").agg(F.sum("n").alias("n"), F.sum("all").alias("all")), "grams")
    tables = [every.where(F.col("n") > 0).select("key", "n", F.col("n").alias("m"))]
    for k in range(order - 1, -1, -1):
        key = F.col("key").bitwiseAND(F.lit((1 << (9 * (k + 1))) - 1))
        tables.append(scratch.save(tables[-1].groupBy(key.alias("key")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m")), f"grams-{k}"))
    tables.reverse()
    if nodes is not None:
        least = max([1, *[_least_power(t, nodes) for t in tables[1:]]])
        tables[1:] = [t.where(F.col("n") >= least) for t in tables[1:]]
    scratch.release()
    low = source.sparkSession.sparkContext.broadcast([_sorted(t.select("key", "m").toArrow()) for t in tables[:2]])  # 257 and 66,306 rows at most
    rows = every.select(F.lit(-1).alias("level"), "key", F.col("all").alias("m"))
    for k, t in enumerate(tables[2:], 2):
        rows = rows.union(t.select(F.lit(k), "key", "m"))
    parts = max(int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-every.count() // PART))
    return scratch.save(dealt(rows, scratch, order).repartition(parts, "depth", "context").mapInArrow(_code(low, order), "key long, n long, code double"), "codes")


class Table:
    """Keys and their values: what travels. Workers build the lookup from it once; the value of what it lacks is 0."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values, self.lookup = keys, np.append(values, 0.0), None

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the value of each key, is it known)."""
        if self.lookup is None:
            self.lookup = tv.Lookup(self.keys)
        at = self.lookup.find(keys)
        return self.values[at], at >= 0


def _lists(keys, wanted, first):
    """The wanted keys of each text."""
    at = np.flatnonzero(wanted)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, first).astype(np.int32)), pa.array(keys[at].view(np.int64)))


def _score(codes, words, order):
    def run(batches):
        coded, frequent = codes.value, words.value
        for batch in batches:
            data, offsets = tv.bytes_of(batch.column("text"))
            rid, doc_id, out = batch.column("rid"), batch.column("doc_id"), batch.column("held_out")
            for a, b in tv.chunks(offsets, CHUNK):
                part = offsets[a : b + 1]
                packed, begin = grams(data, part, order)
                code, there = coded.find(packed)
                score = np.add.reduceat(code, begin)
                h, first = tv.words(data, part)
                log, known = frequent.find(h)
                sums = np.append(np.cumsum(log), 0.0)
                sums = np.where(first > 0, sums[first - 1], 0.0)
                count = np.concatenate([[0], np.cumsum(known)])[first]
                yield pa.RecordBatch.from_arrays(
                    [rid.slice(a, b - a), doc_id.slice(a, b - a), out.slice(a, b - a), pa.array(np.diff(first) + 1), pa.array(np.diff(count)), pa.array(np.diff(sums)), pa.array(score)]
                    + [_lists(h, ~known, first), _lists(packed, ~there, np.append(begin, len(packed)))],
                    ["rid", "doc_id", "held_out", "n_tokens", "known", "logs", "score", "rare", "rare_grams"],
                )

    return run


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, nodes: int | None = None, frequent: int = WORDS, held: int = CODES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Trained on the documents not held out.
    nodes: a bound on the trie's strings of each order; by default there is none. frequent, held: words and strings that scorers
    hold; the rest are joined."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ppm")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), held_out(F.col(id_col)).alias("held_out"))
    training = source.where(~F.col("held_out"))
    coded = codes(source, scratch, order, nodes)
    seldom = _least_power(coded, held)
    top = coded.where(F.col("n") >= seldom).select("key", "code").toArrow()  # at most `held` rows
    table = Table(top["key"].to_numpy().view(np.uint64), top["code"].to_numpy())
    share = [spark.sparkContext.broadcast(table)]
    del top, table
    scratch.release()
    words = scratch.save(training.select("text").mapInArrow(_count("text", _tokens), _GRAM).groupBy("key").agg(F.sum("n").alias("n")), "words")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    least = _least_power(words, frequent)
    top = words.where(F.col("n") >= least).toArrow()  # at most `frequent` rows
    end = words.where(F.col("key") == F.lit(int(END_TOKEN))).select("n").first()
    end_log = math.log10((end["n"] if end else 0) + 0.5)
    share.append(spark.sparkContext.broadcast(Table(top["key"].to_numpy().view(np.uint64), np.log10(top["n"].to_numpy() + 0.5))))
    seen = source.withColumn("rid", F.monotonically_increasing_id())
    seen = seen.mapInArrow(_score(*share, order), "rid long, doc_id long, held_out boolean, n_tokens long, known long, logs double, score double, rare array<long>, rare_grams array<long>")
    scored = scratch.save(seen, "scored")
    # Only words and strings below the frequent ones move; the others were summed where they stood.
    rare = scored.select("rid", F.explode("rare").alias("key")).join(words.where(F.col("n") < least), "key", "left")
    rare = rare.groupBy("rid").agg(F.count("n").alias("rare_known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("rare_logs"))
    seldom_codes = scored.select("rid", F.explode("rare_grams").alias("key")).join(coded.where(F.col("n") < seldom), "key")
    seldom_codes = seldom_codes.groupBy("rid").agg(F.sum("code").alias("rare_codes"))
    norm = math.log10(total + 0.5 * (distinct + 1))
    has_end = F.lit(1 if end else 0)
    return scored.drop("rare", "rare_grams").join(rare, "rid", "left").join(seldom_codes, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0)) + has_end).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)) + F.lit(end_log) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("score") + F.coalesce("rare_codes", F.lit(0.0))).alias("score"),
    )


def adaptive_log10(text: str, order: int = ORDER) -> float:
    """log10 probability of a text and its end by a trie that begins empty: bytes are coded first, then learned."""
    trie: dict[bytes, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    data, total = [int(_LOW[b]) for b in (text or "").encode()] + [END], 0.0
    for i, s in enumerate(data):
        excluded: set[int] = set()
        contexts = [tuple(data[i - k : i]) for k in range(min(order, i), -1, -1)]
        for c in contexts:
            follow = {x: n for x, n in trie[c].items() if x not in excluded}
            if not follow:
                continue
            n, d = sum(follow.values()), len(follow)
            if s in follow:
                total += math.log10(follow[s] / (n + d))
                break
            total += math.log10(d / (n + d))
            excluded |= follow.keys()
        else:
            total -= math.log10(ALPHABET - len(excluded))
        for c in contexts:
            trie[c][s] += 1
    return total


def score_adaptive(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """doc_id, score: each text coded by itself."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([adaptive_log10(t, order) for t in batch.column("text").to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, score double")
