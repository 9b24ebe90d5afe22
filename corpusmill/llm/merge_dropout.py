"""Byte-fallback BPE of a SentencePiece model with seeded merge-dropout, and its exact inverse.

A text is cut into segments (spaces and what follows them; no piece of the model reaches over such a cut, which is checked on
loading). In a segment the best-scored mergeable pair merges first, the leftmost of equals, as an agenda would pop it. A
candidate merge is skipped where a keyed hash of seed, document id, the segment's number, segment and the candidate's place falls
below the dropout rate; it stays skipped until one of its two sides has changed, when it is another candidate. So each
occurrence of a word is cut by itself, and equal seeds give equal ids on any cluster.

Distinct segments of a batch are merged together without dropout, one merge of each in a round, as arrays, and their candidates
kept; occurrences that skip none of these have that result. The others are merged together too, each by its own key. Segments
of more than WIDE symbols are cut first where no piece of the model that is in the text reaches over, which changes no merge; parts
that are still longer are merged together by rank, all occurrences of a merge at once. Spaces are the model's U+2581; a U+2581 of
the text itself, and characters without a piece, become bytes; so decode() gives back every text.

Defined cases: null text has null ids; empty text has no ids; a null id counts as the empty string; repeated rows get equal
ids; other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.dictionary import PhraseTrie
from . import textvec as tv

#: A public model; a parameter of every function here.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
WIDE = 64
CHUNK = 1 << 18
#: Times that a long part may wait for a merge of its own before it takes an agenda.
WAITS = 16
NEVER = np.int32(2**31 - 1)
_ALL = 2**64 - 1
U = np.uint64


class Pairs:
    """Numbers of pairs of ids: open addressing, a pair (40 bits) and its number (24 bits) in one word, so that a look is one."""

    EMPTY = U(2**64 - 1)

    def __init__(self, pairs: np.ndarray):
        self.bits = max(4, int(2 * len(pairs) + 1).bit_length())
        self.table = np.full(1 << self.bits, self.EMPTY, U)
        for number, pair in enumerate(pairs.tolist()):
            slot = int(pair * int(tv.GOLDEN) & _ALL) >> (64 - self.bits)
            while self.table[slot] != self.EMPTY:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.table[slot] = U(pair << 24 | number)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the pairs are in the table, their numbers)."""
        pairs = (left << 20 | right).view(U)
        slot = ((pairs * tv.GOLDEN) >> U(64 - self.bits)).view(np.int64)
        word = self.table[slot]
        hit = word >> U(24) == pairs
        more = np.flatnonzero(~hit & (word != self.EMPTY))
        slot = slot[more]
        while len(more):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            word[more] = self.table[slot]
            again = word[more] >> U(24) == pairs[more]
            hit[more[again]] = True
            go = ~again & (word[more] != self.EMPTY)
            more, slot = more[go], slot[go]
        found = np.flatnonzero(hit)
        return found, (word[found] & U(0xFFFFFF)).view(np.int64)


class Vocabulary:
    """A model's pieces, and its merges: (left id, right id) to (rank, id)."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        ids = {self.pieces[i]: i for i in normal}
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("the model has pieces over word ends")
        self.byte_id = np.array([next(i for i in range(n) if self.pieces[i] == f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.output = [b""] * n
        for i in normal:
            self.output[i] = self.pieces[i].replace(SPACE, " ").encode()
        for b in range(256):
            self.output[self.byte_id[b]] = bytes([b])
        scores = np.array([sp.get_score(i) for i in range(n)])
        rank = np.unique(-scores, return_inverse=True)[1]
        self.merges = {(ids[p[:k]], ids[p[k:]]): (int(rank[i]), i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        pairs = np.array([a << 20 | b for a, b in self.merges], U)
        self.find = Pairs(pairs).find
        self.rank, self.merged = (np.array(x, np.int32) for x in zip(*self.merges.values(), strict=True))
        single = {p.encode(): i for p, i in ids.items() if len(p) == 1 and p != SPACE}
        self.chars = tv.Lookup(np.array([int.from_bytes(c, "big") + (len(c) << 40) for c in single], U))
        self.char_id = np.array(list(single.values()), np.int32)
        self.one_byte = self.byte_id.copy()
        self.one_byte[[ord(p) for p in ids if len(p) == 1 and ord(p) < 0x80]] = [i for p, i in ids.items() if len(p) == 1 and ord(p) < 0x80]
        self.one_byte[0x20] = ids[SPACE]
        self.trie = PhraseTrie([p.replace(SPACE, " ") for p in ids])


@lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Vocabulary:
    return Vocabulary(model)


def symbols(v: Vocabulary, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first piece ids, the byte each begins at): a known character is one symbol, the bytes of others one each."""
    ids, begins = v.one_byte[data], np.ones(len(data), bool)
    lead = np.flatnonzero(data >= 0xC0)
    size = 2 + (data[lead] >= 0xE0).astype(np.int64) + (data[lead] >= 0xF0)
    packed = data[lead].astype(U)
    wide = np.append(data, np.zeros(4, np.uint8))
    for k in range(1, 4):
        rows = size > k
        packed[rows] = (packed[rows] << U(8)) | wide[lead[rows] + k]
    found = v.chars.find(packed + (size.astype(U) << U(40)))
    known = found >= 0
    ids[lead[known]] = v.char_id[found[known]]
    for k in range(1, 4):
        begins[lead[known & (size > k)] + k] = False
    at = np.flatnonzero(begins)
    return ids[at], at


def _skipped(key: np.ndarray, a, b, c, rate: int) -> np.ndarray:
    """Is the candidate of symbols [a, b) and [b, c) skipped?"""
    place = (a.astype(U) << U(42)) | (b.astype(U) << U(21)) | c.astype(U)
    return tv.mix(key ^ tv.mix(place + tv.GOLDEN)) < U(rate)


def merge_rounds(v: Vocabulary, ids: np.ndarray, sizes: np.ndarray, keys: np.ndarray, off: np.ndarray, rate: int, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All parts of up to WIDE symbols at once. ids: n x width; sizes, keys and where the part begins in its segment by row. The
    final ids, one after another, and their number by row. seen: takes the candidates, as arrays of rows and three columns."""
    n, width = ids.shape
    # A symbol is a place in the whole grid; next and previous ones are places too, or -1.
    col = np.tile(np.arange(width), n)
    ids, alive = ids.ravel().astype(np.int64), col < np.repeat(sizes, width)
    place = np.arange(n * width)
    nxt, prv = np.where(col + 1 < np.repeat(sizes, width), place + 1, -1), np.where(col > 0, place - 1, -1)
    end = col + 1  # where the symbol that begins here ends
    best, into = np.full(n * width, NEVER), np.zeros(n * width, np.int32)
    grid = best.reshape(n, width)

    def ask(p):
        """Ranks of the candidates that begin at places p."""
        right = nxt[p]
        ok = right >= 0
        p, right = p[ok], right[ok]
        found, at = v.find(ids[p], ids[right])
        p, right = p[found], right[found]
        if rate or seen is not None:
            row, a, b, c = p // width, col[p], col[right], end[right]
        if seen is not None:
            seen.append((row, a, b, c))
        if rate:
            go = ~_skipped(keys[row], off[row] + a, off[row] + b, off[row] + c, rate)
            p, at = p[go], at[go]
        best[p], into[p] = v.rank[at], v.merged[at]

    ask(np.flatnonzero(alive))
    rows = np.arange(n)
    while len(rows):
        p = rows * width + grid[rows].argmin(axis=1)
        go = best[p] != NEVER
        rows, p = rows[go], p[go]
        if not len(rows):
            break
        right = nxt[p]
        after = nxt[right]
        ids[p], end[p], nxt[p] = into[p], end[right], after
        alive[right], best[right], best[p] = False, NEVER, NEVER
        inner = after >= 0
        prv[after[inner]] = p[inner]
        before = prv[p]
        before = before[before >= 0]
        best[before] = NEVER
        ask(np.concatenate([p, before]))
    return ids[alive].astype(np.int32), alive.reshape(n, width).sum(axis=1)


def _mixed(x: int) -> int:
    """textvec.mix() of one number."""
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _ALL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _ALL
    return x ^ (x >> 31)


def merge_agenda(v: Vocabulary, ids: list[int], key: int, rate: int, off: int = 0) -> list[int]:
    """One part of any length, by an agenda of candidates. off: where it begins in its segment."""
    n = len(ids)
    nxt, prv, end, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    agenda: list[tuple[int, int, int, int, int]] = []
    golden = int(tv.GOLDEN)

    def ask(a):
        b = nxt[a]
        if b < n and (m := v.merges.get((ids[a], ids[b]))):
            place = (a + off) << 42 | (b + off) << 21 | (end[b] + off)
            if not rate or _mixed(key ^ _mixed((place + golden) & _ALL)) >= rate:
                heapq.heappush(agenda, (m[0], a, b, end[b], m[1]))

    for a in range(n):
        ask(a)
    while agenda:
        _, a, b, stop, piece = heapq.heappop(agenda)
        if not (alive[a] and b < n and alive[b] and nxt[a] == b and end[b] == stop):
            continue  # one of its sides has changed
        ids[a], alive[b], nxt[a], end[a] = piece, False, nxt[b], end[b]
        if nxt[a] < n:
            prv[nxt[a]] = a
        ask(a)
        if prv[a] >= 0:
            ask(prv[a])
    return [i for i, x in zip(ids, alive, strict=True) if x]


def merge_by_rank(v: Vocabulary, ids: np.ndarray, sizes: np.ndarray, keys: np.ndarray, off: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts of any length, one after another in ids, at once: the final ids and their number by part.

    Ranks come up in order, each with all its candidates, which an agenda would take from left to right: of candidates over one
    another every second is merged. A merge may make a candidate of a lower or equal rank, which the agenda would take before the
    merges to its right; in such a part the merges up to that one are done, and the others wait until their rank comes up again. A
    part that waits more than WAITS times, as a long run of one sign does, is merged by an agenda."""
    n, given, waits, whole = len(ids), {}, np.zeros(len(sizes), np.int64), ids
    ids, which = ids.astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(sizes) - sizes
    place = np.arange(n) - first[which] + off[which]
    nxt, prv, end, key = np.arange(1, n + 1), np.arange(-1, n - 1), place + 1, keys[which]
    nxt[(first + sizes - 1)[sizes > 0]] = -1
    prv[first[sizes > 0]] = -1
    alive, marked = np.ones(n, bool), np.zeros(n, bool)
    rank, into = np.full(n, NEVER), np.zeros(n, np.int64)
    waiting: dict[int, list[np.ndarray]] = {}
    ranks: list[int] = []

    def found(left, right, a, b, c, k):
        """(rank, piece) of the candidates of symbols left and right, at places a, b and c; NEVER for none."""
        ranks, pieces = np.full(len(left), NEVER), np.zeros(len(left), np.int64)
        where, at = v.find(left, right)
        if rate:
            go = ~_skipped(k[where], a[where], b[where], c[where], rate)
            where, at = where[go], at[go]
        ranks[where], pieces[where] = v.rank[at], v.merged[at]
        return ranks, pieces

    def wait(r: int, at: np.ndarray) -> None:
        if r not in waiting:
            waiting[r] = []
            heapq.heappush(ranks, r)
        waiting[r].append(at)

    def ask(at):
        rank[at] = NEVER
        at = at[nxt[at] >= 0]
        right = nxt[at]
        rank[at], into[at] = found(ids[at], ids[right], place[at], place[right], end[right], key[at])
        at = at[rank[at] != NEVER]
        at = at[np.argsort(rank[at], kind="stable")]
        cut = np.flatnonzero(np.diff(rank[at])) + 1
        for part in np.split(at, cut) if len(at) else ():
            wait(int(rank[part[0]]), part)

    ask(np.arange(n))
    while ranks:
        r = heapq.heappop(ranks)
        at = np.unique(np.concatenate(waiting.pop(r)))
        at = at[alive[at] & (rank[at] == r)]
        if not len(at):
            continue
        marked[at] = True
        over = (prv[at] >= 0) & marked[prv[at]]  # over the candidate to the left
        marked[at] = False
        index = np.arange(len(at))
        c = at[(index - np.maximum.accumulate(np.where(over, 0, index))) % 2 == 0]
        right = nxt[c]
        after, stop, made = nxt[right], end[right], into[c]
        # The symbol to the left, which may be a merge of this round, and the one to the right, before its own.
        marked[right] = True
        left = prv[c]
        merged = (left >= 0) & marked[left]
        marked[right] = False
        left = np.where(merged, prv[left], left)
        early = np.zeros(len(c), bool)
        some = np.flatnonzero(after >= 0)
        early[some] = found(made[some], ids[after[some]], place[c[some]], stop[some], end[after[some]], key[c[some]])[0] <= r
        some = np.flatnonzero(left >= 0)
        symbol = np.where(merged[some], into[left[some]], ids[left[some]])
        early[some] |= found(symbol, made[some], place[left[some]], place[c[some]], stop[some], key[c[some]])[0] <= r
        if early.any():
            limit = np.full(len(sizes), n)
            np.minimum.at(limit, which[c[early]], c[early])
            go = c <= limit[which[c]]
            c, right, after, stop, made = c[go], right[go], after[go], stop[go], made[go]
            behind = np.flatnonzero(limit < n)
            waits[behind] += 1
            for part in behind[waits[behind] > WAITS].tolist():
                own = slice(first[part], first[part] + sizes[part])
                given[part] = merge_agenda(v, whole[own].tolist(), int(keys[part]), rate, int(off[part]))
                alive[own], rank[own] = False, NEVER
            if given:
                go = alive[c]
                c, right, after, stop, made = c[go], right[go], after[go], stop[go], made[go]
            wait(r, at)
        ids[c], end[c], nxt[c] = made, stop, after
        alive[right], rank[right] = False, NEVER
        prv[after[after >= 0]] = c[after >= 0]
        before = prv[c]
        ask(np.unique(np.concatenate([c, before[before >= 0]])))
    counts = np.bincount(which[alive], minlength=len(sizes))
    if not given:
        return ids[alive].astype(np.int32), counts
    lists = np.split(ids[alive], np.cumsum(counts)[:-1])
    lists = [np.array(given.get(part, own), np.int32) for part, own in enumerate(lists)]
    return np.concatenate(lists), np.array([len(x) for x in lists])


def _parts(v: Vocabulary, flat: np.ndarray, place: np.ndarray, begins: np.ndarray, sizes: np.ndarray, base: np.ndarray):
    """(segment, first symbol, symbols) of the parts that segments are merged in: segments of more than WIDE symbols are cut where
    no piece that is in the text reaches over."""
    long = np.flatnonzero(sizes > WIDE)
    if not len(long):
        return np.arange(len(sizes)), begins[:-1], sizes
    symbol = np.repeat(begins[long] - (np.cumsum(sizes[long]) - sizes[long]), sizes[long]) + np.arange(sizes[long].sum())
    segment = np.repeat(long, sizes[long])
    start = place[symbol]
    reach = start + 1
    for begin, end, _ in v.trie.walk(flat, start, base[segment + 1]):
        reach[np.searchsorted(start, begin)] = end
    far = np.maximum.accumulate(reach)  # segments stand one after another, and no piece reaches beyond its segment
    cut = np.concatenate([[True], (far[:-1] <= start[1:]) | (segment[1:] != segment[:-1])])
    first = symbol[cut]
    last = np.concatenate([np.flatnonzero(cut)[1:], [len(symbol)]]) - 1
    short = np.flatnonzero(sizes <= WIDE)
    owner, begin, size = np.concatenate([short, segment[cut]]), np.concatenate([begins[short], first]), np.concatenate([sizes[short], symbol[last] - first + 1])
    order = np.lexsort((begin, owner))
    return owner[order], begin[order], size[order]


def _merged(v: Vocabulary, data, start, stop, keys, rate: int, seen: list | None = None):
    """(ids of the segments, one after another; where each segment's begin; their numbers; the segments' symbols). seen: takes the
    candidates; segments of more than WIDE symbols are left out then."""
    # The segments' bytes, one after another.
    length = stop - start
    base = np.concatenate([[0], np.cumsum(length)])
    flat = data[np.repeat(start - base[:-1], length) + np.arange(base[-1])]
    ids, place = symbols(v, flat)
    begins = np.searchsorted(place, base)
    sizes = np.diff(begins)
    if seen is None:
        owner, begin, size = _parts(v, flat, place, begins, sizes, base)
    else:
        owner, begin, size = np.arange(len(sizes)), begins[:-1], np.where(sizes > WIDE, 0, sizes)
    off = begin - begins[owner]
    counts, parts, order = np.zeros(len(owner), np.int64), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for low, high in ((0, 3), (3, 5), (5, 7), (7, 9), (9, 12), (12, 16), (16, 32), (32, WIDE)):
        rows = np.flatnonzero((size > low) & (size <= high))
        if len(rows):
            grid = np.zeros((len(rows), high), np.int32)
            inside = np.arange(high) < size[rows][:, None]
            grid[inside] = ids[(begin[rows][:, None] + np.arange(high))[inside]]
            found = None if seen is None else []
            out, counts[rows] = merge_rounds(v, grid, size[rows], keys[owner[rows]], off[rows], rate, found)
            parts.append(out)
            order.append(rows)
            if found:
                seen.extend((owner[rows[r]], *columns) for r, *columns in found)
    rows = np.flatnonzero(size > WIDE)
    if len(rows):
        some = ids[np.repeat(begin[rows] - (np.cumsum(size[rows]) - size[rows]), size[rows]) + np.arange(size[rows].sum())]
        out, counts[rows] = merge_by_rank(v, some, size[rows], keys[owner[rows]], off[rows], rate)
        parts.append(out)
        order.append(rows)
    order, pool = np.concatenate(order), np.concatenate(parts)
    where = np.zeros(len(owner), np.int64)
    where[order] = np.cumsum(counts[order]) - counts[order]
    # Parts in the order of their segments again.
    to = np.cumsum(counts) - counts
    pool = pool[np.repeat(where - to, counts) + np.arange(counts.sum())]
    many = np.bincount(owner, weights=counts, minlength=len(start)).astype(np.int64)
    return pool, np.cumsum(many) - many, many, sizes


def _skips(which: np.ndarray, keys: np.ndarray, seen: list, n: int, rate: int) -> np.ndarray:
    """Does an occurrence of segment `which` (of n) skip one of the segment's candidates?"""
    row, a, b, c = (np.concatenate(x) for x in zip(*seen, strict=True)) if seen else (np.zeros(0, np.int64),) * 4
    at = np.argsort(row, kind="stable")
    a, b, c = a[at], b[at], c[at]
    many = np.bincount(row, minlength=n)
    first = np.cumsum(many) - many
    out, left, k = np.zeros(len(which), bool), np.flatnonzero(many[which]), 0
    while len(left):  # the k-th candidate of all that skipped none before it
        i = first[which[left]] + k
        skip = _skipped(keys[left], a[i], b[i], c[i], rate)
        out[left[skip]] = True
        k += 1
        left = left[~skip]
        left = left[many[which[left]] > k]
    return out


def encode_chunk(v: Vocabulary, data: np.ndarray, offsets: np.ndarray, doc_keys: np.ndarray, dropout: float, seed: int, prefix: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, one after another; where each text begins, and the end). prefix: the model's space before a text. Each
    occurrence of a segment has a key of its own."""
    rate = int(dropout * 2**64) if dropout < 1 else 2**64 - 1
    at = offsets - offsets[0]
    n = np.diff(at)
    full = n > 0
    if prefix:  # one space before each text that is not empty
        own = np.full(len(data) + int(full.sum()), 0x20, np.uint8)
        own[np.arange(len(data)) + np.repeat(np.cumsum(full), n)] = data
        at = np.concatenate([[0], np.cumsum(n + full)])
        data = own
    space = data == 0x20
    begin = space.copy()
    begin[1:] &= ~space[:-1]
    begin[at[:-1][full]] = True
    start = np.flatnonzero(begin)
    stop = np.append(start[1:], len(data))
    first = np.searchsorted(start, at)  # segment of each text
    text = np.repeat(np.arange(len(n)), np.diff(first))
    number = np.arange(len(start)) - first[text]
    up, down = tv._POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    word = tv.mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(U))
    salt = tv.mix(np.array([seed], U) + tv.GOLDEN)
    occurrence = tv.mix(tv.mix(doc_keys.astype(U)[text] ^ salt) + number.astype(U))
    key = tv.mix(word ^ tv.mix(occurrence + salt))
    _, one, which = np.unique(word, return_index=True, return_inverse=True)
    seen: list | None = [] if rate else None
    pool, where, counts, sizes = _merged(v, data, start[one], stop[one], key[one], 0, seen)
    if rate:
        own = np.flatnonzero((sizes > WIDE)[which] | _skips(which, key, seen, len(one), rate))
        _, some, inverse = np.unique(key[own], return_index=True, return_inverse=True)
        some = own[some]
        which[own] = len(one) + inverse
        pool_own, where_own, counts_own, _ = _merged(v, data, start[some], stop[some], key[some], rate)
        where, counts = np.concatenate([where, len(pool) + where_own]), np.concatenate([counts, counts_own])
        pool = np.concatenate([pool, pool_own])
    many = counts[which]
    total = np.concatenate([[0], np.cumsum(many)])
    return pool[np.repeat(where[which] - total[:-1], many) + np.arange(total[-1])], total[first]


_BYTE = np.random.default_rng(20240613).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)


def decode_ids(v: Vocabulary, ids, prefix: bool = True) -> str:
    out = v.output
    text = b"".join([out[i] for i in ids])
    return (text[1:] if prefix else text).decode("utf-8", "surrogatepass")


def _model(path: str, spark):
    """The model's file, read once and sent to the executors (public models have less than 10 MB)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, *, model: str = MODEL, dropout: float = 0.1, seed: int = 7, prefix: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, lossless: the ids decode to the text."""
    held = _model(model, docs.sparkSession)

    def run(batches):
        v = vocabulary(held.value)
        for batch in batches:
            column = batch.column("text")
            data, offsets = tv.bytes_of(column)
            keys = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            for a, b in tv.chunks(offsets, CHUNK):
                part = offsets[a : b + 1]
                raw = data[part[0] : part[-1]]
                ids, begin = encode_chunk(v, raw, part, keys[a:b], dropout, seed, prefix)
                null = column.slice(a, b - a).is_null()
                flat, edges, view, out = ids.tolist(), begin.tolist(), memoryview(raw), v.output
                at = (part - part[0]).tolist()
                same = []
                for i in range(b - a):
                    text = b"".join([out[x] for x in flat[edges[i] : edges[i + 1]]])
                    same.append((text[1:] if prefix else text) == view[at[i] : at[i + 1]])
                lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids), mask=null)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), lists, pa.array(same)], ["doc_id", "ids", "lossless"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("key"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, "doc_id long, ids array<int>, lossless boolean")


def decode(encoded: DataFrame, *, model: str = MODEL, prefix: bool = True, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text."""
    held = _model(model, encoded.sparkSession)

    def run(batches):
        v = vocabulary(held.value)
        for batch in batches:
            texts = [None if x is None else decode_ids(v, x, prefix) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
