"""Language labels for the words of mixed-language text.

A word (a run of letters and marks with a letter in it) belongs to the script of its first letter, and only languages that use the script are its
candidates. Each candidate scores the word by the log-probabilities of its letter trigrams with the word's ends. Viterbi
decoding over a text's words, with a penalty for each switch of language, labels spans; all texts of a batch are decoded
together, one word of each in a step. The text's language is the one that labels most letters, and its score is that share.

Learned from all training texts: trigram counts in 2**16 hashed buckets and letters by script, for each language. The model is
languages times a fixed number of buckets: it grows with the number of labels (a quarter of a megabyte each), not with the corpus.

Defined cases: null text, or text without letters (marks alone are none), is 'und' with score 0 and no spans; so is every text
where there was nothing to learn from; rows with a null language are not learned from; of languages with equal letters the first by name
wins; repeated rows count each time they are learned from; other columns of the input are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BUCKETS = 1 << 16
SWITCH = 8.0
ALPHA = 0.5
#: A script is a language's own from this share of its letters.
SCRIPT_SHARE = 0.005
CHUNK = 1 << 20
UNKNOWN = "und"
#: The first code points of blocks, and their script; a block reaches to the next one.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"),
    (0x07C0, "Nko"), (0x0800, "Other"), (0x08A0, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1400, "Canadian"), (0x1680, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1C90, "Georgian"),
    (0x1CC0, "Other"), (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"), (0x2C00, "Other"), (0x2C60, "Latin"), (0x2C80, "Greek"), (0x2D00, "Georgian"), (0x2D30, "Other"),
    (0x2DE0, "Cyrillic"), (0x2E00, "Other"), (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Bopomofo"), (0x3130, "Hangul"), (0x3190, "Han"), (0x31F0, "Kana"), (0x3200, "Han"), (0xA000, "Yi"),
    (0xA4D0, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAB30, "Latin"), (0xAB70, "Cherokee"), (0xABC0, "Other"), (0xAC00, "Hangul"),
    (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF00, "Latin"),
    (0xFF65, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x1B000, "Kana"), (0x1B300, "Other"), (0x20000, "Han"), (0x40000, "Other"),
)
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
WIDTH = BUCKETS + len(SCRIPT_NAMES)


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: is it part of a word; is it a letter; its lower case where that is one character; its script's number."""
    n = sys.maxunicode + 1
    kind = np.fromiter((ord(unicodedata.category(chr(i))[0]) for i in range(n)), np.uint8, n)
    letter = kind == ord("L")
    word = letter | (kind == ord("M"))
    lower = np.arange(n, dtype=np.uint32)
    for i in np.flatnonzero(word):
        if len(x := chr(i).lower()) == 1:
            lower[i] = ord(x)
    edges = np.array([a for a, _ in SCRIPTS])
    number = np.array([SCRIPT_NAMES.index(s) for _, s in SCRIPTS], np.int16)
    return word, letter, lower, number[np.searchsorted(edges, np.arange(n), "right") - 1]


class Words:
    """The words of a list of texts."""

    def __init__(self, texts: list[str]):
        word, letter, lower, script = tables()
        sizes = np.array([len(t) for t in texts])
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        inside = word[points]
        before = np.r_[False, inside[:-1]] if len(points) else inside.copy()
        before[self.at[:-1][self.at[:-1] < len(points)]] = False
        after = np.r_[inside[1:], False] if len(points) else inside.copy()
        after[self.at[1:][self.at[1:] > 0] - 1] = False
        start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        is_letter = letter[points]
        upto = np.concatenate([[0], np.cumsum(is_letter)])
        real = upto[end] > upto[start]  # runs of marks alone are no words
        inside = np.repeat(real, end - start)[np.cumsum(inside) - 1] & inside if len(start) else inside
        self.start, self.end = start[real], end[real]
        self.letters = self.end - self.start
        self.first = np.searchsorted(self.start, self.at)  # word of each text
        first_letter = np.searchsorted(upto, upto[self.start], "right") - 1
        self.script = script[points[first_letter]]
        # Trigrams around each letter; outside the word stands 0.
        middle = np.flatnonzero(inside)
        x = np.where(inside, lower[points], 0).astype(np.uint64)
        left = np.where(before[middle], x[np.maximum(middle - 1, 0)], 0).astype(np.uint64)
        right = np.where(after[middle], x[np.minimum(middle + 1, len(x) - 1)], 0).astype(np.uint64) if len(x) else left
        h = (left << np.uint64(42)) ^ (x[middle] << np.uint64(21)) ^ right
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        self.bucket = (h >> np.uint64(48)).astype(np.int64)
        self.gram = np.concatenate([[0], np.cumsum(self.letters)])[:-1].astype(np.int64)  # first trigram of each word


class Model:
    """Languages, their trigram log-probabilities (bucket by language) and scripts (script by language)."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        grid = np.array([counts[x] for x in self.languages], float).reshape(len(self.languages), WIDTH)
        grams, scripts = grid[:, :BUCKETS], grid[:, BUCKETS:]
        self.log = np.log((grams + ALPHA) / (grams.sum(axis=1, keepdims=True) + ALPHA * BUCKETS)).T.astype(np.float32).copy()
        own = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        self.allowed = np.where(own.any(axis=0), own, True).T.copy()  # a script of none leaves all

    def scores(self, w: Words) -> np.ndarray:
        s = np.add.reduceat(self.log[w.bucket], w.gram, axis=0) if len(w.start) else np.zeros((0, len(self.languages)), np.float32)
        return np.where(self.allowed[w.script], s, np.float32(-1e6))


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The language of each word. Texts are decoded side by side; of equal paths, staying wins, then the first language."""
    count = np.diff(first)
    rows = np.argsort(-count, kind="stable")
    begin, count = first[:-1][rows], count[rows]
    longest = int(count[0]) if len(count) else 0
    active = np.searchsorted(-count, -np.arange(longest), "left")  # texts with more than t words
    out = np.zeros(len(scores), np.int16)
    came = np.zeros(scores.shape, np.int16)
    best = np.zeros((len(rows), scores.shape[1]), np.float64)
    own = np.arange(scores.shape[1], dtype=np.int16)
    for t in range(longest):
        m = active[t]
        at = begin[:m] + t
        if t:
            b = best[:m]
            top = b.argmax(axis=1)
            switch = b[np.arange(m), top] - penalty
            stay = b >= switch[:, None]
            came[at] = np.where(stay, own, top[:, None])
            best[:m] = np.where(stay, b, switch[:, None]) + scores[at]
        else:
            best[:m] = scores[at]
    now = best.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        m = active[t]
        at = begin[:m] + t
        out[at] = now[:m]
        now[:m] = came[at, now[:m]]
    return out


def _slices(texts: list[str]):
    """Texts of like length together, up to CHUNK characters."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    part, size = [], 0
    for i in order:
        if part and size + len(texts[i]) > CHUNK:
            yield part
            part, size = [], 0
        part.append(i)
        size += len(texts[i])
    if part:
        yield part


def _count(batches):
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, languages = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        for part in _slices(texts):
            w = Words([texts[i] for i in part])
            names = sorted({languages[i] for i in part})
            own = np.repeat(np.array([names.index(languages[i]) for i in part]), np.diff(w.first))
            grams = np.bincount(np.repeat(own, w.letters) * WIDTH + w.bucket, minlength=len(names) * WIDTH)
            scripts = np.bincount(own * WIDTH + BUCKETS + w.script, weights=w.letters, minlength=len(names) * WIDTH)
            for name, row in zip(names, (grams + scripts).reshape(len(names), WIDTH), strict=True):
                counts[name] = counts.get(name, 0) + row
    for name, row in counts.items():
        at = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at].astype(np.int64))], ["lang", "bucket", "n"])


def fit(training: DataFrame) -> Model:
    """training: columns text and lang, without nulls."""
    table = training.select("text", "lang").mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = {r["lang"]: np.zeros(WIDTH) for r in training.select("lang").distinct().collect()}
    found = table.toPandas()  # languages times WIDTH rows at most
    for name, rows in found.groupby("lang"):
        counts[name][rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return Model(counts)


def _label(model, penalty: float, spans: bool):
    def run(batches):
        m = model.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            predicted, score, found = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            for part in _slices(texts) if m.languages else ():
                w = Words([texts[i] for i in part])
                label = viterbi(m.scores(w), w.first, penalty)
                text = np.repeat(np.arange(len(part)), np.diff(w.first))
                share = np.bincount(text * len(m.languages) + label, weights=w.letters, minlength=len(part) * len(m.languages)).reshape(len(part), -1)
                total, top = share.sum(axis=1), share.argmax(axis=1)
                for k in np.flatnonzero(total):
                    predicted[part[k]], score[part[k]] = m.languages[top[k]], float(share[k, top[k]] / total[k])
                edge = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (text[1:] != text[:-1])]) if len(label) else np.zeros(0, int)
                last = np.r_[edge[1:], len(label)] - 1
                for a, b in zip(edge.tolist(), last.tolist(), strict=True):
                    k = text[a]
                    found[part[k]].append((int(w.start[a] - w.at[k]), int(w.end[b] - w.at[k]), m.languages[label[a]]) if spans else None)
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(predicted, pa.string()), pa.array(score, pa.float64()), pa.array([len(x) for x in found], pa.int64())]
            names = ["doc_id", "held_out", "lang_pred", "score", "n_spans"]
            if spans:
                kind = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("lang", pa.string())])
                columns.append(pa.array([[dict(zip(("a", "b", "lang"), s, strict=True)) for s in x] for x in found], pa.list_(kind)))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", penalty: float = SWITCH, spans: bool = True) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans and, if asked for, spans: [a, b) in characters and their language. Learns
    from the documents whose crc32 of the id leaves a remainder other than 0 modulo 5."""
    out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), out.alias("held_out"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = fit(source.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull()))
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, held_out boolean, lang_pred string, score double, n_spans long" + ", spans array<struct<a: int, b: int, lang: string>>" * spans
    return source.select("doc_id", "held_out", "text").mapInArrow(_label(held, penalty, spans), schema)
