"""A quality classifier of two views, trained by co-training.

The content view sees a text alone: which words it has, how they are written (repeated, capitalised, ending in signs) and how its
bytes are made up. The metadata view sees a page's record alone: source, language, both together, and the record's length. In
each round both views are fitted to their labelled sets and calibrated on labels that neither is fitted to; each then scores all
unlabelled documents, and the documents that it is surest of, by rank and for either label, go to the other's set as pseudo-labels.
A pseudo-label weighs what its view adds to the share of that label among the known ones, (p - share) / (1 - share), times the
view's skill on the labels that it is not fitted to (twice the area under its ROC curve, less one; LEAST_SKILL at least, as few
labels measure it badly). So a view that tells documents apart only weakly hands over as many labels as the other, of less weight,
and none where a document stands out in nothing. At the end a logistic
combination of both calibrated views, fitted to the calibration labels, scores all documents.

A document is good where quality is 1 and toxic is not 1. Fitting sees at most MAX_LABELLED labelled documents, by order of a hash
of the id; it is a parameter. The pool is every other document: its features are written once, each round scores them all, and a
distributed top-k takes the surest few, a tenth of the labelled set of each kind. One task fits the views to these bounded sets;
what it sends to the driver, and the driver to the scorers, are weight vectors of fixed size.

Defined cases: null text is empty; null source, language or length is a value of its own; labels of a document that disagree count
as bad if any is bad; null labels are ignored; without labels of both kinds every document has the share of good labels as its
score (1 without labels); repeated rows each get a row, and are fitted to once; rows that share an id and not a text share its
label; documents without an id are scored and not fitted to; of equally sure documents the first by hash of id and text is taken;
other columns of the input are ignored.
"""

from __future__ import annotations

import math
import pickle
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textvec as tv
from .scratch import Scratch

BITS = 18
MAX_LABELLED = 5000
ROUNDS = 3
LEAST_SKILL = 0.1
#: Least G statistic of a word that the content view keeps.
EVIDENCE = 12.0
SIGNS = np.zeros(256, bool)
SIGNS[[ord(c) for c in "#*$%&|<>!?@^~_=+{}[]\\/"]] = True
#: ASCII other than letters and digits, between the content view's words.
_BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
CONTENT = (
    "repeated", "upper_words", "capital_words", "sign_ends", "stop_ends", "word_length", "distinct",
    "log_bytes", "log_lines", "line_length", "upper", "digits", "signs", "other_script", "log_words",
)
META_HASH = 1024
#: Of the record: hashes of source, of language, of both, and of language and length; and the length's logarithm.
HASHED = ("h1", "h2", "h3", "h4")
RECORD = [*HASHED, "size"]


def text_features(data: np.ndarray, offsets: np.ndarray):
    """(bucket of each distinct word of each text, where each text's begin, content measures)."""
    part, at = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    n, size = len(at) - 1, np.maximum(np.diff(at), 1)
    starts, ends, first = tv.word_spans(part, offsets)
    h = tv.hash_words(part, starts, ends)
    count = np.diff(first)
    text = np.repeat(np.arange(n), count)
    one = np.maximum(count, 1)
    bare_starts, bare_ends, bare_first = tv.word_spans(part, offsets, _BETWEEN)
    bare = tv.hash_words(part, bare_starts, bare_ends)
    bare_text = np.repeat(np.arange(n), np.diff(bare_first))
    pair = np.unique((bare_text.astype(np.uint64) << np.uint64(BITS)) | (bare >> np.uint64(64 - BITS)))
    bucket, of = (pair & np.uint64((1 << BITS) - 1)).astype(np.int32), (pair >> np.uint64(BITS)).astype(np.int64)
    upper = (part >= 65) & (part <= 90)
    share = lambda flags: np.bincount(text, weights=flags, minlength=n) / one
    sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[at])
    ups = np.concatenate([[0], np.cumsum(upper)])
    lengths = ends - starts
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    last = part[ends - 1] if len(ends) else part[:0]
    lines = sums(part == 10) + 1
    letters = np.bincount(text, weights=lengths, minlength=n)
    distinct = np.bincount(of, minlength=n)
    content = np.stack(
        [share(again), share((lengths > 1) & (ups[ends] - ups[starts] >= 2)), share(upper[starts] if len(starts) else upper[:0]), share(SIGNS[last]), share((last == 46) | (last == 44)), letters / one / 10, distinct / np.sqrt(one) / 10], axis=1
    )
    made = np.stack([np.log1p(size) / 5, np.log1p(lines) / 3, np.log1p(size / lines) / 5, sums(upper) / size, sums((part >= 48) & (part <= 57)) / size, sums(SIGNS[part]) / size, sums(part >= 128) / size, np.log1p(count) / 5], axis=1)
    return bucket, np.searchsorted(of, np.arange(n + 1)), np.column_stack([content, made, made**2])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression, the intercept last and not penalised; Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w, s = np.zeros(x.shape[1]), np.ones(len(y)) if weight is None else weight
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x @ w)
        curve = np.maximum(s * p * (1 - p), 1e-9)
        step = np.linalg.solve((x * curve[:, None]).T @ x + np.diag(penalty), x.T @ (s * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Content:
    """Log-odds of the words with enough evidence, summed, beside the measures of how words are written."""

    def __init__(self, bucket, begin, content, y, weight):
        size, good = 1 << BITS, y > 0.5
        owner = np.repeat(np.arange(len(y)), np.diff(begin))
        a, b = (np.bincount(bucket, weights=np.where(keep, weight, 0)[owner], minlength=size) for keep in (good, ~good))
        na, nb = max(weight[good].sum(), 1), max(weight[~good].sum(), 1)
        share = (a + b) / (na + nb)
        with np.errstate(divide="ignore", invalid="ignore"):
            g = sum(2 * np.where(o > 0, o * np.log(o / e), 0) for o, e in ((a, na * share), (b, nb * share), (na - a, na * (1 - share)), (nb - b, nb * (1 - share))))
        odds = np.log((a + 0.5) / (na + 1)) - np.log((b + 0.5) / (nb + 1))
        self.words = np.where(np.nan_to_num(g) >= EVIDENCE, odds, 0).astype(np.float32)
        # A word's own document is left out of its odds while the weights are fitted, else rare words look surer than they are.
        mine = weight[owner]
        own = np.where(good[owner], np.log(np.maximum(a[bucket] + 0.5 - mine, 0.25) / na) - np.log((b[bucket] + 0.5) / (nb + 1)), np.log((a[bucket] + 0.5) / (na + 1)) - np.log(np.maximum(b[bucket] + 0.5 - mine, 0.25) / nb)) if len(bucket) else bucket
        own = np.where(self.words[bucket] != 0, own, 0)
        self.w = logistic(np.column_stack([self._split(own, begin), content]), y, weight)

    @staticmethod
    def _split(odds, begin):
        """Sums of odds for and against."""
        sums = lambda v: np.diff(np.concatenate([[0.0], np.cumsum(v)])[begin])
        return np.column_stack([np.log1p(sums(np.maximum(odds, 0))), np.log1p(sums(np.maximum(-odds, 0))), np.minimum(sums(np.minimum(odds, 0)), 0) / 5])

    def logit(self, bucket, begin, content):
        return np.column_stack([self._split(self.words[bucket], begin), content]) @ self.w[:-1] + self.w[-1]


class Meta:
    """Rates of the record's hashed values, and its length."""

    def __init__(self, size, hashed, y, weight):
        self.rates = np.zeros((hashed.shape[1], META_HASH))
        share = (y * weight).sum() / weight.sum()
        for row, column in zip(self.rates, hashed.T, strict=True):
            n, good = (np.bincount(column, weights=v, minlength=META_HASH) for v in (weight, y * weight))
            row += np.where(n > 0, np.log((good + 10 * share + 0.01) / (n - good + 10 * (1 - share) + 0.01)) - math.log((share + 0.001) / (1 - share + 0.001)), 0)
        self.w = logistic(self._rows(size, hashed), y, weight)

    def _rows(self, size, hashed):
        return np.column_stack([size, size**2, *(row[column] for row, column in zip(self.rates, hashed.T, strict=True))])

    def logit(self, size, hashed):
        return self._rows(size, hashed) @ self.w[:-1] + self.w[-1]


def _lists(x, t):
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], np.int32)), pa.array(x.ravel(), t))


_FEATURES = "doc_id long, th long, h1 int, h2 int, h3 int, h4 int, size double, bucket array<int>, content array<float>"


def _features(batches):
    for batch in batches:
        data, offsets = tv.bytes_of(batch.column("text"))
        for a, b in tv.chunks(offsets):
            bucket, begin, content = text_features(data, offsets[a : b + 1])
            words = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(bucket))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("doc_id", "th", *RECORD)), words, _lists(content, pa.float32())], ["doc_id", "th", *RECORD, "bucket", "content"])


class Sample:
    """Features of documents, from an Arrow table or batch."""

    def __init__(self, rows):
        column = lambda c: x.combine_chunks() if isinstance(x := rows.column(c), pa.ChunkedArray) else x
        words = column("bucket")
        self.begin = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        self.bucket = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.content = column("content").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows.num_rows, -1)
        self.hashed = np.column_stack([column(c).to_numpy(zero_copy_only=False) for c in HASHED]).astype(np.int64)
        self.size = column("size").to_numpy(zero_copy_only=False)

    def content_of(self, at: np.ndarray):
        sizes = np.diff(self.begin)[at]
        begin = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.bucket[np.repeat(self.begin[at] - begin[:-1], sizes) + np.arange(begin[-1])]
        return flat, begin, self.content[at]

    def meta_of(self, at: np.ndarray):
        return self.size[at], self.hashed[at]

    def logits(self, content: Content, meta: Meta):
        return content.logit(self.bucket, self.begin, self.content), meta.logit(self.size, self.hashed)


def held_out(y: np.ndarray) -> np.ndarray:
    """The labels for calibration: every fourth, in the order of a hash; none where either part would be of one kind."""
    held = np.arange(len(y)) % 4 == 3
    return held if len(set(y[held])) == 2 and len(set(y[~held])) == 2 else np.zeros(len(y), bool)


def skill(score: np.ndarray, y: np.ndarray) -> float:
    """Twice the area under the ROC curve, less one; LEAST_SKILL where that is less."""
    good, bad = np.sort(score[y > 0.5]), np.sort(score[y <= 0.5])
    less, ties = np.searchsorted(bad, good, "left").sum(), (np.searchsorted(bad, good, "right") - np.searchsorted(bad, good, "left")).sum()
    return max(LEAST_SKILL, float(2 * (less + ties / 2) / max(len(good) * len(bad), 1) - 1))


def fit_round(sample: Sample, y: np.ndarray, weight: np.ndarray, for_content: np.ndarray, for_meta: np.ndarray):
    """(content view, metadata view, their calibrations, combination, their skills). y and weight: labels of the sample's rows and what they weigh,
    at first those that are known, in the order of a hash; for_content and for_meta: is a row a pseudo-label of that view's set? If
    neither, it is known."""
    known = np.flatnonzero(~for_content & ~for_meta)
    held = held_out(y[known])
    fit, test = known[~held], known[held] if held.any() else known
    ours = np.concatenate([fit, np.flatnonzero(for_content)])
    theirs = np.concatenate([fit, np.flatnonzero(for_meta)])
    content, meta = Content(*sample.content_of(ours), y[ours], weight[ours]), Meta(*sample.meta_of(theirs), y[theirs], weight[theirs])
    one, two = content.logit(*sample.content_of(test)), meta.logit(*sample.meta_of(test))
    return content, meta, (logistic(one[:, None], y[test]), logistic(two[:, None], y[test])), logistic(np.column_stack([one, two]), y[test]), (skill(one, y[test]), skill(two, y[test]))


def _fit(batches):
    """The views of a round, pickled; null where the labels are of one kind. Rows come in order."""
    batches = list(batches)
    if not batches:
        return
    rows = pa.Table.from_batches(batches)
    y, weight, kind = (rows.column(c).to_numpy() for c in ("y", "weight", "kind"))
    fitted = pickle.dumps(fit_round(Sample(rows), y, weight, kind == 1, kind == 2)) if len(set(y[kind == 0])) == 2 else None
    yield pa.RecordBatch.from_arrays([pa.array([fitted], pa.binary())], ["model"])


def _calibrated(model):
    """doc_id, th and both views' calibrated probabilities of documents by their features."""

    def run(batches):
        content, meta, scales, *_ = model.value
        for batch in batches:
            p = [_sigmoid(x * s[0] + s[1]) for x, s in zip(Sample(batch).logits(content, meta), scales, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), *map(pa.array, p)], ["doc_id", "th", "by_content", "by_meta"])

    return run


def _scores(model, one: np.ndarray, two: np.ndarray):
    """(content view, metadata view, both) as probabilities."""
    _, _, (c, m), both, _ = model
    return _sigmoid(one * c[0] + c[1]), _sigmoid(two * m[0] + m[1]), _sigmoid(np.column_stack([one, two]) @ both[:-1] + both[-1])


def _score(model):
    def run(batches):
        content, meta, *_ = model.value
        for batch in batches:
            scores = _scores(model.value, *Sample(batch).logits(content, meta))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, scores)], ["doc_id", "content_score", "meta_score", "quality"])

    return run


def _good(model):
    @F.arrow_udf("double")
    def quality(text: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array, size: pa.Array) -> pa.Array:
        content, meta, *_ = model.value
        out = [np.zeros(0)]
        data, offsets = tv.bytes_of(text)
        hashed = np.column_stack([x.to_numpy(zero_copy_only=False) for x in (h1, h2, h3, h4)])
        length = size.to_numpy(zero_copy_only=False)
        for a, b in tv.chunks(offsets):
            out.append(_scores(model.value, content.logit(*text_features(data, offsets[a : b + 1])), meta.logit(length[a:b], hashed[a:b]))[2])
        return pa.array(np.concatenate(out))

    return quality


def _record(docs: DataFrame, source_col: str, lang_col: str, chars_col: str) -> dict:
    """The record's features, by name; a column that is not there is null."""
    have = lambda c, t: F.col(c).cast(t) if c in docs.columns else F.lit(None).cast(t)
    source, lang, chars = have(source_col, "string"), have(lang_col, "string"), have(chars_col, "long")
    step = F.coalesce(F.floor(F.log2(F.greatest(chars, F.lit(0)) + 1) * 2).cast("string"), F.lit("\0null"))
    text = lambda c: F.coalesce(c, F.lit("\0null"))
    of = lambda name, *parts: F.pmod(F.xxhash64(F.lit(name), *parts), F.lit(META_HASH)).cast("int")
    return {"h1": of("source", text(source)), "h2": of("lang", text(lang)), "h3": of("both", text(source), text(lang)), "h4": of("length", text(lang), step), "size": F.coalesce(F.log1p(F.greatest(chars, F.lit(0)).cast("double")) / 5, F.lit(0.0))}


def _fitted(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str, text_col: str, columns: tuple, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS):
    """(the model or None, the share of good labels, the features of all documents, the labels that were fitted to)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    record = _record(docs, *columns)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"), *[c.alias(k) for k, c in record.items()])
    known = labels.where(F.col("doc_id").isNotNull() & F.coalesce("quality", "toxic").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.coalesce(F.min("quality"), F.lit(1)).eqNullSafe(1) & (F.coalesce(F.max("toxic"), F.lit(0)) != 1)).cast("double").alias("y"))
    known = scratch.save(known, "known")
    share = known.agg(F.avg("y")).first()[0]
    share = 1.0 if share is None else float(share)
    features = scratch.save(source.mapInArrow(_features, _FEATURES), "features")
    keys = features.select("doc_id", "th").where("doc_id is not null")
    by_hash = F.xxhash64("doc_id", "th"), F.col("doc_id"), F.col("th")
    # Bounded: max_labelled rows and, in each round, a tenth of them for each view and label.
    chosen = scratch.save(keys.join(known, "doc_id").distinct().orderBy(*by_hash).limit(max_labelled).select("doc_id", "th", "y", F.lit(1.0).alias("weight"), F.lit(0).alias("kind"), F.lit(0).alias("turn")), "chosen")
    n = chosen.count()
    limit = (n - n // 4) // 10 + 1  # of each kind in a round, so that pseudo-labels stay a minority
    model = None
    for turn in range(rounds + 1):
        unique = features.join(F.broadcast(chosen), ["doc_id", "th"]).dropDuplicates(["doc_id", "th", "kind", *RECORD])
        fitted = unique.repartition(1).sortWithinPartitions(*by_hash, "kind", *RECORD).mapInArrow(_fit, "model binary").first()
        model = pickle.loads(fitted[0]) if fitted and fitted[0] else None
        if model is None or turn == rounds:
            break
        held = docs.sparkSession.sparkContext.broadcast(model)
        pool = features.where("doc_id is not null").mapInArrow(_calibrated(held), "doc_id long, th long, by_content double, by_meta double")
        pool = scratch.save(pool.join(known, "doc_id", "left_anti").distinct(), f"pool-{turn}")
        parts = [chosen]
        for kind, p, able in ((2, "by_content", model[4][0]), (1, "by_meta", model[4][1])):  # a view's surest documents are the other's pseudo-labels
            fresh = pool.join(F.broadcast(chosen.where(F.col("kind") == kind).select("doc_id", "th")), ["doc_id", "th"], "left_anti")
            for y, told, base in ((1.0, F.col(p), share), (0.0, 1 - F.col(p), 1 - share)):
                weight = (told - base) / (1 - base) * able
                parts.append(fresh.where(weight > 0).orderBy(told.desc(), *by_hash).limit(limit).select("doc_id", "th", F.lit(y).alias("y"), weight.alias("weight"), F.lit(kind).alias("kind"), F.lit(turn + 1).alias("turn")))
        chosen = scratch.save(reduce(DataFrame.union, parts), f"chosen-{turn}")
        scratch.drop(f"pool-{turn}")
    return model, share, features, chosen


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", threshold: float = 0.5, **options) -> DataFrame:
    """doc_id, content_score, meta_score, quality (0 to 1), kept (quality is threshold or more). options: max_labelled, rounds."""
    scratch = Scratch(docs.sparkSession, "cotraining")
    model, share, features, _ = _fitted(docs, labels, scratch, id_col, text_col, (source_col, lang_col, chars_col), **options)
    if model is None:
        p = F.lit(share)
        return features.select("doc_id", p.alias("content_score"), p.alias("meta_score"), p.alias("quality"), (p >= threshold).alias("kept"))
    scored = features.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, content_score double, meta_score double, quality double")
    return scored.withColumn("kept", F.col("quality") >= threshold)


def pseudo_labels(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", **options) -> DataFrame:
    """doc_id, view ('content' or 'metadata', which was given the label), turn (from 1), good, weight: what the views handed over."""
    chosen = _fitted(docs, labels, Scratch(docs.sparkSession, "cotraining"), id_col, text_col, (source_col, lang_col, chars_col), **options)[3]
    return chosen.where("kind > 0").select("doc_id", F.when(F.col("kind") == 1, "content").otherwise("metadata").alias("view"), "turn", (F.col("y") == 1).alias("good"), "weight")


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", threshold: float = 0.5, **options) -> DataFrame:
    """The documents, all columns, that the classifier keeps. They are scored where they stand and not joined to a list."""
    scratch = Scratch(docs.sparkSession, "cotraining")
    model, share, _, _ = _fitted(docs, labels, scratch, id_col, text_col, (source_col, lang_col, chars_col), **options)
    scratch.drop("features")
    if model is None:
        return docs if share >= threshold else docs.limit(0)
    good = _good(docs.sparkSession.sparkContext.broadcast(model))
    record = _record(docs, source_col, lang_col, chars_col)
    return docs.where(good(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), *[record[k] for k in RECORD]) >= threshold)
