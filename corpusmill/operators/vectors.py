"""Exact vector search as products of blocks.

Vectors are packed into rows of up to CHUNK_BYTES, queries into rows of up to BLOCK. A task multiplies the blocks it meets and
holds the best k of each query it has seen, so what leaves a task is k rows a query at most, whatever the number of vectors. Both
sides are packed and written once; queries are a stated set that meets all rows: the product of a few wide rows. They reach a task a
few at a time, and it works out CELLS of their pairs at once, so what it holds beside the best does not grow with their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..scratch import Scratch, small_batches

CHUNK_BYTES = 1 << 20
BLOCK = 1024
#: Pairs that a task scores at once.
CELLS = 1 << 18
#: Queries whose best rows a task holds at once.
HELD = 1 << 16
#: Queries of a block whose pairs above a floor are held at once.
REACHED = 128
SCORED = "query_id long, id long, score double"
_PACKED = "dim int, ids binary, times binary, first long, last long, vectors binary"


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    """A matrix of the vectors of an Arrow column, all of length dim; vectors with a null in them are zero."""
    flat = column.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)
    x[np.isnan(x).any(axis=1)] = 0
    return x


def _pack(limit: int | None):
    """Vectors of one length in rows. limit: vectors in a row, else CHUNK_BYTES."""

    def run(batches):
        for batch in batches:
            dims = batch.column("embedding").value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                ids = part.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
                times = part.column("at").to_numpy(zero_copy_only=False).astype(np.int64)
                x = _rows(part.column("embedding"), int(dim)) if dim > 0 else np.zeros((len(ids), 0))
                order = np.lexsort((ids, times))
                size = limit or max(1, CHUNK_BYTES // (8 * max(int(dim), 1)))
                for a in range(0, len(order), size):
                    at = order[a : a + size]
                    at = at[np.argsort(ids[at], kind="stable")]
                    yield pa.RecordBatch.from_pydict(
                        {"dim": pa.array([int(dim)], pa.int32()), "ids": [ids[at].tobytes()], "times": [times[at].tobytes()], "first": [int(times[at].min())], "last": [int(times[at].max())], "vectors": [x[at].tobytes()]},
                        schema=pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("times", pa.binary()), ("first", pa.int64()), ("last", pa.int64()), ("vectors", pa.binary())]),
                    )

    return run


def packed(vectors: DataFrame, at: Column | None = None, limit: int | None = None) -> DataFrame:
    """vectors: id, embedding. at: a time in microseconds, by which vectors are dealt out, so that a row spans little time."""
    rows = vectors.select(F.col("id").cast("long").alias("id"), (F.lit(0) if at is None else at).cast("long").alias("at"), "embedding").where("id is not null and at is not null")
    return (rows if at is None else rows.repartitionByRange("at", "id")).mapInArrow(_pack(limit), _PACKED)


def _numbered(blocks: DataFrame) -> DataFrame:
    """Packed rows with a number each, to be saved with them: vectors are wide, so rows meet by their numbers first."""
    return blocks.withColumn("block", F.monotonically_increasing_id())


def _cosines(q: np.ndarray, v: np.ndarray, digits: int | None) -> np.ndarray:
    """0 where either vector is 0. digits: rounded to so many, or None."""
    size = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((v * v).sum(axis=1))[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        s = np.where(size > 0, (q @ v.T) / size, 0.0)
    return s if digits is None else np.round(s, digits)


def _best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int):
    """The best k of each query by score, then id."""
    order = np.lexsort((ids, -score, query))
    query, score, ids = query[order], score[order], ids[order]
    first = np.searchsorted(query, query)
    keep = np.arange(len(query)) - first < k
    return query[keep], score[keep], ids[keep]


def _scored(k: int, floor: float | None, digits: int, span: int | None):
    def run(batches):
        held: dict[bytes, tuple] = {}

        def rows():
            for ids, (query, score, hit) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64)[query]), pa.array(hit), pa.array(score)], ["query_id", "id", "score"])
            held.clear()

        for batch in batches:
            for r in range(batch.num_rows):
                x = {c: batch.column(c)[r].as_py() for c in ("dim", "ids", "times", "vectors", "qdim", "qids", "qtimes", "qvectors")}
                ids, asked = np.frombuffer(x["ids"], np.int64), np.frombuffer(x["qids"], np.int64)
                alike = x["dim"] == x["qdim"] and x["dim"] > 0
                if alike:
                    q, v = np.frombuffer(x["qvectors"]).reshape(len(asked), -1), np.frombuffer(x["vectors"]).reshape(len(ids), -1)
                parts, few = [], max(1, CELLS // len(ids))
                for a in range(0, len(asked), few):  # short vectors are many in a row: some queries at a time
                    b = slice(a, a + few)
                    s = _cosines(q[b], v, digits) if alike else np.zeros((len(asked[b]), len(ids)))
                    fits = np.ones(s.shape, bool) if floor is None else s >= floor
                    if span is not None:
                        age = np.frombuffer(x["qtimes"], np.int64)[b, None] - np.frombuffer(x["times"], np.int64)[None, :]
                        fits &= (age > 0) & (age <= span)
                    s = np.where(fits, s, -np.inf)
                    least = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k, None] if len(ids) > k else -np.inf
                    query, column = np.nonzero((s >= least) & fits)
                    parts.append(_best(query + a, s[query, column], ids[column], k))
                found = tuple(np.concatenate(p) for p in zip(*parts, strict=True))
                if not len(found[0]) and x["qids"] not in held:
                    continue
                if x["qids"] in held:
                    found = tuple(np.concatenate(p) for p in zip(held[x["qids"]], found, strict=True))
                held[x["qids"]] = _best(*found, k)
            if sum(len(ids) // 8 for ids in held) > HELD:
                yield from rows()
        yield from rows()

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int, *, floor: float | None = None, digits: int = 6, at: Column | None = None, query_at: Column | None = None, span: int | None = None) -> DataFrame:
    """query_id, id, score: of each task the best k of each query; rank them for the best k of all. vectors: id, embedding;
    queries: query_id, embedding, with an id each of its own. span: only what is older than the query (by at and query_at) by up
    to span microseconds. Cosine is 0 where either vector is 0, null, or of another length."""
    scratch = Scratch(vectors.sparkSession, "vectors")
    with small_batches(vectors.sparkSession):
        asked = scratch.save(_numbered(packed(queries.withColumn("id", F.col("query_id")), query_at, BLOCK)), "asked")
        asked = asked.select(*[F.col(c).alias(f"q{c}") for c in ("block", "dim", "ids", "times", "first", "last", "vectors")])
        rows = scratch.save(_numbered(packed(vectors, at)), "rows")
        if span is None:
            pairs = rows.crossJoin(asked)
        else:  # rows are in order of time and span little of it: their numbers meet by slices of time, and each pair in the first that both have
            slices = lambda first, last: F.explode(F.sequence(F.floor(F.col(first) / span), F.floor(F.col(last) / span)))
            when = rows.select("block", "first", "last").withColumn("slice", slices("first", "last"))
            qwhen = asked.select("qblock", "qfirst", "qlast").withColumn("qearliest", F.col("qfirst") - span).withColumn("slice", slices("qearliest", "qlast"))
            once = F.col("slice") == F.greatest(F.floor(F.col("first") / span), F.floor(F.col("qearliest") / span))
            near = when.join(qwhen, "slice").where(once & (F.col("first") < F.col("qlast")) & (F.col("last") >= F.col("qearliest"))).select("block", "qblock")
            pairs = scratch.save(near, "near").join(rows, "block").join(asked, "qblock")
        scored = pairs.select("dim", "ids", "times", "vectors", "qdim", "qids", "qtimes", "qvectors").mapInArrow(_scored(k, floor, digits, span), SCORED)
        return scratch.save(scored, "scored")


def _reaching(floor: float):
    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                x = {c: batch.column(c)[r].as_py() for c in ("dim", "ids", "vectors", "qdim", "qids", "qvectors")}
                ids, asked = np.frombuffer(x["ids"], np.int64), np.frombuffer(x["qids"], np.int64)
                if x["dim"] != x["qdim"] or x["dim"] <= 0:
                    continue
                q, v = np.frombuffer(x["qvectors"]).reshape(len(asked), -1), np.frombuffer(x["vectors"]).reshape(len(ids), -1)
                for a in range(0, len(asked), REACHED):  # all pairs of two blocks may be like enough
                    s = _cosines(q[a : a + REACHED], v, None)
                    query, column = np.nonzero(s >= floor)
                    yield pa.RecordBatch.from_arrays([pa.array(asked[a : a + REACHED][query]), pa.array(ids[column]), pa.array(s[query, column])], ["query_id", "id", "cosine"])

    return run


def reaching(vectors: DataFrame, queries: DataFrame, floor: float) -> DataFrame:
    """query_id, id, cosine: all pairs of floor (above 0) or more, not rounded. vectors: id, embedding; queries: query_id, embedding.
    A task holds the pairs of one product of blocks; vectors that are zero, null or of another length are like nothing."""
    if floor <= 0:
        raise ValueError("a floor is above 0")
    scratch = Scratch(vectors.sparkSession, "vectors")
    asked = scratch.save(packed(queries.withColumn("id", F.col("query_id")), limit=BLOCK), "asked")
    asked = asked.select(*[F.col(c).alias(f"q{c}") for c in ("dim", "ids", "vectors")])
    rows = scratch.save(packed(vectors), "rows").select("dim", "ids", "vectors")
    return rows.crossJoin(asked).mapInArrow(_reaching(floor), "query_id long, id long, cosine double")


def top_k(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(*(order or (F.desc("score"), F.col("id"))))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
