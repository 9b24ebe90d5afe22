"""Exact vector search over bytes in two phases.

Vectors are coded as a byte for each number: all numbers times one scale, by which the quantile of absolute values is 127, cut off
there. Beside the bytes stand two numbers for each vector: the factor that makes the code a unit vector's likeness, and how far that
is from the unit vector. With them a product of codes bounds the cosine: |cos - product| <= e_q + |d_q| * e_v. The first phase
multiplies codes, an eighth of the bytes of vectors, and keeps what the bounds cannot rule out: all whose upper bound reaches the
k-th best lower bound. The second scores these exactly. So the rows are those of exact search, whatever the data; loose bounds cost
time only.

Defined cases: as in exact search the score is 0 where either vector is zero, holds a null or has another length; such pairs' bounds
are 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..scratch import Scratch, small_batches
from .quantiles import exact_quantile
from .vectors import BLOCK, CHUNK_BYTES, _rows, top_k

#: Over what rounding to digits and floating point can move a score.
SLACK = 2e-6
#: Pairs whose bounds a task works out at once, and those that it holds.
CELLS = 1 << 20
HELD = 1 << 22
_CODED = "dim int, ids binary, codes binary, factors binary, errors binary"


def scale_of(vectors: DataFrame, quantile: float = 0.99) -> float:
    """By what numbers are multiplied: 127 by the exact quantile of their absolute values."""
    bound = exact_quantile(vectors.select(F.explode("embedding").alias("x")), F.abs("x"), quantile)
    return 127.0 / bound if bound else 127.0


def coded(c: Column, scale: float) -> Column:
    """A vector's bytes."""
    return F.transform(c, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") * F.lit(scale)))).cast("tinyint"))


def _pack(scale: float, limit: int | None):
    def run(batches):
        for batch in batches:
            dims = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                ids = part.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
                x = _rows(part.column("embedding"), int(dim)) if dim else np.zeros((len(ids), 0))
                size = np.sqrt((x * x).sum(axis=1))
                code = np.clip(np.round(x * scale), -127, 127).astype(np.int8)
                factor = np.divide(1.0, scale * size, out=np.zeros(len(x)), where=size > 0)
                unit = np.divide(x, size[:, None], out=np.zeros_like(x), where=size[:, None] > 0)
                error = np.sqrt(((unit - code * factor[:, None]) ** 2).sum(axis=1))
                most = limit or max(1, CHUNK_BYTES // max(int(dim), 1))
                for a in range(0, len(ids), most):
                    b = slice(a, a + most)
                    yield pa.RecordBatch.from_pydict(
                        {"dim": pa.array([int(dim)], pa.int32()), "ids": [ids[b].tobytes()], "codes": [code[b].tobytes()], "factors": [factor[b].tobytes()], "errors": [error[b].tobytes()]},
                        schema=pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("codes", pa.binary()), ("factors", pa.binary()), ("errors", pa.binary())]),
                    )

    return run


def _bounds(qdim, qcodes, qfactors, qerrors, dim, codes, factors, errors):
    """(lower, upper) bounds of all pairs' cosines. Products of bytes are whole numbers that a double holds exactly."""
    q, v = (np.frombuffer(c, np.int8).reshape(len(f), -1).astype(np.float64) for c, f in ((qcodes, qfactors), (codes, factors)))
    if dim != qdim or not dim:
        zero = np.zeros((len(qfactors), len(factors)))
        return zero, zero
    about = (q @ v.T) * qfactors[:, None] * factors[None, :]
    length = np.sqrt((q * q).sum(axis=1)) * qfactors
    off = qerrors[:, None] + length[:, None] * errors[None, :]
    none = (qfactors == 0)[:, None] | (factors == 0)[None, :]
    off = np.where(none, 0.0, off)
    return about - off, about + off


def _ruled_in(k: int):
    """What a task cannot rule out: query_id, id, lower, upper."""

    def run(batches):
        held: dict[bytes, tuple] = {}
        floors: dict[bytes, np.ndarray] = {}  # of each query the best k-th lower bound so far, of rows that have been given on too

        def kept(floor, query, ids, low, high):
            order = np.lexsort((-low, query))
            query, ids, low, high = query[order], ids[order], low[order], high[order]
            first, last = (np.searchsorted(query, np.arange(len(floor)), side=s) for s in ("left", "right"))
            many = last - first >= k
            floor[many] = np.maximum(floor[many], low[first[many] + k - 1])
            keep = high >= floor[query] - SLACK
            return query[keep], ids[keep], low[keep], high[keep]

        def rows():
            for asked, (query, ids, low, high) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(asked, np.int64)[query]), pa.array(ids), pa.array(low), pa.array(high)], ["query_id", "id", "low", "high"])
            held.clear()

        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                ids = np.frombuffer(row["ids"], np.int64)
                floats = {c: np.frombuffer(row[c]) for c in ("factors", "errors", "qfactors", "qerrors")}
                found = [held[row["qids"]]] if row["qids"] in held else []
                floor = floors.setdefault(row["qids"], np.full(len(floats["qfactors"]), -np.inf))
                few = max(1, CELLS // len(ids))
                for a in range(0, len(floats["qfactors"]), few):  # a chunk holds many codes: some queries at a time
                    b = slice(a, a + few)
                    low, high = _bounds(row["qdim"], row["qcodes"][a * row["qdim"] : (a + few) * row["qdim"]], floats["qfactors"][b], floats["qerrors"][b], row["dim"], row["codes"], floats["factors"], floats["errors"])
                    least = np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k, None] if len(ids) > k else -np.inf
                    query, column = np.nonzero(high >= np.maximum(least, floor[b, None]) - SLACK)
                    found.append((query + a, ids[column], low[query, column], high[query, column]))
                held[row["qids"]] = kept(floor, *map(np.concatenate, zip(*found, strict=True)))
                if sum(len(x[0]) for x in held.values()) > HELD:
                    yield from rows()
        yield from rows()

    return run


def candidates(vectors: DataFrame, queries: DataFrame, k: int, *, quantile: float = 0.99) -> DataFrame:
    """query_id, id, low, high: the pairs that the bounds leave. Both sides are written packed, and the packed vectors are read once
    for each block of BLOCK queries that Spark deals out."""
    scratch = Scratch(vectors.sparkSession, "vector-codes")
    scale = scale_of(vectors, quantile)
    clean = lambda df, c: df.select(F.col(c).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).where("id is not null and embedding is not null")
    codes = scratch.save(clean(vectors, "id").mapInArrow(_pack(scale, None), _CODED), "codes")
    asked = scratch.save(clean(queries, "query_id").mapInArrow(_pack(scale, BLOCK), _CODED), "asked").select(*[F.col(c).alias(f"q{c}") for c in ("dim", "ids", "codes", "factors", "errors")])
    left = codes.crossJoin(asked).mapInArrow(_ruled_in(k), "query_id long, id long, low double, high double")
    best = W.partitionBy("query_id").orderBy(F.desc("low"), "id")
    with small_batches(vectors.sparkSession):
        left = scratch.save(left, "left")
    ranked = left.withColumn("place", F.row_number().over(best))
    least = ranked.where(F.col("place") == k).select("query_id", F.col("low").alias("least"))
    return ranked.join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("high") >= F.col("least") - SLACK)).select("query_id", "id", "low", "high")


def knn_by_codes(vectors: DataFrame, queries: DataFrame, k: int, *, quantile: float = 0.99, digits: int = 6) -> DataFrame:
    """query_id, id, score, rank: the rows of exact search. vectors: id, embedding; queries: query_id, embedding, with an id each."""
    pairs = candidates(vectors, queries, k, quantile=quantile).select("query_id", "id")
    asked = queries.select("query_id", F.col("embedding").alias("_q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(dot(F.col("_q"), F.col("_q"))) * F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    score = F.when((F.size("_q") == F.size("embedding")) & (size > 0), dot(F.col("_q"), F.col("embedding")) / size).otherwise(0.0)
    scored = pairs.join(vectors.select("id", "embedding"), "id").join(asked, "query_id").select("query_id", "id", F.round(score, digits).alias("score"))
    return top_k(scored, k)
