"""Approximate vector search: an index of coarse lists, kept as tables.

Centroids are trained on a sample of SAMPLE vectors at most, by order of a hash of the id; every vector of the table is dealt to the
list of its nearest centroid. A list is rows of up to CHUNK_BYTES of vectors, in order of list and id over all files, so that a list
with a third of all vectors is many rows in many files. A query is sent to the lists of its nearest centroids, and meets their rows
in a join on the list; scores are exact, only which vectors are looked at is not. `knn` stays the exact way, and `recall` measures
one against the other.

Defined cases: vectors that are zero, hold a null or have another length than the first of the sample belong to lists by their ids;
their score is 0, as in exact search; null ids and null vectors are left out; an empty table has one empty list.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..scratch import Scratch, kept, small_batches
from .vectors import BLOCK, CHUNK_BYTES, SCORED, _rows, _scored, nearest, top_k

#: Vectors that centroids are fitted to; most centroids; rounds of fitting.
SAMPLE, MOST_LISTS, ROUNDS = 20_000, 4096, 8
_BLOCKS = "list int, dim int, ids binary, vectors binary"


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _train(lists: int):
    """Centroids on the unit sphere, from vectors in order; the first ones are spread by distance."""

    def run(batches):
        dim, parts = None, []
        for batch in batches:
            sizes = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            if dim is None and (sizes > 0).any():
                dim = int(sizes[sizes > 0][0])
            if dim:
                part = batch.filter(pa.array(sizes == dim))
                parts.append(_unit(_rows(part.column("embedding"), dim)))
        x = np.concatenate(parts) if parts else np.zeros((0, 1))
        x = x[(x != 0).any(axis=1)]
        if not len(x):
            return
        rng = np.random.default_rng(12)
        centres = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
        for _ in range(ROUNDS):
            near = np.concatenate([(x[a : a + 4096] @ centres.T).argmax(axis=1) for a in range(0, len(x), 4096)])
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x)
            empty = ~(sums != 0).any(axis=1)
            sums[empty] = x[rng.choice(len(x), empty.sum())]
            centres = _unit(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centres)), pa.int32()), pa.array(list(centres), pa.list_(pa.float64()))], ["list", "embedding"])

    return run


def _assign(centres, probes: int):
    """id, list, embedding: each vector beside its `probes` nearest lists."""

    def run(batches):
        c = centres.value
        for batch in batches:
            dims = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            n = min(probes, len(c))
            lists = (ids[:, None] + np.arange(n)) % len(c)
            fits = np.flatnonzero(dims == c.shape[1])
            x = _rows(batch.column("embedding").take(pa.array(fits)), c.shape[1])
            likeness = _unit(x) @ c.T
            best = np.argsort(-likeness, axis=1, kind="stable")[:, :n]
            told = (x != 0).any(axis=1)
            lists[fits[told]] = best[told]
            at = pa.array(np.repeat(np.arange(len(ids)), n))
            yield pa.RecordBatch.from_arrays([pa.array(ids).take(at), pa.array(lists.ravel(), pa.int32()), batch.column("embedding").take(at)], ["id", "list", "embedding"])

    return run


def _pack(limit: int | None):
    """Vectors in order of list, to rows of one list and length. limit: vectors in a row, else CHUNK_BYTES."""
    schema = pa.schema([("list", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])

    def run(batches):
        for batch in batches:
            dims = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            lists = batch.column("list").to_numpy(zero_copy_only=False).astype(np.int64)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            order = np.lexsort((ids, dims, lists))
            cut = np.flatnonzero(np.diff(lists[order]) | np.diff(dims[order])) + 1
            for at in np.split(order, cut) if len(order) else []:
                dim = int(dims[at[0]])
                x = _rows(batch.column("embedding").take(pa.array(at)), dim) if dim else np.zeros((len(at), 0))
                size = limit or max(1, CHUNK_BYTES // (8 * max(dim, 1)))
                for a in range(0, len(at), size):
                    b = slice(a, a + size)
                    yield pa.RecordBatch.from_pydict({"list": [int(lists[at[0]])], "dim": [dim], "ids": [ids[at[b]].tobytes()], "vectors": [x[b].tobytes()]}, schema=schema)

    return run


@dataclass(frozen=True)
class VectorIndex:
    """centroids: list, embedding (MOST_LISTS rows at most); blocks: the lists' vectors."""

    centroids: DataFrame
    blocks: DataFrame

    @classmethod
    def build(cls, vectors: DataFrame, *, lists: int | None = None, path: str | None = None) -> VectorIndex:
        """vectors: id (whole numbers), embedding. lists: by default the root of the vectors' number. path: a folder that keeps the
        index for open(); else it lives as long as the session."""
        spark = vectors.sparkSession
        scratch = Scratch(spark, "vector-index")
        rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).where("id is not null and embedding is not null")
        lists = min(MOST_LISTS, lists or max(1, math.isqrt(rows.count())))
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
        save = (lambda df, name: kept(df, f"{path}/{name}")) if path else scratch.save
        centroids = save(sample.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id").mapInArrow(_train(lists), "list int, embedding array<double>"), "centroids")
        dealt = scratch.save(rows.mapInArrow(_assign(cls._sent(centroids), 1), "id long, list int, embedding array<double>"), "dealt")
        packed = dealt.repartitionByRange("list", "id").sortWithinPartitions("list", "id").mapInArrow(_pack(None), _BLOCKS)
        index = cls(centroids, save(packed, "blocks"))
        scratch.drop("dealt")
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        return cls(spark.read.parquet(f"{path}/centroids"), spark.read.parquet(f"{path}/blocks"))

    @staticmethod
    def _sent(centroids: DataFrame):
        """The centroids in every worker: MOST_LISTS vectors at most."""
        rows = centroids.orderBy("list").collect()
        return centroids.sparkSession.sparkContext.broadcast(np.array([r["embedding"] for r in rows]) if rows else np.zeros((1, 1)))

    def nearest(self, queries: DataFrame, k: int, *, probes: int, digits: int = 6) -> DataFrame:
        """query_id, id, score: of each task the best k of each query among the vectors of its `probes` nearest lists."""
        asked = queries.select(F.col("query_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).where("id is not null and embedding is not null")
        scratch = Scratch(queries.sparkSession, "vector-index")
        sent = scratch.save(asked.mapInArrow(_assign(self._sent(self.centroids), probes), "id long, list int, embedding array<double>"), "asked")
        packed = scratch.save(sent.repartitionByRange("list", "id").sortWithinPartitions("list", "id").mapInArrow(_pack(BLOCK), _BLOCKS), "packed")
        packed = packed.select("list", *[F.col(c).alias(f"q{c}") for c in ("dim", "ids", "vectors")])
        none = F.lit(None).cast("binary")
        pairs = self.blocks.join(packed, "list").select("dim", "ids", none.alias("times"), "vectors", "qdim", "qids", none.alias("qtimes"), "qvectors")
        with small_batches(queries.sparkSession):
            return scratch.save(pairs.mapInArrow(_scored(k, None, digits, None), SCORED), "scored")


    def probes_for(self, vectors: DataFrame, queries: DataFrame, k: int, *, target: float = 0.95, sample: int = 200) -> int:
        """The least number of lists a query must be sent to for a recall of target, measured on `sample` queries at most, by order
        of a hash: their exact neighbours are found once, and each neighbour's list is looked up in the query's order of lists."""
        tried = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(sample)
        whole, centres = self.centroids.count(), self._sent(self.centroids)
        near = top_k(nearest(vectors, tried, k), k).select("query_id", "id")
        kind = "id long, list int, embedding array<double>"
        cast = F.col("embedding").cast("array<double>").alias("embedding")
        mine = vectors.join(near.select("id").distinct(), "id").select(F.col("id").cast("long").alias("id"), cast).mapInArrow(_assign(centres, 1), kind).select("id", F.array("list").alias("own"))
        order = tried.select(F.col("query_id").cast("long").alias("id"), cast).mapInArrow(_assign(centres, whole), kind).groupBy("id").agg(F.collect_list("list").alias("lists"))
        places = near.join(mine, "id").join(order.withColumnRenamed("id", "query_id"), "query_id").select(F.array_position("lists", F.get("own", F.lit(0))).alias("place"))
        found = sorted((r["place"], r["count"]) for r in places.groupBy("place").count().collect())  # a row for each list at most
        need, got = target * sum(n for _, n in found), 0
        for place, n in found:
            got += n
            if got >= need:
                return max(1, int(place))
        return 1


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, wanted, found: how many of the exact rows (query_id, id) were found."""
    hits = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found"))
