"""A semantic cache as state of a stream: entries with a time to live, a bounded number of them, first in first out.

The state of a scope (a tenant, a collection) is a list of entries in the order in which they came. A request looks for the likest
living entry; where it is like enough that is a hit, else the request becomes an entry, and beyond `most` entries the oldest goes.
An invalidation empties its scope. A timer at the end of the newest entry's life clears a scope that is asked no more, so state goes
when its keys go. Requests of a batch are taken in order of time and id, so a stream gives the same hits as a replay by hand, however
its files are cut into batches, as long as later batches are later.

State is in Spark's RocksDB store: checkpointed in the shared folder, spilled to disk, restored with its partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ENTRY = "request_id long, at long, embedding array<double>"
HITS = "scope string, request_id long, hit_id long, score double"


class SemanticCache(StatefulProcessor):
    """Requests: scope, request_id, ts, embedding, and invalidate (true: empty the scope)."""

    def __init__(self, least: float = 0.92, ttl_ms: int = 24 * 3_600_000, most: int = 512, digits: int = 6):
        self.least, self.ttl_ms, self.most, self.digits = least, ttl_ms, most, digits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getListState("entries", ENTRY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [(int(r[0]), int(r[1]), np.asarray(r[2], float)) for r in self.entries.get()] if self.entries.exists() else []
        out = []
        batch = pd.concat(list(rows)).sort_values(["ts", "request_id"], kind="stable")
        for request, ts, vector, invalidate in zip(batch["request_id"], batch["ts"], batch["embedding"], batch["invalidate"], strict=True):
            at = int(pd.Timestamp(ts).value // 1_000_000)
            if invalidate:
                held = []
                continue
            held = [e for e in held if at - e[1] <= self.ttl_ms]
            found = self.likest(held, np.asarray(vector, float))
            out.append((key[0], int(request), *found))
            if found[0] is None:
                held = [*held, (int(request), at, np.asarray(vector, float))][-self.most :]
        self._keep(held)
        yield pd.DataFrame({"scope": [o[0] for o in out], "request_id": [o[1] for o in out], "hit_id": pd.array([o[2] for o in out], "Int64"), "score": pd.array([o[3] for o in out], "Float64")})

    def likest(self, held: list, vector: np.ndarray) -> tuple[int | None, float | None]:
        best = (None, None)
        for request, _, known in held:
            size = float(np.sqrt((vector * vector).sum()) * np.sqrt((known * known).sum())) if len(known) == len(vector) else 0.0
            score = round(float((vector * known).sum()) / size, self.digits) if size else 0.0
            if score >= self.least and (best[0] is None or score > best[1]):
                best = (request, score)
        return best

    def _keep(self, held: list) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held:
            self.entries.put([(r, a, [float(x) for x in v]) for r, a, v in held])
            self.handle.registerTimer(max(a for _, a, _ in held) + self.ttl_ms + 1)
        else:
            self.entries.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The newest entry's life is over."""
        self.entries.clear()
        yield pd.DataFrame({"scope": pd.Series([], dtype="str"), "request_id": pd.Series([], dtype="int64"), "hit_id": pd.array([], "Int64"), "score": pd.array([], "Float64")})

    def close(self) -> None:
        pass


def cached_requests(requests: DataFrame, *, late: str = "0 seconds", **options) -> DataFrame:
    """scope, request_id, hit_id, score (null: the request was not answered by the cache). options: of SemanticCache."""
    schema = StructType.fromDDL(HITS)
    timed = requests.withWatermark("ts", late)
    return timed.groupBy("scope").transformWithStateInPandas(SemanticCache(**options), schema, "append", "eventTime")


def use_state_store(spark: SparkSession) -> str:
    """The store that list state and timers need; returns the provider that was set before, for the caller to set back."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return before
