"""Models and services behind small interfaces, with deterministic stand-ins that need no network.

A Spark job takes any object with the method; batches go through it with retries, and a batch that fails is halved until single
items fail, so one bad item costs itself alone."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Signed sums of hashed words, of unit length; equal texts have equal vectors everywhere."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.size))
        for row, text in zip(out, texts, strict=True):
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.size] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).tolist()


def with_retries(call: Callable[[list], list], items: list, tries: int = 3, wait: float = 0.5) -> list:
    """The call's results for items; None for those that fail alone after all tries."""
    for attempt in range(tries):
        try:
            return call(items)
        except Exception:
            if attempt + 1 < tries:
                time.sleep(wait * 2**attempt)
    if len(items) == 1:
        return [None]
    half = len(items) // 2
    return with_retries(call, items[:half], tries, wait) + with_retries(call, items[half:], tries, wait)


def embedded(chunks: DataFrame, embedder: Embedder, *, id_col: str = "id", text_col: str = "text", batch: int = 100, chars: int = 12_000) -> DataFrame:
    """id, embedding; texts are cut to the model's limit of characters, which is the model's, not the corpus's."""
    kind = dict(chunks.dtypes)[id_col]

    def run(batches):
        for rows in batches:
            texts, vectors = [(t or "")[:chars] for t in rows.column(text_col).to_pylist()], []
            for i in range(0, len(texts), batch):
                vectors += with_retries(lambda x: list(embedder.embed(x)), texts[i : i + batch])
            yield pa.RecordBatch.from_arrays([rows.column(id_col), pa.array(vectors, pa.list_(pa.float32()))], [id_col, "embedding"])

    return chunks.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, embedding array<float>")


def template_title(question: str) -> str:
    """The first six words, with an ellipsis if there are more."""
    words = question.split()
    return " ".join(words[:6]) + ("…" if len(words) > 6 else "")
