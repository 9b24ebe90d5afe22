"""Exact quantiles of all values of a column, by narrowing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

BINS = 1024
#: Values of the last band, which the driver puts in order.
BAND = 4096


def exact_quantile(rows: DataFrame, value: Column, q: float) -> float | None:
    """The least value that a share q of the values, at least, does not exceed (the nearest rank); None without values.

    Each round counts the values in BINS equal spans of a band and goes on in the span that holds the rank, until the band has
    BAND values at most or its ends meet: a few sums over the rows, whatever their number. Nulls and NaN are left out."""
    x = value.cast("double")
    rows = rows.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    n, low, high = rows.agg(F.count("x"), F.min("x"), F.max("x")).first()
    if not n:
        return None
    rank = max(1, math.ceil(q * n))  # of the band's values
    while n > BAND and low < high:
        width = (high - low) / BINS
        spans = F.least(F.lit(BINS - 1), F.floor((F.col("x") - low) / F.lit(width))).cast("int") if width > 0 else F.lit(0)
        found = rows.where(F.col("x").between(low, high)).groupBy(spans.alias("b")).agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        for b in found.orderBy("b").collect():  # BINS rows at most
            if rank <= b["n"]:
                n, low, high = b["n"], b["low"], b["high"]
                break
            rank -= b["n"]
    if low == high:
        return low
    return rows.where(F.col("x").between(low, high)).orderBy("x").limit(rank).agg(F.max("x")).first()[0]
