"""Tables that cut lineage, and lists that are broadcast where they were weighed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..scratch import Scratch, shared_folder

__all__ = ["BROADCAST_BYTES", "Scratch", "fits", "shared_folder", "sized"]

#: Of a list in an executor's memory, with ROW_BYTES for each row beside its values.
BROADCAST_BYTES = 24 << 20
ROW_BYTES = 32
_WIDTHS = {T.LongType: 8, T.IntegerType: 4, T.DoubleType: 8, T.BooleanType: 1}


def fits(rows: DataFrame) -> bool:
    """Do the rows of a saved table weigh BROADCAST_BYTES at most? All of them are weighed."""
    fixed, measured = ROW_BYTES, F.lit(0)
    for field in rows.schema:
        if width := _WIDTHS.get(type(field.dataType)):
            fixed += width
        elif isinstance(field.dataType, T.ArrayType):
            each = sum(_WIDTHS[type(f.dataType)] for f in field.dataType.elementType) if isinstance(field.dataType.elementType, T.StructType) else 8
            measured += 16 + F.size(field.name) * (8 + each)
        else:
            measured += 8 + F.coalesce(F.octet_length(field.name), F.lit(0))
    weight = rows.select((F.lit(fixed) + measured).cast("long").alias("w")).agg(F.sum("w")).first()[0]
    return (weight or 0) <= BROADCAST_BYTES


def sized(rows: DataFrame) -> DataFrame:
    """A saved table, to be broadcast where it fits; a larger one meets the other side in a shuffle."""
    return F.broadcast(rows) if fits(rows) else rows
