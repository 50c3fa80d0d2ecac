"""Filters of 64-bit hashes: of bounded size, built in tasks by parts, broadcast; they may pass what they do not hold."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Least and most bits of a filter. Filters are broadcast, so their size is bounded; fuller ones pass more that the join
#: behind them, which each of their users has, then finds absent.
FILTER_BITS = (1 << 20, 1 << 28)
#: Filters are built in so many parts, each in a task of its own.
FILTER_PARTS = 64


def filter_places(h: Column, bits: int) -> list[Column]:
    """Two bits of a 64-bit hash."""
    return [F.pmod(h, F.lit(bits)), F.pmod(F.shiftright(h, 29), F.lit(bits))]


def filter_bits(n: int) -> int:
    """The bits of a filter for n hashes: a power of two, sixteen for each within the bounds."""
    return min(max(1 << (16 * n).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])


def filter_table(keys: DataFrame, bits: int) -> DataFrame:
    """(part, bits): the bits set for the 64-bit hashes h of keys, eight a byte, cut into FILTER_PARTS parts; parts without any are left out.

    Bits go to the task of their part, so what is shuffled grows with keys, and a task holds its parts only.
    """
    part = bits // FILTER_PARTS

    def set_bits(batches):
        fields: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column("at").to_numpy()
            for k in np.unique(at // part).tolist():
                if k not in fields:
                    fields[k] = np.zeros(part, bool)
                fields[k][at[at // part == k] - k * part] = True
        if fields:
            yield pa.record_batch([pa.array(list(fields), pa.int32()), pa.array([np.packbits(f).tobytes() for f in fields.values()], pa.binary())], ["part", "bits"])

    places = keys.select(F.explode(F.array(*filter_places(F.col("h"), bits))).alias("at"))
    return places.repartition(F.floor(F.col("at") / part)).mapInArrow(set_bits, "part int, bits binary")


def filter_field(table: DataFrame) -> np.ndarray:
    """The parts of filter_table() put together: at most FILTER_BITS[1] / 8 bytes, and nothing else comes to the driver."""
    rows = table.collect()
    size = len(rows[0].bits) if rows else FILTER_BITS[0] // FILTER_PARTS // 8
    field = np.zeros((FILTER_PARTS, size), np.uint8)
    for row in rows:
        field[row.part] = np.frombuffer(row.bits, np.uint8)
    return field.ravel()


def fitted_filter(keys: DataFrame) -> np.ndarray:
    """The field of a filter for the hashes h of keys, a written table."""
    return filter_field(filter_table(keys, filter_bits(keys.count())))


def passed(h: np.ndarray, field: np.ndarray) -> np.ndarray:
    """may_hold() of 64-bit hashes, as signed integers, inside a task."""
    hit = [(field[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 for at in (h & (len(field) * 8 - 1), (h >> 29) & (len(field) * 8 - 1))]
    return (hit[0] & hit[1]).astype(bool)


def may_hold(h: Column, field: np.ndarray, spark: SparkSession) -> Column:
    """Whether the filter passes a hash."""
    shared = spark.sparkContext.broadcast(field)  # at most FILTER_BITS[1] / 8 bytes

    @F.pandas_udf("boolean")
    def passes(a: pd.Series, b: pd.Series) -> pd.Series:
        hit = [(shared.value[x >> 3] >> (7 - (x & 7)).astype(np.uint8)) & 1 for x in (a.to_numpy(np.int64), b.to_numpy(np.int64))]
        return pd.Series((hit[0] & hit[1]).astype(bool))

    return passes(*filter_places(h, len(field) * 8))
