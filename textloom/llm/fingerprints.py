"""Document fingerprints by one-permutation MinHash.

Every shingle hash is used once: its high bits choose a bin, and each bin keeps its smallest remainder. An empty bin takes
the value of a filled one that its own universal hash picks (optimal densification): probing bins in a random order until a
filled one turns up is choosing, among the filled bins, the one of least rank in that order. Of every value only the low
bits of a hash mixed with the bin's number are kept and packed; likeness corrects for the bins that agree by chance.

Sketches of parts merge by the smaller value of each bin before densification.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import documents, slices
from textloom.llm.near_dup import shingle_set

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit values, one for each value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Prints:
    """Fingerprints of 2**log_bins bins with so many bits (1, 2, 4 or 8) each, of shingles of so many words."""

    log_bins: int = 9
    bits: int = 4
    shingle: int = 5

    def __post_init__(self):
        if self.bits not in (1, 2, 4, 8) or not 3 <= self.log_bins <= 12 or self.shingle < 1:
            raise ValueError("bits must be 1, 2, 4 or 8, log_bins 3 to 12 and shingle at least 1")

    @property
    def bins(self) -> int:
        return 1 << self.log_bins

    @cached_property
    def _picks(self) -> np.ndarray:
        """[i, j]: rank of bin j in the order in which bin i probes."""
        i, j = np.arange(self.bins, dtype=np.uint64)[:, None], np.arange(self.bins, dtype=np.uint64)[None, :]
        return mixed(mixed(i + np.uint64(1)) + j * _ODD)

    @cached_property
    def _salts(self) -> np.ndarray:
        return mixed(np.arange(1, self.bins + 1, dtype=np.uint64) * _ODD)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        """The smallest remainder of each bin; EMPTY where no shingle fell."""
        low = np.full(self.bins, EMPTY)
        if len(shingles):
            h = mixed(shingles)
            np.minimum.at(low, (h >> np.uint64(64 - self.log_bins)).astype(np.intp), h & np.uint64((1 << (64 - self.log_bins)) - 1))
        return low

    def densified(self, low: np.ndarray) -> np.ndarray:
        """Every bin filled; low must have a filled one."""
        free = low == EMPTY
        if not free.any():
            return low
        full = np.flatnonzero(~free)
        out = low.copy()
        out[free] = low[full[self._picks[np.ix_(free, full)].argmin(axis=1)]]
        return out

    def packed(self, low: np.ndarray) -> bytes:
        """The fingerprint of a sketch: bins * bits / 8 bytes; none for that of an empty set."""
        if (low == EMPTY).all():
            return b""
        kept = (mixed(self.densified(low) ^ self._salts) & np.uint64((1 << self.bits) - 1)).astype(np.uint8)
        each = kept.reshape(-1, 8 // self.bits)
        return np.bitwise_or.reduce(each << (np.arange(8 // self.bits, dtype=np.uint8) * np.uint8(self.bits)), axis=1).astype(np.uint8).tobytes()

    def of(self, text: str | None) -> bytes:
        return self.packed(self.minima(shingle_set(text, self.shingle)))

    def unpacked(self, prints: bytes) -> np.ndarray:
        each = np.frombuffer(prints, np.uint8)[:, None] >> (np.arange(8 // self.bits, dtype=np.uint8) * np.uint8(self.bits))
        return (each & np.uint8((1 << self.bits) - 1)).ravel()

    def likeness(self, a: bytes | None, b: bytes | None) -> float:
        """Estimated similarity of the shingle sets, 0 to 1: 2**-bits of the bins of different sets agree by chance.

        Two empty sets are alike (1), an empty and another one are not (0).
        """
        a, b = a or b"", b or b""
        if a == b:
            return 1.0
        if not a or not b:
            return 0.0
        agree, chance = float((self.unpacked(a) == self.unpacked(b)).mean()), 2.0**-self.bits
        return min(1.0, max(0.0, (agree - chance) / (1 - chance)))


def fingerprints(docs: DataFrame, prints: Prints = Prints(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint binary), one row per input row and no shuffle; equal texts have equal fingerprints.

    Words are runs of other characters than ASCII white space, with A-Z in lower case. A text of fewer words than a shingle
    has is one shingle; null texts and those without a word have the fingerprint of no bytes.
    """

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            made = [prints.of(t.as_py()) for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(made, pa.binary())], ["doc_id", "fingerprint"])

    return documents(docs, id_col, text_col).mapInArrow(batches, "doc_id long, fingerprint binary")


def likeness(a: Column, b: Column, prints: Prints = Prints()) -> Column:
    """Estimated similarity of the documents of two fingerprints."""

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([prints.likeness(p, q) for p, q in zip(x, y, strict=True)], dtype=float)

    return of(a, b)


def in_ranges(rows: DataFrame, ranges: int | None = None) -> DataFrame:
    """rows (doc_id, text) as (range, guest, id, tie, doc_id, text), each range of ids a sorted task of its own.

    The first row of a range also stands, as a guest, at the end of the range before, and that of the first range at the end
    of the last one: so each row has its successor in its own task. The ranges come from the ids alone, one number for each
    task; texts are shuffled once. Rows of one id stand in the order of their hash, in one task.
    """
    spark = rows.sparkSession
    id_of = F.coalesce("doc_id", F.lit(-(1 << 63)))
    ids = rows.select(id_of.alias("id"), F.spark_partition_id().alias("at"))
    n = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + (ids.agg(F.max("at")).first()[0] or 0))
    firsts = ids.select("id").repartitionByRange(n, "id").groupBy(F.spark_partition_id()).agg(F.min("id").alias("id")).collect()
    starts = np.array(sorted(r.id for r in firsts), np.int64)  # as many numbers as tasks
    shared = spark.sparkContext.broadcast(starts)

    @F.pandas_udf("range int, before int")
    def places(at: pd.Series) -> pd.DataFrame:
        known = shared.value
        found = np.searchsorted(known, at.to_numpy(np.int64), "right") - 1
        before = pd.array((found - 1) % len(known), dtype="Int32")
        before[known[found] != at.to_numpy(np.int64)] = pd.NA
        return pd.DataFrame({"range": found.astype(np.int32), "before": before})

    placed = rows.select(id_of.alias("id"), F.xxhash64("text").alias("tie"), "doc_id", "text").withColumn("of", places("id"))
    own = F.struct(F.col("of.range").alias("range"), F.lit(False).alias("guest"))
    guest = F.when(F.col("of.before").isNotNull(), F.struct(F.col("of.before").alias("range"), F.lit(True).alias("guest")))
    dealt = placed.select(F.explode(F.filter(F.array(own, guest), lambda x: x.isNotNull())).alias("to"), "id", "tie", "doc_id", "text")
    flat = dealt.select("to.range", "to.guest", "id", "tie", "doc_id", "text")
    return flat.repartitionById(max(len(starts), 1), F.col("range")).sortWithinPartitions("range", "guest", "id", "tie")


def against_next(docs: DataFrame, prints: Prints = Prints(), ranges: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text held against an edited copy and against the next document in the order of ids.

    The last half of the code points (rounded down) of a text is replaced by the first as many, or all, of the next text;
    the first document follows the last. One row per input row: doc_id, n_chars, edited, fingerprint, edited_fingerprint,
    near_edited, near_next. Null texts are empty, null ids come first, and rows of one id follow each other by the hash of
    their texts. A single document is its own successor; an empty table gives an empty result.
    """

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
        for batch in rows:
            for part in slices(batch, "text"):
                out = []
                for doc_id, text, guest in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "guest")), strict=True):
                    text = text or ""
                    now = (doc_id, text, prints.of(text))
                    if last is not None:
                        own, before, print_of = last
                        half = len(before) // 2
                        edited = before[: len(before) - half] + text[:half]
                        print_edited = prints.of(edited)
                        out.append((own, len(before), edited, print_of, print_edited, prints.likeness(print_of, print_edited), prints.likeness(print_of, now[2])))
                    last = None if guest else now
                yield pa.record_batch([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names)

    schema = "doc_id long, n_chars long, edited string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
    return in_ranges(documents(docs, id_col, text_col), ranges).mapInArrow(batches, schema)
