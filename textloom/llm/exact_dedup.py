"""Exact deduplication with a log-structured merge index of text digests.

Batches are aggregated to one entry per digest (the memtable) and flushed as immutable runs: Parquet sorted by digest
within each partition, and beside it a filter, a bit field of bounded size. A batch is probed against the filter of each
earlier run; only digests that pass are looked up in the run, and a run that none passes is not read. Compaction merges
runs once there are fan_in and keeps the smallest identifier of a digest. Rows that share a digest are hits; only the
texts of hits are gathered, and verified byte by byte before they count as equal.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import documents, filter_bits, filter_places, shared_path, written

SPACES = r"[\x20\x09-\x0D]+"
#: Copies of one text that are compared with it in one go.
GROUP_PART = 500
#: Digests of several rows that are broadcast; with more of them a filter rules texts out before these are shuffled.
BROADCAST_HITS = 200_000
ENTRIES = "digest binary, first struct<no_id: boolean, doc_id: bigint, row: bigint>, members bigint"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def bit_words(keys: DataFrame, bits: int) -> DataFrame:
    """(word, held): a filter of so many bits for the digests of keys, 64 bits a word; words without any are left out."""
    at = keys.select(F.explode(F.array(*filter_places(F.xxhash64("digest"), bits))).alias("at"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))
    return at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(one).alias("held"))


def passing(rows: DataFrame, words: DataFrame, bits: int) -> DataFrame:
    """The rows whose digest a filter may hold. The filter is broadcast, at most FILTER_BITS[1] / 64 words."""
    columns = rows.columns
    for place in filter_places(F.xxhash64("digest"), bits):
        probed = rows.withColumn("_at", place).join(F.broadcast(words), F.shiftright("_at", 6) == F.col("word"))
        rows = probed.where(F.call_function("getbit", F.col("held"), F.pmod("_at", F.lit(64)).cast("int")) == 1).select(columns)
    return rows


class DigestIndex:
    """Sorted runs of (digest, first, members); first is the smallest (no_id, doc_id, row) of the members.

    Each run has its filter in a table beside it, so an index is loaded again from the paths of its runs.
    """

    def __init__(self, spark: SparkSession, path: str, fan_in: int = 4, runs: list[str] | None = None):
        self.spark, self.path, self.fan_in = spark, path, fan_in
        self.runs = list(runs or [])
        self.filters: dict[str, tuple[DataFrame, int]] = {}
        #: Runs that lookups read, and runs that their filters spared them.
        self.read = self.skipped = 0

    def flush(self, rows: DataFrame) -> str:
        """Add a batch of (digest, no_id, doc_id, row) as a run, then compact if there are fan_in runs; the batch's run."""
        run = self._run(rows.groupBy("digest").agg(F.min(F.struct("no_id", "doc_id", "row")).alias("first"), F.count("*").alias("members")))
        self.runs.append(run)
        if len(self.runs) >= self.fan_in:
            self.compact()
        return run

    def compact(self) -> None:
        """Merge all runs into one."""
        if len(self.runs) > 1:
            self.runs = [self._run(self._merged())]

    def entries(self) -> DataFrame:
        """One entry per digest over all runs."""
        return self._read(self.runs[0]) if len(self.runs) == 1 else self._merged()

    def found(self, digests: DataFrame) -> DataFrame:
        """The entries, one a run, of the (digest) rows: probed by each run's filter, then joined with what the run holds."""
        out = self.spark.createDataFrame([], ENTRIES)
        for run in self.runs:
            passed = written(passing(digests.select("digest"), *self._filter(run)).distinct(), "digest-probe")
            if passed.isEmpty():
                self.skipped += 1
                continue
            self.read += 1
            out = out.unionByName(self._read(run).join(passed, "digest"))
        return out

    def lookup(self, rows: DataFrame) -> DataFrame:
        """rows, which have a digest, with first and members; null where no run holds the digest."""
        found = self.found(rows).groupBy("digest").agg(F.min("first").alias("first"), F.sum("members").alias("members"))
        return rows.join(found, "digest", "left")

    def _filter(self, run: str) -> tuple[DataFrame, int]:
        """The words of a run's filter and its bits, which the number of the run's entries tells."""
        if run not in self.filters:
            self.filters[run] = self._read(f"{run}-filter"), filter_bits(self._read(run).count())
        return self.filters[run]

    def _read(self, run: str) -> DataFrame:
        return self.spark.read.parquet(run)

    def _merged(self) -> DataFrame:
        rows = self._read(self.runs[0])
        for run in self.runs[1:]:
            rows = rows.unionByName(self._read(run))
        return rows.groupBy("digest").agg(F.min("first").alias("first"), F.sum("members").alias("members"))

    def _run(self, entries: DataFrame) -> str:
        path = f"{self.path}/run-{uuid.uuid4().hex}"
        entries.sortWithinPartitions("digest").write.parquet(path)
        keys = self._read(path).select("digest")
        bit_words(keys, filter_bits(keys.count())).write.parquet(f"{path}-filter")
        self.filters = {run: f for run, f in self.filters.items() if run in self.runs}
        return path


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 3, digest: Callable[[Column], Column] = sha256, index: DigestIndex | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest, n_bytes.

    Texts are equal when their normalised bytes are. A null text equals the empty one. Of equal texts the row with
    the smallest doc_id is kept; a null doc_id comes after all others; of repeated rows with one id exactly one is
    kept. An empty table gives an empty result. The batches only bound how much one flush handles; a fresh index
    compacts after three.

    With an index that holds the documents of earlier calls, these count as well: keep_id may be one of theirs, then
    none of docs is kept, and group_size is over all. The texts of the earlier documents, in the columns of docs, are
    needed to verify hits among them; only those of hits are gathered. Earlier results do not change. Null ids count
    as the same row as null ids of earlier calls.
    """
    spark = docs.sparkSession
    of = lambda df: documents(df, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("norm"))
    text = of(docs).withColumn("digest", digest(F.col("norm")))
    past = None if earlier is None else of(earlier).withColumn("digest", digest(F.col("norm")))
    rows = written(
        text.select(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.monotonically_increasing_id().alias("row"), "digest", F.octet_length("norm").alias("n_bytes")),
        "digests",
    )
    old = spark.createDataFrame([], "digest binary, old struct<no_id: boolean, doc_id: bigint>")
    if index is None:
        index = DigestIndex(spark, shared_path(spark, "digest-index"), fan_in=3)
    elif index.runs:
        old = written(index.found(rows).groupBy("digest").agg(F.min(F.struct("first.no_id", "first.doc_id")).alias("old")), "earlier-firsts")
    #: Digests of two rows or more: in a batch and an earlier run, or within a batch, which its own run then tells.
    hits = spark.createDataFrame([], "digest binary")
    for batch in range(batches):
        part = rows.where(F.pmod(F.xxhash64("row"), F.lit(batches)) == batch)
        hits = hits.union(index.found(part).select("digest"))
        hits = hits.union(spark.read.parquet(index.flush(part)).where("members > 1").select("digest"))
    hits = written(hits.distinct(), "hit-digests")
    shared = written(index.entries().join(hits, "digest").select("digest", "first", "members", F.ceil(F.col("members") / GROUP_PART).cast("int").alias("parts")), "hit-entries")

    # Byte verification of all hits against the text of the row that stays. Texts of other rows stay where they are.
    # The first text is repeated for each GROUP_PART members, so copies of one text are compared in as many tasks as
    # their number asks for.
    every, wanted = text if past is None else text.unionByName(past), shared.select("digest", F.col("first.doc_id").alias("first_id"), "parts")
    if shared.count() <= BROADCAST_HITS:
        several = every.join(F.broadcast(wanted), "digest")  # a checked size
    else:
        bits = filter_bits(hits.count())
        several = passing(every, written(bit_words(hits, bits), "hit-filter"), bits).join(wanted, "digest")
    several = several.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.col("parts")).cast("int"))
    several = written(several.select("digest", "norm", "part", "parts", F.col("doc_id").eqNullSafe(F.col("first_id")).alias("may_stay")), "digest-hits")
    first = several.where("may_stay").groupBy("digest", "parts").agg(F.min("norm").alias("first_norm"))
    first = first.select("digest", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "first_norm")
    other = several.join(first, ["digest", "part"]).where("norm <> first_norm").select("digest").distinct()
    other = written(other, "digest-collisions")
    joined = rows.join(shared.drop("parts"), "digest", "left").join(old, "digest", "left")
    first = F.coalesce("first", F.struct("no_id", "doc_id", "row"))
    newer = F.col("old").isNull() | (F.struct("no_id", "doc_id") < F.col("old"))
    keep = ["doc_id", "keep_id", "group_size", "kept", "digest", "n_bytes"]
    out = joined.withColumn("keep_id", first["doc_id"]).withColumn("group_size", F.coalesce("members", F.lit(1).cast("long"))).withColumn("kept", (F.col("row") == first["row"]) & newer).select(keep)
    if other.isEmpty():
        return out
    return out.join(other, "digest", "left_anti").select(keep).unionByName(_regrouped(text, past, other).select(keep))


def _regrouped(text: DataFrame, past: DataFrame | None, other: DataFrame) -> DataFrame:
    """exact_dedup() of the rows of text whose digests are in other, grouped by their bytes with those of past."""
    odd = lambda df, earlier: df.join(other, "digest", "left_semi").select(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.lit(earlier).alias("earlier"), "norm", "digest")
    both = odd(text, False) if past is None else odd(text, False).unionByName(odd(past, True))
    both = written(both.withColumn("row", F.monotonically_increasing_id()), "digest-regrouped")
    groups = both.groupBy("norm").agg(F.min(F.struct("no_id", "doc_id", ~F.col("earlier"), "row")).alias("first"), F.count("*").alias("group_size"))
    return both.where("not earlier").join(groups, "norm").select("*", F.col("first.doc_id").alias("keep_id"), (F.col("row") == F.col("first.row")).alias("kept"), F.octet_length("norm").alias("n_bytes"))
