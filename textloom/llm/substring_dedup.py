"""Removal of long repeated passages with a log-structured index of window fingerprints.

A window of W words carries as fingerprint the smallest hash of the word n-grams in it. Neighbouring windows mostly
share it and form a stretch, so a document needs only a few rows, yet equal windows always have equal fingerprints.

Documents come in batches. Each is flushed as an immutable run, bucketed and sorted by fingerprint: for each kind of
stretch the smallest document that holds it. The fingerprints of a batch are merge-joined with the runs of earlier
batches, whose side is neither shuffled nor gathered; what they hit tells which texts to look at, those of the batch and
those of the earlier documents that stand for the kinds hit. Stretches of these are verified by BLAKE2b digests of their
words, 128 bits, not of the hashes that chose them: a stretch that is the same in a smaller document goes as a whole;
where stretches of one fingerprint differ, the windows of one stretch of each kind are compared one by one, by such
digests of the words of each. Runs are compacted once there are fan_in. Whole copies within a batch are settled first.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import documents, fitted_filter, may_hold, salted_join, shared_path, written

WINDOW = 50
#: Words of the n-grams whose smallest hash marks a window.
GRAM = 8
#: A fingerprint of more stretches than this is dealt over several tasks and buckets, each with at most about so many.
HOT = 5000
DIGEST = 16
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: str | None) -> list[bytes]:
    """Runs of other characters than ASCII white space."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _runs(hashes: np.ndarray, n: int, odd: np.uint64) -> np.ndarray:
    """A hash of each run of n hashes, built up by doubling."""
    size, whole, done = 1, None, 0
    block = hashes
    while True:
        if n & size:
            if whole is None:
                whole, done = block, size
            else:
                k = len(hashes) - done - size + 1
                whole, done = _mixed(whole[:k] * odd + block[done : done + k]), done + size
        if size * 2 > n:
            return whole
        k = len(block) - size
        block, size = _mixed(block[:k] * odd + block[size : size + k]), size * 2


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def fingerprints(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The fingerprint of each window, as signed integers: the smallest n-gram hash in it."""
    grams = _runs(hashes, gram, _ODD)
    width, size = window - gram + 1, 1
    low = grams
    while size * 2 <= width:
        low, size = np.minimum(low[:-size], low[size:]), size * 2
    n = len(grams) - width + 1
    return np.minimum(low[:n], low[width - size :][:n]).view(np.int64)


def window_hashes(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """A 64-bit hash of the words of each window."""
    return _runs(hashes, window, _ODD2)


def stretches_of(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, first window and end of each stretch of windows of equal fingerprint."""
    prints = fingerprints(hashes, window, gram)
    begin = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
    return prints[begin], begin, np.append(begin[1:], len(prints))


class WindowIndex:
    """Immutable runs of (fingerprint, salt, stretch, first, last), and the texts of all documents that were added.

    stretch is a hash of the windows of a stretch, first the smallest (doc_id, key) that holds it, last the largest doc_id.
    Runs are bucketed and sorted by fingerprint and salt; salt is 0, but for fingerprints of more than HOT rows,
    which a small table beside the run lists. An index is loaded again from its path and the names of its runs.
    """

    def __init__(self, spark: SparkSession, path: str, fan_in: int = 4, runs: list[str] | None = None, buckets: int | None = None):
        self.spark, self.path, self.fan_in = spark, path, fan_in
        self.runs = list(runs or [])
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def add_texts(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Store (doc_id, key, text) rows: these as stored, and those that were stored before."""
        name = f"b-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/texts/batch={name}")
        every = self.spark.read.schema("doc_id long, key long, text string, batch string").parquet(f"{self.path}/texts")
        return every.where(F.col("batch") == name).drop("batch"), every.where(F.col("batch") != name).drop("batch")

    def add(self, marks: DataFrame) -> str:
        """Flush (fingerprint, stretch, doc_id, key) rows as a run, then compact if there are fan_in runs; the flushed run."""
        run = self._run(marks.groupBy("fingerprint", "stretch").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.max("doc_id").alias("last")), marks)
        self.runs.append(run)
        if len(self.runs) >= self.fan_in:
            rows = self.read(self.runs[0])
            for other in self.runs[1:]:
                rows = rows.unionByName(self.read(other))
            self.runs = [self._run(rows.groupBy("fingerprint", "stretch").agg(F.min("first").alias("first"), F.max("last").alias("last")), rows)]
        return run

    def held(self, run: str, prints: DataFrame) -> DataFrame:
        """The entries of a run for distinct (fingerprint) rows, by a merge join that leaves the run where it is."""
        asked = prints.join(self.spark.read.parquet(f"{self.path}/{run}-hot"), "fingerprint", "left")
        asked = asked.select("fingerprint", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("salt"))
        return self.read(run).join(asked.hint("merge"), ["fingerprint", "salt"])

    def read(self, run: str) -> DataFrame:
        """The run as a bucketed table; its name ends in the number of buckets."""
        name = run.replace("-", "_")
        if not self.spark.catalog.tableExists(name):
            columns = "fingerprint BIGINT, stretch BIGINT, first STRUCT<doc_id: BIGINT, key: BIGINT>, last BIGINT, salt INT"
            place = f"{self.path}/{run}".replace("'", "''")
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (fingerprint, salt) SORTED BY (fingerprint, salt) INTO {run.rsplit('-', 1)[1]} BUCKETS LOCATION '{place}'")
        return self.spark.table(name)

    def _run(self, entries: DataFrame, rows: DataFrame) -> str:
        """Write entries, which were made of rows."""
        run = f"run-{uuid.uuid4().hex}-{self.buckets}"
        counts = rows.groupBy("fingerprint").agg(F.count("*").alias("n")).where(F.col("n") > HOT)
        counts.select("fingerprint", F.ceil(F.col("n") / HOT).cast("int").alias("parts")).write.parquet(f"{self.path}/{run}-hot")
        salted = entries.join(self.spark.read.parquet(f"{self.path}/{run}-hot"), "fingerprint", "left")
        salted = salted.withColumn("salt", F.pmod(F.xxhash64("stretch"), F.coalesce("parts", F.lit(1))).cast("int"))
        dealt = salted.select("fingerprint", "stretch", "first", "last", "salt").repartition(self.buckets, "fingerprint", "salt")
        dealt.write.bucketBy(self.buckets, "fingerprint", "salt").sortBy("fingerprint", "salt").option("path", f"{self.path}/{run}").saveAsTable(run.replace("-", "_"))
        return run


def scanned(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, key, n_words, sha of all words, marks: fingerprint and kind of each stretch of a document's windows)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, prints, kinds, sizes = [], [], [], [], [0]
            for text in batch.column("text"):
                words = words_of(text.as_py())
                counts.append(len(words))
                digests.append(sha256(b" ".join(words)).digest())
                if len(words) >= window:
                    hashes = word_hashes(words)
                    own, begin, end = stretches_of(hashes, window, gram)
                    whole = window_hashes(hashes, window)
                    sums = np.add.reduceat(_mixed(whole), begin)
                    prints.append(own)
                    kinds.append(_mixed(sums + (end - begin).astype(np.uint64) * _ODD + whole[begin] * _ODD2 + whole[end - 1]))
                sizes.append(sizes[-1] + (len(prints[-1]) if len(words) >= window else 0))
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *(x.view(np.int64) for x in c)])) for c in (prints, kinds)], ["fingerprint", "stretch"])
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("key"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)], ["doc_id", "key", "n_words", "sha", "marks"]
            )

    return docs.mapInArrow(scan, "doc_id long, key long, n_words long, sha binary, marks array<struct<fingerprint: long, stretch: long>>")


def stretches(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """The stretches of windows of equal fingerprint in (doc_id, key, text, marks, wide, old), for the fingerprints in marks.

    (stretch, doc_id, key, at, n, windows, old): stretch is a digest of all words of n windows from the at-th on; for the
    fingerprints in wide, windows holds one of the words of each, DIGEST bytes one after the other.
    """
    names = ["stretch", "doc_id", "key", "at", "n", "windows", "old"]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]

    def digest(data) -> bytes:
        return blake2b(data, digest_size=DIGEST).digest()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, key, text, marks, wide, old in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "text", "marks", "wide", "old")), strict=True):
                words = words_of(text)
                joined = memoryview(b" ".join(words))
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
                ends = ends.tolist()
                prints, begin, end = stretches_of(word_hashes(words), window, gram)
                wanted, wide, out = np.isin(prints, np.array(marks, np.int64)), set(wide), []
                for own, a, b in zip(prints[wanted].tolist(), begin[wanted].tolist(), end[wanted].tolist(), strict=True):
                    windows = b"".join([digest(joined[starts[k] : ends[k + window - 1]]) for k in range(a, b)]) if own in wide else None
                    out.append((digest(joined[starts[a] : ends[b + window - 2]]), doc_id, key, a, b - a, windows, old))
                if out:
                    yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names)

    made = "stretch binary, doc_id long, key long, at int, n int, windows binary, old boolean"
    return texts.select("doc_id", "key", "text", "marks", "wide", "old").mapInArrow(emit, made)


def repeated_places(found: DataFrame) -> DataFrame:
    """(doc_id, key, at, n): the n windows from the at-th on whose words start in a smaller document, where not old.

    found: the table of stretches(). Of each kind of stretch the smallest doc_id stands for all: what it holds, they
    hold. So larger ones lose the stretch, and windows are compared only where those that stand for a kind have them.
    """
    kinds = found.groupBy("stretch").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("last > first").drop("last")
    new = found.where("not old").select("stretch", "doc_id", "key", "at", "n")
    whole = salted_join(new, written(kinds, "stretch-kinds"), ["stretch"]).where("doc_id > first").select("doc_id", "key", "at", "n")
    each = found.where("windows is not null").select("doc_id", "key", "at", "old", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.substring("windows", k * DIGEST + 1, F.lit(DIGEST)))).alias("k", "window"))
    each = each.select("window", "doc_id", "key", (F.col("at") + F.col("k")).alias("at"), "old")
    owners = each.groupBy("window").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("last > owner").drop("last")
    single = salted_join(each.where("not old").drop("old"), owners, ["window"]).where("doc_id > owner").select("doc_id", "key", "at", F.lit(1).alias("n"))
    return whole.unionByName(single)


def wanted_texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The (doc_id, key, text) rows joined with wanted by doc_id and key; texts that a filter rules out are not shuffled."""
    spark = texts.sparkSession
    field = fitted_filter(wanted.select(F.xxhash64("doc_id", "key").alias("h")))
    return texts.where(may_hold(F.xxhash64("doc_id", "key"), field, spark)).join(wanted.hint("merge"), ["doc_id", "key"])


def deduplicate_batch(index: WindowIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, with_text: bool = False, earlier: DataFrame | None = None) -> DataFrame:
    """remove_repeats() of docs against each other and all that index holds; then index holds docs as well.

    What earlier calls returned does not change. All calls need the same window and gram. The texts of documents of earlier
    calls are looked up in earlier, in the columns of docs; without it, index stores the texts of each call.
    """
    keyed = lambda df: documents(df, id_col, text_col).withColumn("key", F.xxhash64("text"))  # noqa: E731  key tells rows of one doc_id apart
    rows, earlier = index.add_texts(keyed(docs)) if earlier is None else (keyed(docs), keyed(earlier))
    marks = written(scanned(rows, window, gram), "window-marks")
    firsts = marks.where(F.col("n_words") >= window).groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("last > first")
    led = salted_join(marks, firsts.select("sha", "first"), ["sha"], "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    marks = written(led.drop("first"), "window-marks-led")
    each = marks.where("doc_id is not null and not copy and n_words >= " + str(int(window))).select("doc_id", "key", F.inline("marks"))
    runs = list(index.runs)
    own = index.read(index.add(each))
    prints = own.select("fingerprint").distinct()
    hits = index.spark.createDataFrame([], "fingerprint long, stretch long, doc_id long, key long")
    for run in runs:
        hits = hits.unionByName(index.held(run, prints).select("fingerprint", "stretch", "first.*"))
    hits = written(hits, "run-hits")
    several = own.groupBy("fingerprint").agg(F.min("first.doc_id").alias("low"), F.max("last").alias("high")).where("high > low")
    shared = written(several.select("fingerprint").union(hits.select("fingerprint")).distinct(), "shared-fingerprints")

    # Who stands for each kind of stretch, and where one fingerprint has several kinds, one of them new.
    kinds = own.join(shared.hint("merge"), "fingerprint").select("fingerprint", "stretch", "first.*", F.lit(False).alias("old")).unionByName(hits.withColumn("old", F.lit(True)))
    first = kinds.groupBy("fingerprint", "stretch").agg(F.min(F.struct("doc_id", ~F.col("old"), "key", "old")).alias("of")).select("fingerprint", "of.doc_id", "of.key", "of.old")
    first = written(first, "kind-firsts")
    mixed = first.groupBy("fingerprint").agg(F.count("*").alias("kinds"), F.bool_or(~F.col("old")).alias("new")).where("kinds > 1 and new").select("fingerprint")
    wide = written(salted_join(first, mixed, ["fingerprint"]).withColumn("wide", F.col("fingerprint")), "mixed-firsts")

    def gathered(held: DataFrame, old: bool) -> DataFrame:
        held = held.select("doc_id", "key", "fingerprint", F.lit(None).cast("long").alias("wide")).unionByName(wide.where(F.col("old") == old).drop("old"))
        return held.groupBy("doc_id", "key").agg(F.collect_set("fingerprint").alias("marks"), F.collect_set("wide").alias("wide")).withColumn("old", F.lit(old))  # at most one document's own

    suspects = written(gathered(salted_join(each.select("doc_id", "key", "fingerprint"), shared, ["fingerprint"]), False), "suspects")
    texts = written(wanted_texts(rows, suspects).dropDuplicates(["doc_id", "key"]), "window-texts")
    found = stretches(texts, window, gram)
    if runs:
        owners = written(gathered(hits, True), "owners")
        found = found.unionByName(stretches(wanted_texts(earlier, owners).dropDuplicates(["doc_id", "key"]), window, gram))
    places = repeated_places(written(found, "stretches"))
    cuts = written(places.groupBy("doc_id", "key").agg(F.collect_set(F.struct("at", "n")).alias("cuts")), "cuts")  # at most one document's own
    return batch_result(rows, marks.drop("marks"), texts, cuts, window, with_text)


def batch_result(rows: DataFrame, marks: DataFrame, texts: DataFrame, cuts: DataFrame, window: int, with_text: bool) -> DataFrame:
    """The rows of a batch: those that cuts names without the windows in them, copies empty, all others whole."""
    held = cut_texts(texts.join(cuts.hint("merge"), ["doc_id", "key"]).select("doc_id", "key", "text", "cuts"), window, with_text)
    nothing = F.unhex(F.sha2(F.lit(""), 256))
    whole = marks.join(cuts.select("doc_id", "key").hint("merge"), ["doc_id", "key"], "left_anti")
    whole = whole.select("doc_id", "key", "copy", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(0).alias("n_removed"), F.when(F.col("copy"), nothing).otherwise(F.col("sha")).alias("kept_sha256"))
    if with_text:
        kept = spaced(rows.dropDuplicates(["doc_id", "key"]))
        whole = whole.join(kept, whole.doc_id.eqNullSafe(kept.doc_id) & whole.key.eqNullSafe(kept.key)).select(whole["*"], F.when(F.col("copy"), "").otherwise(F.col("text")).alias("text"))
    # A row that is there several times comes back as often.
    again = marks.join(cuts.select("doc_id", "key").hint("merge"), ["doc_id", "key"]).select("doc_id", "key")
    return whole.drop("key", "copy").unionByName(again.join(held.hint("merge"), ["doc_id", "key"]).drop("key"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, batches: int = 2, with_text: bool = False, history: WindowIndex | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 binary; with_text adds the kept text.

    A word goes if a window of so many words covers it whose words also start somewhere in a document with a smaller
    doc_id. Windows are judged on the input. Texts shorter than a window, empty or null lose nothing; null ids are
    neither searched nor removed from. Rows that repeat a doc_id count as one owner, so they do not remove each other.
    The documents are taken in batches of rising doc_id, each against the runs of those before.
    With history, docs are one batch; the documents of earlier calls with it count as well, and docs are added to it; what
    earlier calls returned does not change. history needs the same window and gram in all calls.
    """
    if history is not None:
        return deduplicate_batch(history, docs, id_col, text_col, window, gram, with_text)
    spark = docs.sparkSession
    rows = documents(docs, id_col, text_col)
    index = WindowIndex(spark, shared_path(spark, "window-index"), fan_in=max(2, batches))
    cuts = rows.select(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)]).alias("at")).first()["at"] if batches > 1 else None
    cuts = sorted(set(cuts or []))
    number = sum((F.coalesce((F.col("doc_id") > c).cast("int"), F.lit(0)) for c in cuts), F.lit(0))
    out = None
    for k in range(len(cuts) + 1):
        part = deduplicate_batch(index, rows.where(number == k), window=window, gram=gram, with_text=with_text, earlier=rows.where(number < k))
        out = part if out is None else out.unionByName(part)
    return out


def spaced(rows: DataFrame) -> DataFrame:
    """(doc_id, key, text) with the words of the text joined by one space."""
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return rows.select("doc_id", "key", words.alias("text"))


def cut_texts(texts: DataFrame, window: int, with_text: bool) -> DataFrame:
    """The rows of (doc_id, key, text, cuts) without the words of the windows that cuts, structs of (at, n), list."""
    names = ["doc_id", "key", "n_words", "n_removed", "kept_sha256", *["text"] * with_text]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, digests, kept_texts = [], [], [], []
            for text, cuts in zip(batch.column("text"), batch.column("cuts"), strict=True):
                words = words_of(text.as_py())
                at, n = np.array([(c["at"], c["n"]) for c in cuts.as_py()], np.int64).T
                edge = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + n + window - 1, minlength=len(words) + 1)
                keep = np.cumsum(edge)[: len(words)] == 0
                kept = b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k)
                counts.append(len(words))
                removed.append(len(words) - int(keep.sum()))
                digests.append(sha256(kept).digest())
                kept_texts.append(kept.decode())
            columns = [batch.column("doc_id"), batch.column("key"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.binary())]
            yield pa.record_batch([*columns, *[pa.array(kept_texts, pa.string())] * with_text], names)

    return texts.mapInArrow(cut, "doc_id long, key long, n_words long, n_removed long, kept_sha256 binary" + ", text string" * with_text)
