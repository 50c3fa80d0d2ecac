"""Benchmark decontamination with a distributed positional inverted index.

The index is split by document into segments. A segment numbers its words on one axis, with a gap after each document,
and stores for each term the sorted positions at which it stands, as gaps of seven bits a byte. A phrase is found by intersecting the
offset-adjusted position lists of its terms, from the rarest term on; a proximity match by checking, around each
position of the rarest term, that all other terms stand close enough.

The windows of the benchmark are a table, too. Postings of its terms tell how often each stands in the corpus, so each
window is taken to the segments that hold its rarest term, and only there, with the lists of its other terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import documents, fitted_filter, may_hold, quoted, written

#: Bytes that end a word; A-Z become a-z. All bytes of non-ASCII characters belong to words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WINDOW = 10
#: Words of a segment; bounds what one search task holds, besides one longest document.
SEGMENT_WORDS = 500_000
#: Windows that are searched in a segment by one task; more are dealt over several, each with the lists it needs.
BLOCK_WINDOWS = 20_000
INDEX = "segment string, doc_no int, doc_id long, n_words int, start int, term binary, n int, positions binary"


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def packed(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 to 2^31 - 1 as bytes of seven bits, lowest first; all but the last of a number have the high bit set. And where each ends."""
    sizes = 1 + sum((numbers >= 1 << b).astype(np.int8) for b in (7, 14, 21, 28))
    ends = np.cumsum(sizes, dtype=np.int64)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    at = ends - sizes
    for k in range(5):
        if k:
            longer = sizes > k
            numbers, sizes, at = numbers[longer], sizes[longer], at[longer]
        out[at + k] = numbers >> 7 * k & 127 | (sizes > k + 1).astype(np.uint8) << 7
    return out, ends


def unpacked(lists: list[bytes]) -> list[np.ndarray]:
    """The positions of each list, whose gaps are packed; its first one is counted from 0."""
    data = np.frombuffer(b"".join(lists), np.uint8)
    last = data < 128
    starts = np.flatnonzero(np.concatenate([[True], last]))[:-1]
    at, sizes = starts, np.diff(starts, append=len(data))
    gaps, own = (data[at] & 127).astype(np.int64), np.arange(len(at))
    for k in range(1, 5):
        longer = sizes > k
        own, at, sizes = own[longer], at[longer], sizes[longer]
        gaps[own] |= (data[at + k] & 127).astype(np.int64) << 7 * k
    ends = np.concatenate([[0], np.cumsum(last)])[np.cumsum([0, *map(len, lists)])]
    sums = np.concatenate([[0], np.cumsum(gaps)])
    places = sums[1:] - np.repeat(sums[ends[:-1]], np.diff(ends))
    return [places[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _segment(name: str, ids: list, lists: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
    """A row per document with its start on the axis, then a row per term with its positions."""
    lengths = np.array([len(x) for x in lists], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    n = len(ids)
    names = [f.split()[0] for f in INDEX.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]
    made = lambda *cols: pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
    yield made([name] * n, range(n), ids, lengths, starts, [None] * n, [None] * n, [None] * n)
    number: dict[bytes, int] = {}
    give = number.setdefault
    terms = np.fromiter((give(w, len(number)) for x in lists for w in x), np.int32, int(lengths.sum()))
    if not len(terms):
        return
    place = np.arange(len(terms)) + np.repeat(np.arange(n), lengths)
    order = np.argsort(terms, kind="stable")
    sorted_places = place[order].astype(np.int32)
    counts = np.bincount(terms, minlength=len(number))
    ends = np.cumsum(counts)
    gaps = np.diff(sorted_places, prepend=0)
    gaps[ends - counts] = sorted_places[ends - counts]
    # Lists of packed gaps, cut from one buffer.
    data, cuts = packed(gaps)
    offsets = np.concatenate([[0], cuts[ends - 1]]).astype(np.int32)
    lists_col = pa.Array.from_buffers(pa.binary(), len(number), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    for a in range(0, len(number), 20_000):
        k = min(20_000, len(number) - a)
        none = pa.nulls(k)
        yield pa.record_batch(
            [pa.array([name] * k), *(none.cast(t) for t in kinds[1:5]), pa.array(list(number)[a : a + k], pa.binary()), pa.array(counts[a : a + k], pa.int32()), lists_col.slice(a, k)], names
        )


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The index of all rows, written to the shared folder: a row per document (term null) and per segment and term.

    Rows are never merged: repeated rows and null ids are documents of their own. Null texts have no words.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, held = TaskContext.get().partitionId(), 0, 0
        ids, lists = [], []
        for batch in batches:
            for i, t in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids.append(i.as_py())
                lists.append(words_of(t.as_py()))
                held += len(lists[-1]) + 1
                if held >= segment_words:
                    yield from _segment(f"{task}-{made}", ids, lists)
                    ids, lists, made, held = [], [], made + 1, 0
        if ids:
            yield from _segment(f"{task}-{made}", ids, lists)

    return written(documents(docs, id_col, text_col).mapInArrow(index, INDEX), "postings")


def windows_of(words: list[bytes], window: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All runs of so many words; the whole item if it has fewer, nothing if it has none."""
    if not words:
        return []
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


def phrase_starts(phrase: tuple[bytes, ...], postings: dict[bytes, np.ndarray]) -> np.ndarray:
    """Positions at which the phrase stands: offset-adjusted lists intersected from the shortest on."""
    lists = sorted(((postings.get(w), k) for k, w in enumerate(phrase)), key=lambda x: -1 if x[0] is None else len(x[0]))
    if lists[0][0] is None:
        return np.empty(0, np.int64)
    found = lists[0][0] - lists[0][1]
    for positions, offset in lists[1:]:
        if not len(found):
            break
        at = np.searchsorted(positions, found + offset)
        at[at == len(positions)] = 0
        found = found[positions[at] == found + offset]
    return found


def proximity_spans(phrase: tuple[bytes, ...], postings: dict[bytes, np.ndarray], within: int, starts: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the closest stand of all distinct terms around each position of the rarest, at most so wide.

    starts: where the documents begin on the axis; stands do not cross them.
    """
    lists = sorted((postings.get(w) for w in set(phrase)), key=lambda x: -1 if x is None else len(x))
    if lists[0] is None:
        return []
    spans = []
    for p in lists[0]:
        doc = int(np.searchsorted(starts, p, "right"))
        low, high = max(p - within + 1, starts[doc - 1]), min(p + within, starts[doc] if doc < len(starts) else p + within)
        near = [x[np.searchsorted(x, low) : np.searchsorted(x, high)] for x in lists]
        if not all(len(x) for x in near):
            continue
        places = np.concatenate(near)
        order = np.argsort(places, kind="stable")
        places, owner = places[order], np.repeat(np.arange(len(near)), [len(x) for x in near])[order]
        seen, best, low = np.zeros(len(near), int), None, 0
        for high in range(len(places)):
            seen[owner[high]] += 1
            while (seen > 0).all():
                if best is None or places[high] - places[low] < best[1] - best[0]:
                    best = (int(places[low]), int(places[high]))
                seen[owner[low]] -= 1
                low += 1
        if best and best[1] - best[0] < within:
            spans.append((best[0], best[1] + 1))
    return sorted(set(spans))


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item_id string, words array<binary>) of each window of each item; items may be of any length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item_id"), batch.column("text"), strict=True):
                words = words_of(text.as_py())
                last = max(1, len(words) - window + 1) if words else 0
                for a in range(0, last, 5000):
                    made = [words[i : i + window] for i in range(a, min(last, a + 5000))]
                    yield pa.record_batch([pa.array([item.as_py()] * len(made), pa.string()), pa.array(made, pa.list_(pa.binary()))], ["item_id", "words"])

    items = benchmark.select(quoted(item_col).cast("string").alias("item_id"), quoted(text_col).cast("string").alias("text")).where("text is not null")
    return items.mapInArrow(cut, "item_id string, words array<binary>")


def find_matches(index: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, slop: int | None = None, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document and item that match: segment, doc_no, item_id string, spans array<struct<start, end>>.

    spans are word positions in the document, end exclusive, merged where they touch. With slop, a window also matches
    where all its distinct terms stand within its length plus slop words, in any order. Windows with a term that the
    corpus lacks are dropped; every other is searched in the segments that hold its rarest term. A task searches a segment
    for block_windows windows on the average, so what it holds does not grow with the benchmark.
    """
    spark = index.sparkSession
    windows = written(benchmark_windows(benchmark, item_col, text_col, window), "benchmark-windows")
    phrases = written(windows.select("words").distinct().withColumn("phrase", F.monotonically_increasing_id()), "phrases")
    terms = phrases.select("phrase", F.explode("words").alias("term"))
    wanted = written(terms.select("term").distinct(), "benchmark-terms")
    held = lambda *keys, of: may_hold(F.xxhash64(*keys), fitted_filter(of.select(F.xxhash64(*keys).alias("h"))), spark)
    places = index.where("term is not null").where(held("term", of=wanted)).select("segment", "term", "n").join(wanted, "term")
    places = written(places, "benchmark-places")  # without the positions

    often = places.groupBy("term").agg(F.sum("n").alias("often"))
    rarest = terms.join(often, "term", "left").groupBy("phrase").agg(F.min(F.struct("often", "term")).alias("of"), F.bool_or(F.col("often").isNull()).alias("absent"))
    rarest = rarest.where("not absent").select("phrase", F.col("of.term").alias("term"))
    found = written(places.select("segment", "term").join(rarest, "term").select("segment", "phrase"), "candidate-segments")
    parts = written(found.groupBy("segment").agg(F.ceil(F.count("*") / block_windows).cast("int").alias("parts")), "segment-parts")
    asked = found.join(parts, "segment").withColumn("part", F.pmod(F.xxhash64("phrase"), F.col("parts")).cast("int")).join(phrases, "phrase")
    asked = written(asked.select("segment", "part", "phrase", "words"), "segment-phrases")
    needed = written(asked.select("segment", "part", F.explode("words").alias("term")).distinct(), "needed-terms")

    none = lambda kind: F.lit(None).cast(kind)
    # The filter spares most lists the shuffle; the join behind it lets none through that its part does not need. Both sides
    # grow with the documents, so the plan is that of large inputs at every size.
    lists = index.where("term is not null").where(held("segment", "term", of=needed)).select("segment", "term", "positions")
    lists = lists.join(needed.hint("merge"), ["segment", "term"]).select("segment", "part", "term", "positions")
    dealt = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    starts = index.where("term is null").select("segment", "doc_no", "start").join(dealt.hint("merge"), "segment")
    rows = starts.select("segment", "part", "doc_no", "start", none("binary").alias("term"), none("binary").alias("positions"), none("long").alias("phrase"), none("array<binary>").alias("words"))
    rows = rows.unionByName(lists, allowMissingColumns=True).unionByName(asked, allowMissingColumns=True)

    def search(rows: pa.Table) -> pa.Table:
        docs = rows.filter(pc.is_valid(rows["doc_no"])).sort_by("doc_no")
        start, numbers = docs["start"].to_numpy().astype(np.int64), docs["doc_no"].to_numpy()
        held, asked = rows.filter(pc.is_valid(rows["term"])), rows.filter(pc.is_valid(rows["phrase"]))
        postings = dict(zip(held["term"].to_pylist(), unpacked(held["positions"].to_pylist()), strict=True))
        made: list[tuple] = []
        for number, words in zip(asked["phrase"], asked["words"], strict=True):
            phrase = tuple(words.as_py())
            hits = [(p, p + len(phrase)) for p in phrase_starts(phrase, postings).tolist()]
            if slop is not None:
                hits += proximity_spans(phrase, postings, len(phrase) + slop, start)
            spans: dict[int, list] = {}
            for a, b in hits:
                doc = int(np.searchsorted(start, a, "right")) - 1
                if b - 1 < (start[doc + 1] - 1 if doc + 1 < len(start) else np.inf):
                    spans.setdefault(doc, []).append({"start": a - int(start[doc]), "end": b - int(start[doc])})
            made += [(int(numbers[d]), number.as_py(), s) for d, s in spans.items()]
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.int32(), pa.int64(), span))]
        return pa.table([pa.array([rows["segment"][0].as_py()] * len(made), pa.string()), *columns], ["segment", "doc_no", "phrase", "spans"])

    hits = written(rows.groupBy("segment", "part").applyInArrow(search, "segment string, doc_no int, phrase long, spans array<struct<start: int, `end`: int>>"), "phrase-hits")
    owned = windows.join(phrases, "words").select("phrase", "item_id").distinct()
    return hits.join(owned, "phrase").groupBy("segment", "doc_no", "item_id").agg(joined_spans(F.flatten(F.collect_list("spans"))).alias("spans"))  # one document's own


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def joined_spans(spans: pd.Series) -> pd.Series:
    """The spans of the parts of one item, merged where they touch."""
    return spans.map(lambda x: [{"start": a, "end": b} for a, b in merged_spans([(s["start"], s["end"]) for s in x])])


@F.pandas_udf(T.IntegerType())
def covered(spans: pd.Series) -> pd.Series:
    """Positions in the union of the spans."""
    return spans.map(lambda x: sum(b - a for a, b in merged_spans([(s["start"], s["end"]) for s in x])))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items array<string>, spans.

    n_hit counts the words inside any exact occurrence of a window of the benchmark; items are the distinct item ids
    with an occurring window, sorted as strings. Null or wordless texts, empty benchmarks and null items match
    nothing; null item ids are left out of items, yet their windows count as hits.
    """
    index = build_index(docs, id_col, text_col)
    matches = find_matches(index, benchmark, item_col, item_text_col, window)
    hit = matches.groupBy("segment", "doc_no").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    hit = hit.withColumn("n_hit", covered("spans"))
    rows = index.where("term is null").select("segment", "doc_no", "doc_id", "n_words")
    none = F.array().cast("array<string>")
    return rows.join(hit, ["segment", "doc_no"], "left").select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), "spans"
    )
