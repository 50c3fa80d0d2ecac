"""Near-duplicate documents by SetSketch registers, banded, compared by likelihood and verified on full shingle sets.

Each register holds the truncated level, on an exponential scale of base B, of the smallest hash of a document's
shingles; sketches of parts merge by the larger level. Documents that agree in all registers of a band are candidates.

A bucket of a band may be very large, so its pairs are not listed. Texts with equal sets are one class. Each bucket
first compares its members with one representative, the member with the most company over all bands; confirmed links
give components. Only buckets whose other members still lie in several components are then compared further: their
members are gathered by representative, so that each comes once and not once a band, and compared block by block
inside tasks, where sketches rule most pairs out, full sets confirm the rest, and members that confirmed links have
brought together are not compared again. A task passes on no more links than it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import documents, salted_join, written

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
BANDS, BAND_ROWS = 40, 6
REGISTERS = BANDS * BAND_ROWS
#: Base of the register scale and rate of its exponentials.
BASE, RATE = 1.12, 20.0
#: A pair is dropped if its registers are e**GIVE times likelier at the best estimate than at the threshold.
GIVE = 14.0
#: Members, and shingles of all of them, that make a block on the average.
BLOCK, BLOCK_SHINGLES = 1000, 2_000_000
_rng = np.random.default_rng(20240601)
_A = (_rng.integers(0, 1 << 31, REGISTERS, np.int64) * 2 + 1).astype(np.uint32)[:, None]
_C = _rng.integers(0, 1 << 32, REGISTERS, np.int64).astype(np.uint32)[:, None]
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word runs of so many words; of all words if there are fewer; else empty.

    Words are runs of other characters than ASCII white space, with A-Z in lower case.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))] if words else [], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - size + 1
    whole = hashes[:n]
    for k in range(1, size):
        whole = _mixed(whole * _ODD + hashes[k : k + n])
    return np.unique(whole)


def levels(minima: np.ndarray) -> np.ndarray:
    """The truncated level of each smallest 32-bit hash."""
    u = (minima + 0.5) / 2.0**32
    return np.clip(np.floor(1 - np.log(-np.log1p(-u) / RATE) / np.log(BASE)), 0, 255).astype(np.uint8)


def set_sketch(shingles: np.ndarray) -> np.ndarray:
    """The registers of a set of hashes."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(short), 2048):
        low = np.minimum(low, (short[None, a : a + 2048] * _A + _C).min(axis=1))
    return levels(low)


def merged_sketch(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A signed 64-bit key for each band."""
    rows = registers.reshape(BANDS, BAND_ROWS).astype(np.uint64)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for k in range(BAND_ROWS):
        keys = _mixed(keys * _ODD + rows[:, k] + np.uint64(1))
    return keys.view(np.int64)


def _chance(x: np.ndarray) -> np.ndarray:
    return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-9, 1)


def possible(larger: np.ndarray, smaller: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether pairs may reach the threshold.

    larger and smaller: registers in which a is above and below b. The set sizes bound the similarity exactly; then
    the similarity is estimated by joint likelihood of the three counts given both sizes.
    """
    n_a, n_b = np.asarray(n_a, float), np.asarray(n_b, float)
    least = percent / 100
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    top = np.minimum(u / v, v / u)

    def fit(j: np.ndarray) -> np.ndarray:
        up, down = _chance(u - v * j), _chance(v - u * j)
        same = np.clip(1 - up - down, 1e-9, 1)
        return larger * np.log(up) + smaller * np.log(down) + (REGISTERS - larger - smaller) * np.log(same)

    at_least = np.maximum.reduce([fit(np.minimum(j, top)) for j in np.linspace(least, 1, 9)])
    below = np.maximum.reduce([fit(np.minimum(j, top)) for j in np.linspace(0, least, 41)])
    fits_sizes = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return fits_sizes & (at_least >= below - GIVE)


def sketched(rows: DataFrame, size: int) -> DataFrame:
    """(doc_id, key) rows with n, the set's 128-bit digest, sketch and bands (both null for an empty set)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, sketches, bands = [], [], [], []
            for text in batch.column("text"):
                shingles = shingle_set(text.as_py(), size)
                n.append(len(shingles))
                digests.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                registers = set_sketch(shingles) if len(shingles) else None
                sketches.append(None if registers is None else registers.tobytes())
                bands.append(None if registers is None else band_keys(registers))
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("key"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "key", "n", "digest", "sketch", "bands"],
            )

    return rows.mapInArrow(sketch, "doc_id long, key long, n long, digest binary, sketch binary, bands array<long>")


def plausible_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs of classes that possible() keeps."""
    side = lambda x: classes.select(F.col("c").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(f"sketch_{x}").to_pylist()), np.uint8).reshape(-1, REGISTERS) for x in "ab")
            sizes = (batch.column(f"n_{x}").to_numpy() for x in "ab")
            good = possible((a > b).sum(1), (a < b).sum(1), *sizes, percent)
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(keep, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets are similar enough; texts has (c, text) of all classes in pairs."""
    side = lambda x: texts.select(F.col("c").alias(x), F.col("text").alias(f"text_{x}"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None  # rows of one b mostly follow each other
        for batch in batches:
            good = []
            for b, text_a, text_b in zip(batch.column("b").to_pylist(), batch.column("text_a"), batch.column("text_b"), strict=True):
                if b != last:
                    last, known = b, shingle_set(text_b.as_py(), size)
                mine = shingle_set(text_a.as_py(), size)
                common = len(np.intersect1d(mine, known, assume_unique=True))
                good.append(100 * common >= percent * (len(mine) + len(known) - common))
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(c, label) of every node of the (a, b) links: label is the smallest node it is connected with.

    Labels spread along links and jump to the label of their label, so long chains take few rounds. Each round is a
    table in the shared folder.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = written(both.groupBy(F.col("a").alias("c")).agg(F.least(F.min("b"), F.col("c")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.c).groupBy(F.col("a").alias("c")).agg(F.min("label").alias("near"))
        best = labels.join(near, "c").select("c", "label", F.least("label", "near").alias("best"))
        up = labels.select(F.col("c").alias("best"), F.col("label").alias("up"))
        moved = written(best.join(up, "best").select("c", F.least("best", "up").alias("label"), (F.least("best", "up") < F.col("label")).alias("changed")), "labels")
        labels = moved.select("c", "label")
        if moved.where("changed").isEmpty():
            return labels


def block_links(rest: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b) links, confirmed on full sets, that connect the components of each group of rows.

    rest: (head, i, j, c, label, side, n, sketch, text), where the rows of (head, i, j) are one or two blocks to compare.
    """
    columns = ["head", "i", "j", "c", "label", "side", "n", "sketch", "text"]
    group = ("head", "i", "j")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in group])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(a, b - a)
                if held and any(held[-1].column(k)[0] != part.column(k)[0] for k in group):
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(part)
        if held:
            yield pa.Table.from_batches(held)

    def candidates(n: np.ndarray, label: np.ndarray, side: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows, which are in the order of n, that differ in label and that the sketches hold possible; likeliest first."""
        j = percent / 100
        least = REGISTERS * j - 7 * (REGISTERS * j * (1 - j)) ** 0.5  # registers agree at least as often as sets overlap
        two, ends = side.min() != side.max(), np.searchsorted(n, n * 100 // percent, "right")
        left, right = [], []
        for k in range(len(n) - 1):
            other = np.flatnonzero((label[k + 1 : ends[k]] != label[k]) & ((side[k + 1 : ends[k]] != side[k]) | (not two))) + k + 1
            if len(other):
                other = other[(sketch[other] == sketch[k]).sum(1) >= least]
                left.append(np.full(len(other), k))
                right.append(other)
        if not left:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        left, right = np.concatenate(left), np.concatenate(right)
        good, equal = [], []
        for a in range(0, len(left), 50_000):
            x, y = sketch[left[a : a + 50_000]], sketch[right[a : a + 50_000]]
            larger, smaller = (x > y).sum(1), (x < y).sum(1)
            good.append(possible(larger, smaller, n[left[a : a + 50_000]], n[right[a : a + 50_000]], percent))
            equal.append(REGISTERS - larger - smaller)
        good = np.concatenate(good) if good else np.empty(0, bool)
        order = np.argsort(-np.concatenate(equal)[good], kind="stable") if equal else np.empty(0, np.int64)
        return left[good][order], right[good][order]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in blocks(batches):
            n = x.column("n").to_numpy()
            order = np.argsort(n, kind="stable")  # partners by size form one stretch
            sketch = np.frombuffer(b"".join(x.column("sketch").to_pylist()), np.uint8).reshape(-1, REGISTERS)[order]
            c, label, side = (x.column(k).to_numpy()[order] for k in ("c", "label", "side"))
            texts, sets = x.column("text"), {}
            joined = {v: v for v in label.tolist()}

            def root(v: int, joined=joined) -> int:
                while joined[v] != v:
                    joined[v] = v = joined[joined[v]]
                return v

            def shingles(k: int, texts=texts, order=order, sets=sets) -> np.ndarray:
                if k not in sets:
                    sets[k] = shingle_set(texts[int(order[k])].as_py(), size)
                return sets[k]

            left, right = [], []
            for i, j in zip(*(v.tolist() for v in candidates(n[order], label, side, sketch)), strict=True):
                a, b = root(int(label[i])), root(int(label[j]))
                if a == b:
                    continue
                mine, theirs = shingles(i), shingles(j)
                common = len(np.intersect1d(mine, theirs, assume_unique=True))
                if 100 * common >= percent * (len(mine) + len(theirs) - common):
                    joined[max(a, b)] = min(a, b)
                    left.append(int(c[i]))
                    right.append(int(c[j]))
            if left:
                yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    dealt = rest.select(columns).repartition(*group).sortWithinPartitions(*group)
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, key (xxhash64 of the text), n_shingles, component_id, kept.

    Links join documents whose sets of word shingles have 100 * intersection >= percent * union, each confirmed on the
    full sets; component_id is the smallest doc_id that links reach. Null and wordless texts have empty sets and link
    with nothing. The bands are laid out for percent of 80 or more: a link at 80 is missed by all with a chance of 5e-6.
    Rows with a null doc_id are components of their own with a null id; repeated rows are linked.
    """
    rows = documents(docs, id_col, text_col).withColumn("key", F.xxhash64("text"))
    sketches = written(sketched(rows, shingle).withColumn("row", F.monotonically_increasing_id()), "sketches")
    leaders = sketches.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min_by(F.struct("doc_id", "key", "n", "sketch", "bands", F.col("row").alias("c")), F.struct("doc_id", "row")).alias("of"))
    classes = written(leaders.select("digest", "of.*"), "classes")

    members = classes.select("c", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    buckets = written(salted_join(members, shared, ["bucket"], by="c"), "buckets")
    company = buckets.groupBy("c").agg(F.sum("size").alias("company"))
    heads = buckets.join(company, "c").groupBy("bucket").agg(F.max_by("c", F.struct("company", F.col("c"))).alias("head"))
    buckets = written(salted_join(buckets, heads, ["bucket"], by="c"), "bucket-heads")
    grouped = classes.join(company.select("c"), "c")
    texts = written(rows.join(grouped.select("c", "doc_id", "key"), ["doc_id", "key"]).dropDuplicates(["c"]).select("c", "text"), "near-texts")
    known = written(grouped.select("c", "n", "sketch"), "near-sketches")

    first = buckets.where("c <> head").select(F.col("c").alias("a"), F.col("head").alias("b")).distinct()
    links = written(confirmed(plausible_pairs(first, known, percent), texts, shingle, percent), "star-links")
    labels = components(links)

    rest = buckets.where("c <> head and size > 2").join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
    mixed = rest.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket")
    rest = written(salted_join(rest, mixed, ["bucket"], by="c").select("head", "c", "label").distinct().join(known, "c"), "open-members")
    parts = rest.groupBy("head").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    rest = rest.join(parts, "head").withColumn("side", F.pmod(F.xxhash64("c", "head"), F.col("parts")).cast("int"))
    rest = rest.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rest = rest.select("head", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"), "c", "label", "side", "n", "sketch").join(texts, "c")
    more = written(block_links(rest, shingle, percent), "more-links")
    labels = components(links.unionByName(more)) if not more.isEmpty() else labels

    named = classes.select("c", "digest", "doc_id").join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = named.join(smallest, "label").select("digest", "component_id")
    out = sketches.join(named, "digest", "left").select(
        "doc_id", "key", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
