"""Token sequences of two tokenizers held against each other by the bytes that they cover.

Tokens of both are given by the ends of their byte ranges. Where the two end arrays agree at the present index shift they
run one to one: blocks of 1, 2, 4, ... ends are compared until one differs. The group that follows is resolved token by
token, and its tokens change the shift for the next stretch. A block of documents is walked in many lanes at a time, which
begin at the documents and inside long ones, so each step is one array operation for all lanes.

How often two tokens overlap is counted over all documents. A task cuts its documents into blocks of bounded bytes and
numbers the pairs of a block, so that the counts of pairs are asked for once a block and not once a document, and only they
and the documents' numbered pairs are shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import documents, slices, written
from textloom.llm.token_counts import byte_symbols

#: Text bytes of a block, unless one text has more.
BLOCK_BYTES = 4 << 20
#: Words of byte-level vocabularies (fixed).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARK = "▁"  # stands for a space
#: Tokens of a lane, about.
LANE = 64


class ByteLevel:
    """A byte-level vocabulary file, without special tokens: their strings are plain text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {symbol: b for b, symbol in enumerate(byte_symbols())}
        special = {t["content"] for t in spec["added_tokens"]}
        entries = {bytes(byte_of[c] for c in entry): i for entry, i in spec["model"]["vocab"].items() if entry not in special}
        made = [spec["model"]["vocab"]["".join(m)] for m in spec["model"]["merges"]]
        if made != sorted(made) or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("the ids of this vocabulary are not in the order of its merges")
        self.bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes[i] = entry
        self.entries = pa.array(self.bytes, pa.large_binary())
        self.encode = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=entries, special_tokens={}).encode_to_numpy


class Pieces:
    """A SentencePiece model, which puts a space before what it encodes."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.entries = pa.array(self.bytes, pa.large_binary())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


class Pair:
    """Both tokenizers, with the length of each token and its name behind each separator of a group's text."""

    def __init__(self, byte_level: str, pieces: str):
        self.first, self.second = ByteLevel(byte_level), Pieces(pieces)
        self.sizes = [np.array(list(map(len, x.bytes)), np.int64) for x in (self.first, self.second)]
        numbers = range(max(map(len, self.sizes)))
        #: `n,` for each n, then `n|`, `n;` and `n`.
        self.names, self.stride = pa.array([f"{n}{mark}" for mark in (",", "|", ";", "") for n in numbers]), len(numbers)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the ids of a space and the text; none where it is empty or the tokens' joined bytes differ from it."""
        whole = [(" " + t).encode() for t in texts]
        both = [self.first.encode(" " + t) for t in texts], [np.array(x, np.uint32) for x in self.second.encode(texts)]
        good = [bool(t) for t in texts]
        for kind, found in zip((self.first, self.second), both, strict=True):
            joined = kind.entries.take(pa.array(np.concatenate(found)))
            ends = np.frombuffer(joined.buffers()[1], np.int64)[np.append(0, np.cumsum(list(map(len, found))))]
            data = memoryview(joined.buffers()[2] or b"").cast("B")  # unsigned, as bytes are
            good = [g and data[i:j] == w for g, i, j, w in zip(good, ends[:-1].tolist(), ends[1:].tolist(), whole, strict=True)]
        none = np.empty(0, np.uint32)
        return [(a, b) if g else (none, none) for g, a, b in zip(good, *both, strict=True)]


_loaded: dict[tuple[str, str], Pair] = {}


def loaded(byte_level: str, pieces: str) -> Pair:
    """The tokenizers of these files, loaded once per Python worker."""
    if (byte_level, pieces) not in _loaded:
        _loaded[byte_level, pieces] = Pair(byte_level, pieces)
    return _loaded[byte_level, pieces]


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of a and of b end a group, that is at an end of both.

    Both arrays ascend strictly and have the same last end. starts: tokens of a that begin where a token of b does.
    """
    n, most = len(ends_a), 64
    cut_a, cut_b = np.zeros(n + most, bool), np.zeros(len(ends_b) + most, bool)
    a, b = np.append(ends_a, np.full(most, -1)), np.append(ends_b, np.full(most, -2))
    i, until = starts, np.append(starts[1:], n)
    j = np.searchsorted(ends_b, np.where(i > 0, a[i - 1], 0), "right")
    while len(i):
        probing, width = np.arange(len(i)), 1
        while len(probing):
            steps = np.arange(width)
            at_a, at_b = i[probing, None] + steps, j[probing, None] + steps
            # A lane may look into the next one, where equal ends are ends of groups just as well.
            same = np.logical_and.accumulate(a[at_a] == b[np.minimum(at_b, len(b) - 1)], axis=1)
            cut_a[at_a[same]], cut_b[at_b[same]] = True, True
            run = same.sum(axis=1)
            i[probing] += run
            j[probing] += run
            probing = probing[(run == width) & (i[probing] < until[probing])]
            width = min(2 * width, most)
        on = i < until
        i, j, until = i[on], j[on], until[on]
        apart = np.arange(len(i))
        while len(apart):
            behind = a[i[apart]] < b[j[apart]]
            i[apart] += behind
            j[apart] += ~behind
            apart = apart[a[i[apart]] != b[j[apart]]]
        cut_a[i], cut_b[j] = True, True
        i, j = i + 1, j + 1
        on = i < until
        i, j, until = i[on], j[on], until[on]
    return cut_a[:n], cut_b[: len(ends_b)]


def lanes(ends_a: np.ndarray, ends_b: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Tokens of a at which a lane may begin: the first of each document, and about every LANE-th if one of b begins there too."""
    tried = np.arange(LANE, len(ends_a), LANE)
    before = ends_a[tried - 1]
    return np.union1d(first, tried[ends_b[np.searchsorted(ends_b, before)] == before])


@dataclass
class Aligned:
    """The groups and links of a block of documents; of each document the numbers of them, tokens of a and tokens of b."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: pa.Array
    link_doc: np.ndarray
    link: np.ndarray


def aligned(pair: Pair, ids: list[tuple[np.ndarray, np.ndarray]]) -> Aligned:
    """The tokens of a block's documents held against each other; links are a * 2**32 + b."""
    n_docs = len(ids)
    n_a, n_b = (np.array([len(x[k]) for x in ids], np.int64) for k in range(2))
    ids_a, ids_b = (np.concatenate([x[k] for x in ids]).astype(np.int64) for k in range(2))
    doc_a, doc_b = np.repeat(np.arange(n_docs), n_a), np.repeat(np.arange(n_docs), n_b)
    if not len(ids_a):
        none = np.empty(0, np.int64)
        return Aligned(n_a, n_b, np.zeros(n_docs, np.int64), pa.array([""] * n_docs, pa.large_string()), none, none)
    ends_a, ends_b = (size[x].cumsum() for size, x in zip(pair.sizes, (ids_a, ids_b), strict=True))
    first = np.unique((n_a.cumsum() - n_a)[n_a > 0])
    cut_a, cut_b = common_ends(ends_a, ends_b, lanes(ends_a, ends_b, first))
    group_a, group_b = cut_a.cumsum() - cut_a, cut_b.cumsum() - cut_b
    in_a, in_b = np.bincount(group_a), np.bincount(group_b)
    # The text of the groups: tokens of a then of b, each with the mark that follows it.
    last = np.zeros(len(ids_b), bool)
    last[(n_b.cumsum() - 1)[n_b > 0]] = True
    said = np.empty(len(ids_a) + len(ids_b), np.int64)
    said[np.arange(len(ids_a)) + (in_b.cumsum() - in_b)[group_a]] = ids_a + pair.stride * cut_a
    said[np.arange(len(ids_b)) + in_a.cumsum()[group_b]] = ids_b + pair.stride * (2 * cut_b + last)
    text = pair.names.take(pa.array(said)).cast(pa.large_string())
    ends = np.frombuffer(text.buffers()[1], np.int64)[: len(said) + 1][np.append(0, (n_a + n_b).cumsum())]
    groups = pa.LargeStringArray.from_buffers(n_docs, pa.py_buffer(ends.tobytes()), text.buffers()[2])
    # One to one, or each stretch between the ends of both inside a group of more tokens.
    single = (in_a == 1) & (in_b == 1)
    one_a, one_b = single[group_a], single[group_b]
    points = np.union1d(ends_a[~one_a], ends_b[~one_b])
    at_a = np.append(np.flatnonzero(one_a), np.searchsorted(ends_a, points))
    at_b = np.append(np.flatnonzero(one_b), np.searchsorted(ends_b, points))
    return Aligned(n_a, n_b, np.bincount(doc_a[cut_a], minlength=n_docs), groups, doc_a[at_a], (ids_a[at_a] << 32) | ids_b[at_b])


def packed(numbers: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending numbers and a count for each."""
    return zstandard.compress(np.diff(numbers, prepend=0).astype("<u4").tobytes() + counts.astype("<u4").tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = np.frombuffer(zstandard.decompress(data), "<u4").reshape(2, -1).astype(np.int64)
    return steps.cumsum(), counts


def align(docs: DataFrame, byte_level: str, pieces: str, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, groups, and what with_link_counts() needs.

    A space and the text are encoded by the byte-level vocabulary (a), the text by the SentencePiece model (b), which adds the
    space. Byte offsets at which tokens of both end cut them into groups, `a1,a2|b1;a3|b2,b3`; links are the pairs of token
    occurrences that share a byte. Texts that are null or empty, or whose joined token bytes are not the space and the text,
    have no tokens: zeros and an empty string. Rows of one id stay apart. No shuffle; an empty table gives an empty result.

    block, links (null without any), pairs and totals (in the first row of a block) belong together and to one evaluation.
    """
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, block long, links binary, pairs array<long>, totals array<long>"

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = loaded(byte_level, pieces)
        block = TaskContext.get().partitionId() << 32
        for batch in rows:
            for part in slices(batch, "text", block_bytes):
                of = aligned(pair, pair.encode([t or "" for t in part.column("text").to_pylist()]))
                n_docs = len(part)
                pairs, number = np.unique(of.link, return_inverse=True)
                # The distinct numbered pairs of each document, in order, and how often it has them.
                each, counts = np.unique(of.link_doc * max(len(pairs), 1) + number, return_counts=True)
                cuts = np.searchsorted(each, np.arange(1, n_docs) * max(len(pairs), 1))
                own = [packed(x % len(pairs), c) if len(x) else None for x, c in zip(np.split(each, cuts), np.split(counts, cuts), strict=True)]
                rest = [None] * (n_docs - 1)
                columns = [part.column("doc_id"), *map(pa.array, (of.n_a, of.n_b, of.n_groups, np.bincount(of.link_doc, minlength=n_docs))), of.groups.cast(pa.string())]
                columns += [pa.array([block] * n_docs, pa.int64()), pa.array(own, pa.binary())]
                columns += [pa.array([x, *rest], pa.list_(pa.int64())) for x in (pairs, np.bincount(number, minlength=len(pairs)))]
                yield pa.record_batch(columns, [c.split()[0] for c in schema.split(", ")])
                block += 1

    return documents(docs, id_col, text_col).mapInArrow(batches, schema)


def link_counts(aligned: DataFrame) -> DataFrame:
    """(pair, a, b, n, best): how many links hold ids a and b, and whether no other a has more with this b."""
    counts = aligned.select(F.explode(F.arrays_zip("pairs", "totals")).alias("of")).groupBy(F.col("of.pairs").alias("pair")).agg(F.sum("of.totals").alias("n"))
    ids = [F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b")]
    counts = written(counts.select("pair", *ids, "n"), "pair-counts")
    top = counts.groupBy("b").agg(F.max("n").alias("top"))
    return counts.join(top, "b").select("pair", "a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def with_link_counts(aligned: DataFrame) -> DataFrame:
    """The rows of align() (without some columns, or with others) with n_best and count_sum in place of its inner columns.

    count_sum adds the corpus-wide counts of a row's links; n_best counts those links whose count is the highest of their b.
    """
    rows = written(aligned, "aligned")  # blocks belong to one evaluation
    asked = rows.select("block", F.posexplode("pairs").alias("at", "pair"))
    answers = asked.join(link_counts(rows).select("pair", "n", "best"), "pair").select(F.col("block").alias("of_block"), "at", "n", "best")
    kept = [c for c in rows.columns if c not in ("pairs", "totals")]
    names = [c for c in kept if c not in ("block", "links")]

    def scored(own: pa.Table, known: pa.Table) -> pa.Table:
        at = known.column("at").to_numpy()
        n, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        n[at], best[at] = known.column("n").to_numpy(), known.column("best").to_numpy().astype(np.int64)
        sums = []
        for data in own.column("links").to_pylist():
            numbers, counts = unpacked(data) if data else (np.empty(0, np.int64),) * 2
            sums.append((int((best[numbers] * counts).sum()), int((n[numbers] * counts).sum())))
        made = [pa.array([s[k] for s in sums], pa.int64()) for k in range(2)]
        return pa.table([*(own.column(c) for c in names), *made], names=[*names, "n_best", "count_sum"])

    types = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in names) + ", n_best long, count_sum long"
    return rows.select(*kept).groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(scored, schema)
