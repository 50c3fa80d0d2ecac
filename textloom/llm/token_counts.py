"""Token counts by byte-pair merging on a heap and a linked list; no identifiers are made.

For vocabularies of the kind "byte-level BPE with word ends": texts are NFC-normalised and lower-cased, split into
words by a pattern, and each word's bytes are merged pair by pair. A word's count is its symbols minus its merges.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import documents

#: Code points that the vocabulary's white-space class leaves out though str.split() splits there.
ODD_SPACES = regex.compile("[\x1c-\x1f]")
SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class PairRanks:
    """Merge ranks of a vocabulary file, and the words seen so far with their counts."""

    def __init__(self, path: str, remembered: int = 500_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, ids = spec["model"], {}
        end = model["end_of_word_suffix"] or ""
        number = lambda s: ids.setdefault(s, len(ids))
        symbols = byte_symbols()
        self.inner = [number(s) for s in symbols]
        self.last = [number(s + end) for s in symbols]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[number(a), number(b)] = (rank, number(a + b))
        self.specials = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        self.remembered, self.young, self.old = remembered, {}, {}

    def merged(self, word: bytes) -> int:
        """Symbols left of one word once no adjacent pair has a rank."""
        symbol = [self.inner[b] for b in word]
        if not symbol:
            return 0
        symbol[-1] = self.last[word[-1]]
        n, get = len(symbol), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, m[1]) for i in range(n - 1) if (m := get((symbol[i], symbol[i + 1])))]
        heapq.heapify(heap)
        left = n
        while heap:
            rank, i, whole = heapq.heappop(heap)
            j = after[i]
            if symbol[i] < 0 or j >= n or (m := get((symbol[i], symbol[j]))) is None or m != (rank, whole):
                continue  # one of the pair has been merged meanwhile
            symbol[i], symbol[j] = whole, -1
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := get((whole, symbol[k])):
                    heapq.heappush(heap, (m[0], i, m[1]))
            if (h := before[i]) >= 0 and (m := get((symbol[h], whole))):
                heapq.heappush(heap, (m[0], h, m[1]))
        return left

    def _piece(self, piece: str) -> int:
        """Tokens of a text without white space; remembered in two generations, so memory stays bounded."""
        n = self.old.get(piece)
        if n is None:
            low = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
            n = sum(self.merged(w.encode()) for w in self.words.findall(low))
        if len(piece) <= 64:
            if len(self.young) >= self.remembered:
                self.young, self.old = {}, self.young
            self.young[piece] = n
        return n

    def count(self, text: str) -> int:
        """Tokens of a whole text; each special string in it is one token."""
        parts, total = self.specials.split(text), 0
        total += len(parts) - 1
        for part in parts:
            pieces = SPACE.split(part) if ODD_SPACES.search(part) else part.split()
            known = self.young.get
            for n, piece in zip(map(known, pieces), pieces, strict=True):
                total += self._piece(piece) if n is None else n
        return total


_loaded: dict[str, PairRanks] = {}


def ranks(path: str) -> PairRanks:
    """The vocabulary of this path, loaded once per Python worker."""
    if path not in _loaded:
        _loaded[path] = PairRanks(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit.

    Counts are those of the vocabulary's own library without begin or end tokens; special strings inside a text count
    as the special token. A null text is empty and has no tokens. No shuffle: each row is counted where it is read.
    """

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = ranks(vocabulary)
        for batch in rows:
            counts = [counter.count(t.as_py() or "") for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = documents(docs, id_col, text_col)
    rows = rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = rows.mapInArrow(batches, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
