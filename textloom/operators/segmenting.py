"""Words of text that is written without spaces: found in the corpus, and cut along the likeliest path.

Words are discovered by counting. Runs of letters give their character grams up to one more than a word may have; all
else follows from these counts, as the grams that are longer by one tell what stands on either side. A gram is a word if
it is frequent, its parts stand together more often than by chance (pointwise mutual information, for its weakest
split), and what stands beside it varies (entropy of the neighbours, on the less varied side).

Texts are cut by a Viterbi path: of all ways to cut a run into words and single characters the one of the highest product
of word frequencies, found with an automaton of the vocabulary from the run's end to its start.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import filters
from textloom.functions.text import WORD, by_text
from textloom.sources.shared import written

#: Letters of scripts that put no space between words.
UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]+"
_JVM_UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]+"
#: Characters of runs that a task gathers before it counts their grams, places counted at once, and grams sent at once.
HELD_GRAMS, PIECE, SENT_GRAMS = 2_000_000, 2_000_000, 100_000
#: Words that a vocabulary takes at most, the most frequent first.
MOST_WORDS = 200_000
#: Letters in a 64-bit key, and the bits of each.
KEY_LETTERS, LETTER_BITS = 3, 21


@dataclass(frozen=True)
class Found:
    """What makes a gram a word."""

    longest: int = 4
    least: int = 5
    cohesion: float = 3.0
    freedom: float = 1.0


def runs(docs: DataFrame, text_col: str = "text", pattern: str = _JVM_UNSPACED) -> DataFrame:
    """(run) of each unspaced stretch; null texts have none."""
    return docs.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0))).alias("run"))


def _packed(columns: Sequence[np.ndarray], keys: int) -> list[np.ndarray]:
    """So many 64-bit keys for the grams whose code points these columns hold; a place without a letter is 0."""
    out = [np.zeros(len(columns[0]), np.int64) for _ in range(keys)]
    for j, column in enumerate(columns):
        out[j // KEY_LETTERS] |= (column.astype(np.int64) + 1) << LETTER_BITS * (KEY_LETTERS - 1 - j % KEY_LETTERS)
    return out


def _unpacked(keys: Sequence[np.ndarray]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """The grams of _packed() keys, by their number of letters: their places and they."""
    shifts = [LETTER_BITS * j for j in reversed(range(KEY_LETTERS))]
    letters = np.stack([(key >> shift) & ((1 << LETTER_BITS) - 1) for key in keys for shift in shifts], 1)
    sizes = np.count_nonzero(letters, 1)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        text = (letters[at, :size] - 1).astype("<u4").tobytes().decode("utf-32-le")
        yield at, [text[i : i + size] for i in range(0, len(text), size)]


def _distinct(codes: np.ndarray, at: np.ndarray, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct grams of so many characters at these places, a column a character, with their numbers."""
    alphabet = np.flatnonzero(np.bincount(codes))
    dense = np.zeros(alphabet[-1] + 1, np.int64)
    dense[alphabet] = np.arange(len(alphabet))
    columns, space = [dense[codes[at + j]] for j in range(size)], len(alphabet) ** size
    if space < 1 << 63:
        keys = columns[0]
        for column in columns[1:]:
            keys = keys * len(alphabet) + column
        if space <= len(keys):
            counts = np.bincount(keys)
            keys = np.flatnonzero(counts)
            n = counts[keys]
        else:
            keys, n = np.unique(keys, return_counts=True)
        columns = []
        for _ in range(size):
            keys, digit = np.divmod(keys, len(alphabet))
            columns.insert(0, digit)
    else:
        rows, n = np.unique(np.stack(columns, 1), axis=0, return_counts=True)
        columns = list(rows.T)
    return [alphabet[c] for c in columns], n


def _hashes(columns: Sequence[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each gram whose characters these columns hold, as signed integers."""
    h = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        h = (h ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _gram_filter(grams: DataFrame, size: int) -> Broadcast:
    """A filter of the column gram, whose grams have so many characters; bounded, as filters are."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.frombuffer("".join(batch.column("gram").to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, size)
            yield pa.record_batch([pa.array(_hashes(codes.T))], ["h"])

    return grams.sparkSession.sparkContext.broadcast(filters.fitted_filter(grams.select("gram").mapInArrow(hashed, "h long")))


def _counted(run_rows: DataFrame, sizes: Sequence[int], bound: Broadcast | None = None, often: Broadcast | None = None, least: int = 1) -> DataFrame:
    """(gram, n, heads, tails) of all grams of these sizes in the column run, counted in the task before the shuffle.

    Grams are numbers until they are counted, and become strings afterwards: those that occur least times, and heads and tails.

    With bound, a filter of grams that are shorter by one, only those that begin or end with one of these (heads, tails), and
    with often, another, those whose both parts are in that. A filter passes a gram everywhere or nowhere, so counts are whole.
    """

    names = [f"key{i}" for i in range(-(-max(sizes) // KEY_LETTERS))]

    def counted(codes: np.ndarray, left: np.ndarray) -> Iterator[pa.RecordBatch]:
        for size in sizes:
            for a in range(0, len(codes), PIECE):
                at = np.flatnonzero(left[a : a + PIECE] >= size) + a
                groups = [(at, True, True)]
                if bound is not None:
                    part = [_hashes([codes[at + i + j] for j in range(size - 1)]) for i in (0, 1)]
                    head, tail = (filters.passed(h, bound.value) for h in part)
                    both = np.zeros(len(at), bool) if often is None else filters.passed(part[0], often.value) & filters.passed(part[1], often.value)
                    groups = [(at[head & tail], True, True), (at[head & ~tail], True, False), (at[tail & ~head], False, True), (at[both & ~head & ~tail], False, False)]
                for places, heads, tails in groups:
                    if len(places):
                        columns, n = _distinct(codes, places, size)
                        made = pa.record_batch([*map(pa.array, _packed(columns, len(names))), pa.array(n, pa.int64()), *(pa.array(np.full(len(n), x)) for x in (heads, tails))], [*names, "n", "heads", "tails"])
                        for i in range(0, len(n), SENT_GRAMS):
                            yield made.slice(i, SENT_GRAMS)

    def gathered(held: list[str]) -> Iterator[pa.RecordBatch]:
        codes = np.frombuffer("".join(held).encode("utf-32-le"), np.uint32)
        sizes_of = np.fromiter(map(len, held), np.int64, len(held))
        return counted(codes, np.repeat(np.cumsum(sizes_of), sizes_of) - np.arange(len(codes)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, letters = [], 0
        for batch in batches:
            for run in batch.column("run").to_pylist():
                if run:
                    held.append(run)
                    letters += len(run)
                if letters > HELD_GRAMS:
                    yield from gathered(held)
                    held, letters = [], 0
        yield from gathered(held)

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, grams in _unpacked([batch.column(name).to_numpy() for name in names]) if len(batch) else ():
                yield pa.record_batch([pa.array(grams, pa.string()), *(batch.column(c).take(pa.array(at)) for c in ("n", "heads", "tails"))], ["gram", "n", "heads", "tails"])

    rest = "n long, heads boolean, tails boolean"
    made = run_rows.select("run").mapInArrow(count, ", ".join([*(f"{name} long" for name in names), rest]))
    # Tasks have counted already; a second count of theirs before the shuffle would merge little and spill.
    sums = made.repartition(*names).groupBy(*names, "heads", "tails").agg(F.sum("n").alias("n"))
    if least > 1:
        sums = sums.where((F.col("n") >= least) | F.col("heads") | F.col("tails"))
    return sums.mapInArrow(spelt, f"gram string, {rest}")


def gram_counts(run_rows: DataFrame, longest: int) -> DataFrame:
    """(gram, n) of all grams up to so many characters of the column run."""
    return _counted(run_rows, range(1, longest + 1)).select("gram", "n")


def _entropy(counts: DataFrame, wider: DataFrame, inner: Column, name: str) -> DataFrame:
    """(gram, name): entropy of the characters by which the wider grams exceed gram, the run's edge taken as one of them."""
    beside = wider.select(inner.alias("gram"), F.col("n").alias("m")).groupBy("gram").agg(F.sum("m").alias("inside"), F.sum(F.col("m") * F.log("m")).alias("logs"))
    joined = counts.select("gram", "n").join(beside, "gram", "left")
    edge = F.col("n") - F.coalesce("inside", F.lit(0))
    logs = F.coalesce("logs", F.lit(0.0)) + F.when(edge > 0, edge * F.log(edge)).otherwise(0.0)
    return joined.select("gram", F.greatest(F.log("n") - logs / F.col("n"), F.lit(0.0)).alias(name))


def _bound(counts: DataFrame, least_size: int, most_size: int, found: Found) -> DataFrame:
    """(gram, n, cohesion) of the grams of these sizes that are frequent and whose parts stand together; written."""
    size = F.length("gram")
    total = counts.where(size == 1).agg(F.sum("n").alias("total"))
    counts = counts.where(F.col("n") >= found.least)  # so are all parts of such grams
    often = counts.where((size >= least_size) & (size <= most_size))
    splits = often.select("gram", "n", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    halves = splits.select("gram", "n", F.substr("gram", F.lit(1), F.col("k")).alias("head"), F.substr("gram", F.col("k") + 1).alias("tail"))
    part = lambda name: counts.where(size < most_size).select(F.col("gram").alias(name), F.col("n").alias(f"{name}_n"))
    tied = halves.join(part("head"), "head").join(part("tail"), "tail").crossJoin(F.broadcast(total))  # one number
    tied = tied.groupBy("gram", "n").agg(F.min(F.log(F.col("n") * F.col("total") / (F.col("head_n") * F.col("tail_n")).cast("double"))).alias("cohesion"))
    return written(tied.where(F.col("cohesion") >= found.cohesion), "bound-grams")  # read for itself, for either side and for a filter


def discovered(run_rows: DataFrame, found: Found = Found()) -> DataFrame:
    """(word, n, cohesion, freedom): words of two characters or more, and single characters with 0 in both measures.

    Runs are those of runs(), or any column run of strings. Without any the result is empty. Every run is counted; only
    grams, not texts, are shuffled. Up to three characters all grams are counted; longer ones level by level, those that can
    be words, as their parts are frequent, and those that tell what stands beside a bound gram.
    """
    run_rows = written(run_rows.select("run"), "runs")  # read once a level
    full = min(3, found.longest + 1)
    counts = written(_counted(run_rows, range(1, full + 1)), "gram-counts")
    tied = _bound(counts, 2, min(full, found.longest), found)
    size = F.length("gram")
    for k in range(full + 1, found.longest + 2):
        often = counts.where((size == k - 1) & (F.col("n") >= found.least)) if k <= found.longest else None
        more = _counted(run_rows, [k], _gram_filter(tied.where(size == k - 1), k - 1), often and _gram_filter(often, k - 1), found.least)
        counts = counts.unionByName(written(more, "gram-counts"))
        if k <= found.longest:
            tied = tied.unionByName(_bound(counts, k, k, found))
    wider = counts.where(size >= 3)
    right = _entropy(tied, wider.where("heads"), F.substr("gram", F.lit(1), size - 1), "right")
    left = _entropy(tied, wider.where("tails"), F.substr("gram", F.lit(2)), "left")
    free = tied.join(right, "gram").join(left, "gram").withColumn("freedom", F.least("right", "left")).where(F.col("freedom") >= found.freedom)
    single = counts.where(size == 1).select(F.col("gram").alias("word"), "n", F.lit(0.0).alias("cohesion"), F.lit(0.0).alias("freedom"))
    return free.select(F.col("gram").alias("word"), "n", "cohesion", "freedom").unionByName(single)


class Vocabulary:
    """Words with the logarithm of their frequency."""

    def __init__(self, words: dict[str, float], floor: float | None = None, pattern: str = UNSPACED):
        self.words, self.pattern = dict(words), pattern
        #: Weight of a character that is no word.
        self.floor = min(self.words.values(), default=0.0) - 1.0 if floor is None else floor

    def __getstate__(self):
        return self.words, self.pattern, self.floor

    def __setstate__(self, state):
        self.words, self.pattern, self.floor = state

    @cached_property
    def single(self) -> dict[str, float]:
        """The weights of words of one character."""
        return {word: weight for word, weight in self.words.items() if len(word) == 1}

    @cached_property
    def longer(self) -> ahocorasick.Automaton | None:
        """The other words, spelt backwards, with their length and weight."""
        made = ahocorasick.Automaton()
        for word, weight in self.words.items():
            if len(word) > 1:
                made.add_word(word[::-1], (len(word), weight))
        made.make_automaton()
        return made if len(made) else None

    @cached_property
    def _pieces(self) -> regex.Pattern:
        return regex.compile(rf"{self.pattern}|(?:(?!{self.pattern}){WORD})")

    @cached_property
    def _unspaced(self) -> regex.Pattern:
        return regex.compile(self.pattern)

    def cut(self, run: str) -> list[str]:
        """The run in words: the path of the largest sum of weights, and of equal ones that with the longer first word.

        Read from its end: best and step are of the run's last characters, and at each place the automaton gives the words that
        begin there, longer ones first.
        """
        back, floor = run[::-1], self.floor
        ones, best, step, p = [self.single.get(c, floor) for c in back], [0.0], [1] * len(run), 0
        for at, (k, weight) in self.longer.iter(back) if self.longer else ():
            while p <= at:
                best.append(ones[p] + best[p])
                p += 1
            total = weight + best[p - k]
            if total > best[p] or (total == best[p] and step[at] == 1):
                best[p], step[at] = total, k
        out, i, last = [], 0, len(run) - 1
        while i <= last:
            k = step[last - i]
            out.append(run[i : i + k])
            i += k
        return out

    def tokens(self, text: str | None) -> list[str]:
        """Runs of letters and digits as they are, and unspaced runs cut into words, in order."""
        out: list[str] = []
        for piece in self._pieces.findall(text or ""):
            out += self.cut(piece) if self._unspaced.match(piece) else (piece,)
        return out


def vocabulary(words: DataFrame, most: int = MOST_WORDS, terms: dict[str, int] | None = None, pattern: str = UNSPACED) -> Vocabulary:
    """The most frequent words of discovered(), with terms that are known beforehand and their counts.

    At most so many words, and only they, come to the driver; ties are taken in code point order.
    """
    rows = words.orderBy(F.desc("n"), "word").limit(most).select("word", "n").collect()
    counts = {r.word: r.n for r in rows} | (terms or {})
    total = math.log(sum(n for w, n in counts.items() if len(w) == 1) or sum(counts.values()) or 1)
    return Vocabulary({w: math.log(n) - total for w, n in counts.items()}, pattern=pattern)


def cutter(spark: SparkSession, vocab: Vocabulary) -> Callable[[str], list[str]]:
    """The tokens of a text, for the keyword operators; the vocabulary (its size is a parameter) is broadcast."""
    shared = spark.sparkContext.broadcast(vocab)
    return lambda text: shared.value.tokens(text)


def segmented(text: Column, cut: Callable[[str], list[str]]) -> Column:
    """array<string> of the tokens of each text; empty for null."""

    return by_text("array<string>", lambda t: cut(t) if t else [])(text)


def segmented_line(text: Column, cut: Callable[[str], list[str]], separator: str = " ") -> Column:
    """The tokens of each text in one string; empty for null."""

    return by_text("string", lambda t: separator.join(cut(t)) if t else "")(text)
