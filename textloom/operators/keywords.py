"""Keywords of documents: token filters, ranking, TF-IDF, co-occurrence rank, groups and density.

Words are counted and ranked inside the row, so no token is shuffled and rows of one id stay apart. The
functions on (doc_id, pos, word) rows do the same for tokens that come from elsewhere.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.lexicons import Lexicon
from textloom.functions.text import WORD, by_text, contains_any, word_tokens, ws_tokens
from textloom.sources.shared import written

_in_word = regex.compile(WORD).fullmatch
_ASCII = re.compile("[a-zA-Z]+")
COUNTS = "array<struct<word: string, n: bigint, pos: int>>"
#: Words that a task holds before it passes them on, besides those of one text.
HELD_WORDS = 100_000
#: Most frequent words whose document frequencies every task of tfidf() holds.
KNOWN_WORDS = 100_000
#: Scores of words are compared with so much to spare, as they are rounded to 9 digits.
SLACK = 1e-8
RANKS = "array<struct<word: string, score: double>>"


class Kept(dict):
    """Code points of words as they are, others as a blank; each is looked at when it first comes."""

    def __missing__(self, point: int) -> int:
        self[point] = out = point if _in_word(chr(point)) else 32
        return out


_KEPT = Kept()


def words_of(text: str) -> list[str]:
    """Runs of letters and digits: what is left between blanks, which takes half the time of looking for the pattern."""
    return text.translate(_KEPT).split()


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, word) of each token; documents without tokens have no rows."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(word_tokens(F.coalesce(F.col(text_col), F.lit("")))).alias("pos", "word"))


def is_keyword(word: Column, lexicon: Lexicon) -> Column:
    """Longer than one character, no stop word, not all digits and, if the lexicon says so, not plain ASCII letters."""
    good = (F.length(word) > 1) & ~word.isin(*lexicon.stopwords) & ~word.rlike(r"^\p{Nd}+$")
    return good & ~word.rlike("^[a-zA-Z]+$") if lexicon.drop_ascii else good


def keyword_rule(lexicon: Lexicon) -> Callable[[str], bool]:
    """is_keyword() for one word."""
    stop, drop = frozenset(lexicon.stopwords), lexicon.drop_ascii
    return lambda w: len(w) > 1 and w not in stop and not w.isdecimal() and not (drop and _ASCII.fullmatch(w))


def plain_rule(lexicon: Lexicon) -> Callable[[str], bool]:
    """Two characters or more and no stop word; for ranking by frequency alone."""
    stop = frozenset(lexicon.stopwords)
    return lambda w: len(w) > 1 and w not in stop


def most_frequent(words: list[str], rule: Callable[[str], bool], k: int | None) -> list[tuple[str, int]]:
    """(word, n) of the k most frequent words that rule takes; earlier ones first among equals."""
    return sorted(((w, n) for w, n in Counter(words).items() if rule(w)), key=lambda x: -x[1])[:k]


def ranked_words(text: Column, rule: Callable[[str], bool], k: int | None = None, cut: Callable[[str], list[str]] = words_of) -> Column:
    """array of (word, n, pos): the k most frequent words that rule takes, or all; earlier ones first among equals.

    cut gives the words of a text in lower case: runs of letters and digits, or those of segmenting.cutter().
    """

    def one(t):
        if not t:
            return []
        every = cut(t)
        first = {w: len(every) - 1 - i for i, w in enumerate(reversed(every))}
        return [{"word": w, "n": n, "pos": first[w]} for w, n in most_frequent(every, rule, k)]

    return by_text(COUNTS, one)(F.lower(text))


def counted(words: DataFrame) -> DataFrame:
    """(doc_id, word, n, pos) with the first position; counts are combined before the shuffle."""
    return words.groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))


def top_keywords(words: DataFrame, k: int = 20) -> DataFrame:
    """(doc_id, rank, word, n): the k most frequent words of each document, earlier ones first among equals."""
    ranked = counted(words).withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("n"), "pos")))
    return ranked.where(F.col("rank") <= k).select("doc_id", "rank", "word", "n")


def top_words(docs: DataFrame, rule: Callable[[str], bool], k: int = 20, id_col: str = "doc_id", text_col: str = "text", cut: Callable[[str], list[str]] = words_of) -> DataFrame:
    """(doc_id, rank, word, n) of each document's text, a row per word; rows that repeat an id are ranked apart."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(ranked_words(F.col(text_col), rule, k, cut)).alias("at", "of"))
    return rows.select("doc_id", (F.col("at") + 1).alias("rank"), "of.word", "of.n")


def keyword_arrays(docs: DataFrame, lexicon: Lexicon, k: int = 20, text_col: str = "text", cut: Callable[[str], list[str]] = words_of) -> DataFrame:
    """docs with a column keywords, ranked; an empty array where a document has none."""
    return docs.withColumn("keywords", F.transform(ranked_words(F.col(text_col), keyword_rule(lexicon), k, cut), lambda x: x["word"]))


def word_frequencies(texts: DataFrame, rule: Callable[[str], bool], cut: Callable[[str], list[str]] = words_of) -> DataFrame:
    """(word, df) of (text): in how many rows each word stands that rule takes. Words are counted per task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def made() -> pa.RecordBatch:
            words = [w for w in held if rule(w)]
            out = pa.record_batch([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for t in batch.column("text"):
                held.update(set(cut(t.as_py() or "")))
                if len(held) > HELD_WORDS:
                    yield made()
        yield made()

    return texts.select(F.lower("text").alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("df"))


def frequent_words(dfs: DataFrame, most: int) -> tuple[dict[str, int], int]:
    """The words of the highest document frequencies with these, so many at most, and the highest frequency of the others: 0 if none is left."""
    taken, rest = 0, 0
    for n, words in sorted(map(tuple, dfs.groupBy("df").count().collect()), reverse=True):
        if taken + words > most:
            rest = n
            break
        taken += words
    return dict(map(tuple, dfs.where(F.col("df") > rest).select("word", "df").collect())), rest


def likely_words(rows: DataFrame, n_docs: int, k: int, known: Broadcast, rest: int, rule: Callable[[str], bool], cut: Callable[[str], list[str]] = words_of) -> DataFrame:
    """(doc_id, row, word, share, pos, df) of (doc_id, row, text): the words that may be among the text's k best, with their share of all
    words that rule takes and their place among these; df is 0 for words that are not known.

    Unknown words stand in 1 to rest documents, which bounds their scores. A word is left out only if its score is under k others by
    more than scores are rounded. Rows leave a task in pieces of bounded size.
    """

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dfs = known.value
        for batch in batches:
            owner, words, parts, places, found = [], [], [], [], []

            def made(batch=batch, owner=owner, words=words, parts=parts, places=places, found=found) -> pa.RecordBatch:
                at = pa.array(owner, pa.int64())
                out = [batch.column("doc_id").take(at), batch.column("row").take(at), pa.array(words, pa.string())]
                out += [pa.array(parts, pa.float64()), pa.array(places, pa.int32()), pa.array(found, pa.int64())]
                for x in (owner, words, parts, places, found):
                    x.clear()
                return pa.record_batch(out, ["doc_id", "row", "word", "share", "pos", "df"])

            for i, t in enumerate(batch.column("text")):
                counts = [(w, n, dfs.get(w, 0)) for w, n in Counter(cut(t.as_py() or "")).items() if w in dfs or rule(w)]  # by first place
                if not counts:
                    continue
                share = np.array([n for _, n, _ in counts], np.float64)
                share /= share.sum()
                df = np.array([d for _, _, d in counts], np.int64)
                kept = range(len(counts))
                if len(counts) > k:
                    highest, lowest = (share * np.log(n_docs / np.where(df > 0, df, d)) for d in (1, max(rest, 1)))
                    kept = np.flatnonzero(highest >= np.partition(lowest, -k)[-k] - SLACK).tolist()
                owner += [i] * len(kept)
                words += [counts[j][0] for j in kept]
                parts += [float(share[j]) for j in kept]
                places += kept
                found += [counts[j][2] for j in kept]
                if len(words) > HELD_WORDS:
                    yield made()
            yield made()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "row", F.lower("text").alias("text")).mapInArrow(likely, f"doc_id {kind}, row long, word string, share double, pos int, df long")


def tfidf(docs: DataFrame, n_docs: int, lexicon: Lexicon, k: int = 30, id_col: str = "doc_id", text_col: str = "text", cut: Callable[[str], list[str]] = words_of, known_words: int = KNOWN_WORDS) -> DataFrame:
    """(doc_id, rank, word, score): score is term frequency times ln(n_docs / document frequency).

    Texts are read twice: for the document frequencies of all words, and for the words that may be among a document's k best. Tasks
    know the frequencies of known_words words; the others are joined, and as none of them stands in many documents, no key is heavy.
    Only words that may be among the k best are written, joined and ranked, which loses none. Rows that repeat an id are ranked apart.
    """
    rule, spark = keyword_rule(lexicon), docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    dfs = written(word_frequencies(texts, rule, cut), "word-frequencies")
    known, rest = frequent_words(dfs, known_words)
    rows = written(likely_words(texts, n_docs, k, spark.sparkContext.broadcast(known), rest, rule, cut), "likely-words")
    rare = rows.where("df = 0").drop("df").hint("merge").join(dfs.where(F.col("df") <= rest), "word")
    scored = rows.where("df > 0").unionByName(rare).withColumn("score", F.round(F.col("share") * F.log(F.lit(float(n_docs)) / F.col("df")), 9))
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("doc_id", "row").orderBy(F.desc("score"), "pos")))
    return ranked.where(F.col("rank") <= k).select("doc_id", "rank", "word", "score")


def cooccurrence_scores(words: list[str], window: int = 4, iterations: int = 5, damping: float = 0.85) -> dict[str, float]:
    """Words scored by the words within a window of them, after fixed iterations; those without other company have none."""
    number: dict[str, int] = {}
    at = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    n = len(number)
    pairs = [(at[:-i], at[i:]) for i in range(1, min(window, len(at) - 1) + 1)]
    if not pairs:
        return {}
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    a, b = np.concatenate([a, b])[np.tile(a != b, 2)], np.concatenate([b, a])[np.tile(a != b, 2)]
    if not len(a):
        return {}
    share = 1 / np.bincount(a, minlength=n)[a]
    score = np.ones(n)
    for _ in range(iterations):
        score = 1 - damping + damping * np.bincount(b, share * score[a], n)
    joined = np.bincount(a, minlength=n) > 0
    return {w: float(score[i]) for w, i in number.items() if joined[i]}


def best_company(words: list[str], window: int, k: int) -> list[tuple[str, float]]:
    """(word, score) of the k words of the highest co-occurrence score, in alphabetical order among equals."""
    scores = cooccurrence_scores(words, window)
    least = np.partition(np.fromiter(scores.values(), float, len(scores)), -k)[-k] - SLACK if len(scores) > k else -np.inf
    return sorted(((w, v) for w, v in scores.items() if v >= least), key=lambda x: (-round(x[1], 9), x[0].encode()))[:k]


def ranked_by_company(text: Column, rule: Callable[[str], bool], k: int = 20, window: int = 4, cut: Callable[[str], list[str]] = words_of) -> Column:
    """array of (word, score): the k words of the highest co-occurrence score, in alphabetical order among equals."""

    def one(t):
        best = best_company([w for w in cut(t or "") if rule(w)], window, k)
        return [{"word": w, "score": round(v, 6)} for w, v in best]

    return by_text(RANKS, one)(F.lower(text))


def textrank(docs: DataFrame, lexicon: Lexicon, k: int = 20, window: int = 4, id_col: str = "doc_id", text_col: str = "text", cut: Callable[[str], list[str]] = words_of) -> DataFrame:
    """(doc_id, rank, word, score): words of each document ranked by co-occurrence within a window."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(ranked_by_company(F.col(text_col), keyword_rule(lexicon), k, window, cut)).alias("at", "of"))
    return rows.select("doc_id", (F.col("at") + 1).alias("rank"), "of.word", "of.score")


def united(text: Column, rule: Callable[[str], bool], frequent: int = 30, company: int = 20, window: int = 4, cut: Callable[[str], list[str]] = words_of) -> Column:
    """array<string>: the words of ranked_words(), then those of ranked_by_company() that are not among them. The text is cut once; the
    result is a column of Python, which later expressions name without making it again. Empty for null."""

    def one(t):
        every = cut(t or "")
        taken = {w for w in set(every) if rule(w)}
        every = [w for w in every if w in taken]
        return list(dict.fromkeys(w for w, _ in most_frequent(every, taken.__contains__, frequent) + best_company(every, window, company)))

    return by_text("array<string>", one)(F.lower(text))


def having(words: Column, terms, without=()) -> Column:
    """The words with one of the terms in them and none of those in without."""
    return F.filter(words, lambda k: contains_any(k, terms) & ~contains_any(k, without))


def grouped(keywords: Column, lexicon: Lexicon, cap: int = 5) -> dict[str, Column]:
    """core and the lexicon's groups; a keyword goes to the first group with a term in it."""
    out: dict[str, Column] = {}
    earlier: tuple[str, ...] = ()
    for name, terms in lexicon.groups:
        out[name] = F.slice(having(keywords, terms, earlier), 1, cap)
        earlier += terms
    return {"core": F.slice(F.filter(keywords, lambda k: ~contains_any(k, earlier)), 1, cap)} | out


def overlapping(keywords: Column, lexicon: Lexicon, known_domain: Column) -> dict[str, Column]:
    """The lexicon's overlapping groups, filled only where the domain is known, and the keywords in none of them."""
    none = F.array().cast("array<string>")
    out = {name: F.when(known_domain, having(keywords, terms)).otherwise(none) for name, terms in lexicon.overlapping_groups}
    every = [t for _, ts in lexicon.overlapping_groups for t in ts]
    return out | {lexicon.remainder: F.when(known_domain, F.filter(keywords, lambda k: ~contains_any(k, every))).otherwise(keywords)}


def density(keywords: Column, text: Column) -> Column:
    return F.size(keywords) / F.greatest(F.size(ws_tokens(text)), F.lit(1)) * 100


def unique_tokens(text: Column) -> Column:
    return F.size(F.array_distinct(ws_tokens(text)))

