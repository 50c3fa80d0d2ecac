"""Language identification with bit-sliced Bloom filters over character n-grams.

One table of slots serves all languages: bit l of a slot belongs to language l, so a lookup returns the set of all
languages whose filter holds an n-gram. Hits per language are counted over the whole text, corrected for each filter's
false-positive rate, and the language with the largest corrected share wins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import documents, quoted

#: n-grams of this many characters; one space stands for each run of other characters than letters.
ORDER = 3
#: Rows for each language, in expectation, that the filters are learned from.
SAMPLE_PER_LANGUAGE = 1500
#: A language's filter takes the n-grams that at least this share of its sampled texts hold.
MIN_SHARE = 0.01
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether each code point is a letter; made once per worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def ngram_codes(text: str, order: int = ORDER) -> np.ndarray:
    """A 64-bit code for each n-gram of the lower-cased text, in order; none if there is no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(letter_table()[points], points, np.uint32(32))
    if not (points != 32).any():
        return np.empty(0, np.uint64)
    gaps = points == 32
    points = np.concatenate([[32], points[~(gaps & np.concatenate([[True], gaps[:-1]]))], [32]]).astype(np.uint64)
    codes = points[: len(points) - order + 1].copy()
    for k in range(1, order):
        codes *= np.uint64(0x100000001B3)
        codes += points[k : len(points) - order + 1 + k]
    return codes


@dataclass
class LanguageFilters:
    """slots[i] has bit l if an n-gram of language l falls on it; sixty-four languages to a plane."""

    languages: list[str]
    slots: np.ndarray
    bits: int

    @classmethod
    def fit(cls, grams: dict[str, np.ndarray], bits: int | None = None) -> LanguageFilters:
        """grams: the codes of each language; by default about 16 slots for each code of the largest language."""
        languages = sorted(grams)
        if bits is None:
            bits = max(10, int(np.ceil(np.log2(16 * max((len(g) for g in grams.values()), default=1) + 1))))
        out = cls(languages, np.zeros((max(1, -(-len(languages) // 64)), 1 << bits), np.uint64), bits)
        for number, language in enumerate(languages):
            for at in out._places(np.asarray(grams[language], np.uint64)):
                out.slots[number // 64][at] |= np.uint64(1 << number % 64)
        return out

    def _places(self, codes: np.ndarray) -> Iterator[np.ndarray]:
        for seed in _SEEDS:
            x = codes * seed
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            yield (x >> np.uint64(64 - self.bits)).astype(np.int64)

    def masks(self, codes: np.ndarray) -> np.ndarray:
        """Per plane and n-gram, the bits of all languages that hold it."""
        first, *others = self._places(codes)
        found = self.slots[:, first]
        for at in others:
            found &= self.slots[:, at]
        return found

    def false_positive_rates(self) -> np.ndarray:
        fill = [np.count_nonzero(self.slots[n // 64] >> np.uint64(n % 64) & np.uint64(1)) for n in range(len(self.languages))]
        return (np.array(fill) / self.slots.shape[1]) ** len(_SEEDS)

    def hits(self, codes: np.ndarray) -> np.ndarray:
        """n-grams that each language's filter holds, counted over the bytes of the masks."""
        counts = np.zeros(self.slots.shape[0] * 64, np.int64)
        each_byte = (np.arange(256)[:, None] >> np.arange(8)) & 1
        masks = self.masks(codes)
        for plane in range(masks.shape[0]):
            for byte in range(-(-min(64, len(self.languages) - 64 * plane) // 8)):
                seen = np.bincount((masks[plane] >> np.uint64(8 * byte) & np.uint64(255)).astype(np.int64), minlength=256)
                counts[64 * plane + 8 * byte :][:8] += seen @ each_byte
        return counts[: len(self.languages)]

    def shares(self, codes: np.ndarray, rates: np.ndarray) -> np.ndarray:
        """Share of the n-grams that belong to each language, with the false positives expected taken off."""
        share = self.hits(codes) / len(codes)
        return np.clip((share - rates) / np.maximum(1 - rates, 1e-9), 0, 1)


def fit_filters(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, min_share: float = MIN_SHARE) -> LanguageFilters:
    """Filters from (id, text, lang) rows; rows with a null text or language are left out.

    The fit takes about per_language rows of each language, chosen by a hash of the id. n-grams are counted per text
    on the executors; only those with at least min_share of a language's sampled texts come to the driver.
    """
    rows = labelled.select(quoted(id_col).cast("string").alias("id"), quoted(text_col).cast("string").alias("text"), quoted(lang_col).cast("string").alias("lang"))
    rows = rows.where("lang is not null and text is not null")
    totals = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not totals:
        return LanguageFilters.fit({})
    share = F.create_map(*[F.lit(x) for lang, n in sorted(totals.items()) for x in (lang, min(1.0, per_language / n))])
    chance = F.pmod(F.xxhash64(F.coalesce("id", F.lit(""))), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(chance < F.element_at(share, F.col("lang"))).select("lang", "text")

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, Counter] = {}
        texts: Counter = Counter()
        for part in parts:
            for lang, text in zip(part["lang"], part["text"], strict=True):
                codes = np.unique(ngram_codes(text))
                if len(codes):
                    texts[lang] += 1
                    seen.setdefault(lang, Counter()).update(codes.view(np.int64).tolist())
        for lang, n in texts.items():
            yield pd.DataFrame({"lang": lang, "code": pd.array([None, *seen[lang]], "Int64"), "n": [n, *seen[lang].values()]})

    grams = sample.mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    texts = {r.lang: r.n for r in grams.where("code is null").collect()}
    least = F.create_map(*[F.lit(x) for lang, n in sorted(texts.items()) for x in (lang, max(1.0, min_share * n))]) if texts else None
    found: dict[str, list[int]] = {lang: [] for lang in texts}
    if texts:
        for r in grams.where("code is not null").where(F.col("n") >= F.element_at(least, F.col("lang"))).select("lang", "code").collect():
            found[r.lang].append(r.code)
    return LanguageFilters.fit({lang: np.array(sorted(codes), np.int64).view(np.uint64) for lang, codes in found.items()})


def language_of(text: Column, filters: LanguageFilters, spark: SparkSession) -> Column:
    """struct(lang_pred, score) of each whole text; score is the corrected share of the language's n-grams.

    lang_pred is `und` with score 0 where the text is null or has no letter, or where no language was learned. Of equal
    shares the language first in the alphabet wins.
    """
    shared = spark.sparkContext.broadcast((filters, filters.false_positive_rates()))  # as large as the learned filters

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(texts: pd.Series) -> pd.DataFrame:
        known, rates = shared.value
        names, scores = [], []
        for text in texts:
            codes = ngram_codes(text or "") if known.languages else []
            share = known.shares(codes, rates) if len(codes) else None
            names.append("und" if share is None else known.languages[int(share.argmax())])
            scores.append(0.0 if share is None else float(share.max()))
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return predict(text)


def identify(docs: DataFrame, filters: LanguageFilters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, by the rules of language_of(); no shuffle."""
    rows = documents(docs, id_col, text_col)
    return rows.select("doc_id", language_of(F.col("text"), filters, docs.sparkSession).alias("of")).select("doc_id", "of.*")
