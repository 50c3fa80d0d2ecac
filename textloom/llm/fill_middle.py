"""Fill-in-the-middle: texts cut at two unit boundaries and put together again with the middle last.

A text is a run of units (lines, by default). One full match of (unit)* by the regex library keeps every repetition of
its group, so the ends of that group are all boundaries at once: their number is the number of units, and the two cuts are
looked up among them. What is drawn for a row depends on its id and a seed alone, so any task draws the same again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import documents, slices

LINES = r"[^\n]*\n|[^\n]+"
SENTINELS = ("<P>", "<S>", "<M>")
#: Form of a row: the text as it is; prefix, suffix, middle; suffix, prefix, middle.
PLAIN, PSM, SPM = "plain", "psm", "spm"


def told_apart(sentinels: tuple[str, str, str]) -> None:
    """An error unless no occurrence of a sentinel can reach over the edge of another one into a text."""
    if len(set(sentinels)) < 3 or not all(sentinels):
        raise ValueError("three different sentinels are needed")
    for a in sentinels:
        for b in sentinels:
            if (a != b and a in b) or any(b.startswith(a[-k:]) for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"{a!r} and {b!r} may overlap, so a text could not be rebuilt")


def boundaries(units: regex.Pattern, text: str) -> list[int]:
    """The end of each unit; an error if the text is no run of units."""
    whole = units.fullmatch(text)
    if whole is None:
        raise ValueError("the text is no run of units")
    return whole.ends(1)


def drawn(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers below 2**32 for a row."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def fill_in_middle(
    docs: DataFrame, unit: str = LINES, seed: int = 7, rate: int = 100, spm: int = 50, sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n (units), form, prefix_chars, middle_chars, output.

    rate of 100 rows are transformed, spm of 100 of those with the suffix first. A text stays plain, and has null in both
    lengths, if it is empty or null, holds a sentinel or was not drawn. Cuts may fall on either end of the text, and on each
    other: then a part is empty. Null ids draw as the empty string does; rows of one id draw alike, whatever their texts.
    Lengths are code points. No shuffle: each row is made where it is read, and an empty table gives an empty result.
    """
    told_apart(sentinels)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = regex.compile(f"({unit})*")
        p, s, m = sentinels
        for batch in rows:
            for part in slices(batch, "text"):
                out = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    text = text or ""
                    ends = boundaries(units, text)
                    h = drawn(seed, doc_id)
                    if not text or p in text or s in text or m in text or h[2] % 100 >= rate:
                        out.append((len(ends), PLAIN, None, None, text))
                        continue
                    a, b = sorted((0, *ends)[x % (len(ends) + 1)] for x in h[:2])
                    first, middle, last = text[:a], text[a:b], text[b:]
                    suffix_first = h[3] % 100 < spm
                    made = f"{s}{last}{p}{first}{m}{middle}" if suffix_first else f"{p}{first}{s}{last}{m}{middle}"
                    out.append((len(ends), SPM if suffix_first else PSM, a, b - a, made))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                made = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
                yield pa.record_batch([part.column("doc_id"), *made], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return documents(docs, id_col, text_col).mapInArrow(batches, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The exact text again, from an output and its form alone."""
    p, s, m = sentinels

    def parts(first: str, second: str) -> list[Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        a = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(a) + F.lit(len(second) + 1))
        b = F.substring_index(rest, m, 1)
        return [a, b, F.substr(rest, F.length(b) + F.lit(len(m) + 1))]

    prefix, suffix, middle = parts(p, s)
    suffix2, prefix2, middle2 = parts(s, p)
    return F.when(form == PSM, F.concat(prefix, middle, suffix)).when(form == SPM, F.concat(prefix2, middle2, suffix2)).otherwise(output)
