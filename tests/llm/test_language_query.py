"""The language query against plain Python: sets of n-grams for each language instead of filters, over the same texts."""

from collections import Counter, defaultdict
from zlib import crc32

import numpy as np

from textloom.llm import queries

SF = "/root/testdata/sf0.01"


def grams(text):
    text = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    words = text.split()
    if not words:
        return []
    text = " " + " ".join(words) + " "
    return [text[i : i + 3] for i in range(len(text) - 2)]


def test_query_against_sets_of_ngrams(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    held, texts = defaultdict(Counter), Counter()
    for r in rows:
        if crc32(str(r.doc_id).encode()) % 3 != 1 and r.lang is not None and grams(r.text):
            held[r.lang].update(set(grams(r.text)))
            texts[r.lang] += 1
    known = {lang: {g for g, n in c.items() if n >= max(1.0, 0.01 * texts[lang])} for lang, c in held.items()}
    got = {r.doc_id: r for r in queries.op4_language_bitmask(spark, SF).collect()}
    assert got.keys() == {r.doc_id for r in rows}
    same, off = [], []
    for r in rows:
        g, mine = grams(r.text), got[r.doc_id]
        assert mine.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1)
        if not g:
            assert (mine.lang_pred, mine.score) == ("und", 0.0)
            continue
        share = {lang: np.mean([x in known[lang] for x in g]) for lang in sorted(known)}
        best = max(share, key=share.get)
        same.append(best == mine.lang_pred)
        off.append(abs(share[mine.lang_pred] - mine.score))
    # The filters' false positives, corrected in expectation, are all that may differ.
    assert np.mean(same) > 0.995 and np.mean(off) < 0.01
