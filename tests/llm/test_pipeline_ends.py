"""The first and the last stage of the pipeline against plain Python."""

from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import sentencepiece
from public_tokenizers import path

from tests.llm.test_language_query import grams

SF = "/root/testdata/sf0.001"


def test_language_stage_keeps_what_sets_of_ngrams_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    held, texts = defaultdict(Counter), Counter()
    for r in rows:
        if r.lang is not None and grams(r.text):
            held[r.lang].update(set(grams(r.text)))
            texts[r.lang] += 1
    known = {lang: {g for g, n in c.items() if n >= max(1.0, 0.01 * texts[lang])} for lang, c in held.items()}
    share = {r.doc_id: max((np.mean([g in k for g in grams(r.text)]) for k in known.values()), default=0.0) if grams(r.text) else -1.0 for r in rows}
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, SF).collect()}
    # Shares at the bound itself may fall either way by what the filters' false positives add.
    clear = {i for i, s in share.items() if abs(s - corpus_pipeline.LEAST_SHARE) > 0.02}
    assert {i for i in clear if share[i] >= corpus_pipeline.LEAST_SHARE} == kept & clear and len(clear) > 0.95 * len(rows)


def test_encode_stage_gives_distinct_segmentations_of_each_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 80")
    model, texts = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model")), {r.doc_id: r.text for r in docs.collect()}
    got = defaultdict(set)
    for r in corpus_pipeline.encode(spark, docs, SF).collect():
        assert model.decode(list(r.ids)) == texts[r.doc_id] and 0 <= r.inclusion <= 1  # long texts: below what a double holds
        got[r.doc_id].add(tuple(r.ids))
    assert got.keys() == texts.keys() and all(len(got[i]) == 2 for i, t in texts.items() if t and len(t) > 10)
