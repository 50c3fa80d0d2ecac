"""A document's samples depend on its id and text alone: every column, bit by bit, whatever else is in its block."""

import sentencepiece
from public_tokenizers import path
from pyspark.sql import functions as F

from textloom.llm import queries, segmentation

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(tuple(r) for r in df.select("doc_id", "rank", "n_pieces", "log_prob", "perturbed", "inclusion", "ids_hash", F.array_join("ids", ",")).collect())


def test_all_columns_are_the_same_in_other_partitions(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    whole = rows_of(segmentation.sample_segmentations(docs.coalesce(1), path("piece_bpe_32k.model")))
    assert rows_of(segmentation.sample_segmentations(docs.repartition(13, "text"), path("piece_bpe_32k.model"))) == whole
    some = rows_of(segmentation.sample_segmentations(docs.where("doc_id % 9 = 4").coalesce(1), path("piece_bpe_32k.model")))
    assert some == [r for r in whole if r[0] % 9 == 4]


def test_query_returns_pieces_that_the_library_decodes_to_the_text(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op1_gumbel_segmentations(spark, SF).collect()
    assert {r.doc_id for r in got} == texts.keys()
    for r in got:
        assert len(r.ids) == r.n_pieces and model.decode(list(r.ids)) == texts[r.doc_id]
    both = {(r.doc_id, tuple(r.ids)) for r in got if len(texts[r.doc_id]) > 30}
    assert len(both) == sum(len(texts[r.doc_id]) > 30 for r in got)
