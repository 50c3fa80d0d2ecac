"""A corpus pipeline of this library's operators; its stages run one after the other on what the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of documents. Rows are told apart by id and text, so repeated ids do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontamination, exact_dedup, language_id, near_dup, segmentation
from textloom.llm.common import fitted_filter, may_hold, table, written
from textloom.llm.queries import tokenizer

#: Documents less of whose n-grams belong to their best language are rejected, as are those without a letter.
LEAST_SHARE = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents of a language that the corpus' own language marks teach."""
    filters = language_id.fit_filters(docs)
    of = language_id.language_of(F.col("text"), filters, spark)
    judged = docs.select(*docs.columns, of.alias("language_of"))
    return judged.where((F.col("language_of.lang_pred") != "und") & (F.col("language_of.score") >= LEAST_SHARE)).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts."""
    # One text key for id and digest, as null ids must match too; of repeated rows one stays.
    key = lambda doc_id, digest: F.concat_ws(":", F.hex(digest), doc_id)
    kept = exact_dedup.exact_dedup(docs).where("kept").select(key(F.col("doc_id"), F.col("digest")).alias("row_key"))
    rows = docs.withColumn("row_key", key(F.col("doc_id"), exact_dedup.sha256(exact_dedup.normalised(F.col("text")))))
    return rows.join(kept, "row_key", "left_semi").dropDuplicates(["row_key"]).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    gone = near_dup.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key"))
    return docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_key"]), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that hold no passage of the benchmark. Only texts that a filter of the keys of hits passes are shuffled."""
    rows = docs.withColumn("row_key", F.xxhash64("doc_id", "text"))
    hit = decontamination.contamination(rows, table(spark, sf_dir, "benchmark"), id_col="row_key").where("n_hit > 0").select(F.col("doc_id").alias("row_key"))
    hit = written(hit.distinct(), "contaminated")
    judged = rows.withColumn("may_be_hit", may_hold(F.col("row_key"), fitted_filter(hit.select(F.col("row_key").alias("h"))), spark))
    cleared = judged.where("may_be_hit").join(hit.hint("merge"), "row_key", "left_anti")
    return judged.where("not may_be_hit").select(docs.columns).unionByName(cleared.select(docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document, with their piece ids and inclusion scores."""
    return segmentation.sample_segmentations(docs, tokenizer(spark, "piece_bpe_32k.model"), k=2)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", encode),
]
#: Sampling, learned filters and repeated table writes are not for SQL; the tests hold brute force against it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
