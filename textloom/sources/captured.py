"""Captured answers of a site's interface: one folder a page, with a JSON file for each kind of answer.

Files are read by Spark's own file source, which deals them over tasks and, in a stream, keeps in its checkpoint which it
has read. `<folder>/<page>/<kind>.json` gives the row (page, kind, answer, at).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("info", "tags", "parts")


def _rows(files: DataFrame) -> DataFrame:
    steps = F.split(F.col("_metadata.file_path"), "/")
    name = lambda k: F.url_decode(F.replace(F.element_at(steps, k), F.lit("+"), F.lit("%2B")))
    return files.select(name(-2).alias("page"), F.regexp_replace(name(-1), r"\.json$", "").alias("kind"), F.col("value").alias("answer"), F.col("_metadata.file_modification_time").alias("at"))


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """(page, kind, answer, at) of every file; an answer is the whole file."""
    return _rows(spark.read.format("text").option("wholetext", True).load(f"{folder}/*/*.json"))


def arriving_answers(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """The rows of answers() as a stream, in batches of so many files; a file counts once, when it is first seen."""
    reader = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch)
    return _rows(reader.load(f"{folder}/*/*.json"))


def assembled(rows: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(page, and a column for each kind): of each kind the latest answer, of equal times the larger; null if there is none."""
    def latest(kind: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.struct("at", "answer")))["answer"].alias(kind)

    return rows.groupBy("page").agg(*[latest(k) for k in kinds])
