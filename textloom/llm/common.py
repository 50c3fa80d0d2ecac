"""What the operators of this subpackage share: input columns, tables in the shared folder and salted joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.filters import FILTER_BITS, FILTER_PARTS, filter_bits, filter_field, filter_places, filter_table, fitted_filter, may_hold  # noqa: F401
from textloom.sources.shared import shared_path

#: Tasks over which the rows of one key are dealt when they are joined with what the key has.
SALT = 16


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quoted(name: str):
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) of df; every other column is left out, so none can clash."""
    return df.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text"))


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of at most so many bytes of a text column, or of one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).tolist()
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield batch.slice(start)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id, n: int):
    """crc32 of the id as text, modulo n (null ids count as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def salted_join(rows: DataFrame, owners: DataFrame, keys: list[str], how: str = "inner", by: str = "doc_id") -> DataFrame:
    """rows joined with owners, which have a row for each key; the rows of one key are dealt over SALT tasks by the column by.

    A merge join at every size: Spark's estimate of owners leaves out that each stands SALT times, so a broadcast of what
    looks small would fill the driver.
    """
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int"))
    return dealt.join(owners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).hint("merge"), [*keys, "salt"], how).drop("salt")
