"""Readers and writers: staged JSON, Markdown files with collision-free names, JSON reports."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.context import file_name
from textloom.sources.shared import shared_path, written


def named(docs: DataFrame, title: str = "title", order: str = "doc_id", existing: DataFrame | None = None) -> DataFrame:
    """docs with file_name, which no two rows share: documents of one name get _1, _2 and so on from the second on, in order.

    A number that makes the name of another document (a title that ends in _1) or of existing, rows of (name) with the
    ending left out, is passed over. Rows with a null in order come last among their name. Numbers are given in ranges of
    (name, order), so that no task holds all documents of one name.
    """
    spark = docs.sparkSession
    by = [F.col("_base"), F.col(order).isNull(), F.col(order), F.col("_tie")]
    dealt = docs.withColumn("_base", file_name(F.col(title))).withColumn("_tie", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).withColumn("_part", F.spark_partition_id())
    path = shared_path(spark, "named")
    dealt.write.parquet(path)  # once, so that all uses see the same ranges
    dealt = spark.read.schema(dealt.schema).parquet(path)
    counts = dealt.groupBy("_base", "_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(W.partitionBy("_base").orderBy("_part")) - F.col("_n")).drop("_n")  # over one row for each range
    inside = F.row_number().over(W.partitionBy("_base", "_part").orderBy(*by[1:])) - 1
    placed = dealt.withColumn("_in", inside).join(before, ["_base", "_part"])

    names = dealt.select(F.col("_base").alias("name"), F.lit(0).alias("there"))
    if existing is not None:
        names = names.unionByName(existing.select("name", F.lit(1).alias("there")))
    names = names.groupBy("name").agg(F.max("there").alias("there"))
    numbered = r"^(.*)_([1-9]\d{0,8})$"
    numbers = names.select(F.regexp_extract("name", numbered, 1).alias("_base"), F.regexp_extract("name", numbered, 2).try_cast("int").alias("_number")).where("_number is not null")
    taken = numbers.groupBy("_base").agg(F.sort_array(F.collect_set("_number")).alias("_taken"))  # the names of one stem, not its documents
    known = names.where("there = 1").select(F.col("name").alias("_base"), F.lit(1).alias("_there"))
    out = placed.join(taken, "_base", "left").join(known, "_base", "left")
    k = F.col("_in") + F.col("_before") + F.coalesce("_there", F.lit(0))
    free = F.aggregate(F.coalesce("_taken", F.array().cast("array<int>")), k, lambda n, t: F.when((n > 0) & (t <= n), n + 1).otherwise(n))
    return out.withColumn("_free", free).select(*[f"`{c}`" for c in docs.columns], F.concat("_base", F.when(F.col("_free") > 0, F.concat(F.lit("_"), F.col("_free").cast("string"))).otherwise(""), F.lit(".md")).alias("file_name"))


def write_markdown(docs: DataFrame, path: str, title: str = "title", document: str = "document", order: str = "doc_id") -> int:
    """One .md file for each document below path, named by its title; files that are there stay. The number of documents.

    Each task writes the files of its partition. path is a folder that all executors reach, with the scheme of its file
    system where it is not mounted. A file is written under another name and then moved, so a task that runs again does no
    harm. The names of the files that are there are read as a table.
    """
    from pyarrow import fs

    spark = docs.sparkSession
    system, folder = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    system.create_dir(folder, recursive=True)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(path if "://" in path else f"file://{path}")
    there = files.select(F.regexp_extract("path", r"([^/]*)\.md$", 1).alias("name"))  # contents are not read
    made = named(docs, title, order, there).select("file_name", F.coalesce(document, F.lit("")).alias("document"))
    made = written(made, "markdown")  # names are settled before the first file appears

    def write(batches):
        system, folder = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        for batch in batches:
            for name, text in zip(batch.column("file_name").to_pylist(), batch.column("document").to_pylist(), strict=True):
                beside = f"{folder}/.{uuid.uuid4().hex}.part"
                with system.open_output_stream(beside) as out:
                    out.write(text.encode())
                system.move(beside, f"{folder}/{name}")
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], ["n"])

    return made.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def write_rows(docs: DataFrame, path: str, title: str = "title", document: str = "document", order: str = "doc_id") -> None:
    """The documents as Parquet rows (file_name, document) below path, for very many of them."""
    named(docs, title, order).select("file_name", document).write.parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def stage(spark: SparkSession, rows: DataFrame | list[dict], path: str, schema: str) -> None:
    """Add rows, a table or a few dicts, to the content staged as JSON lines below path."""
    made = rows if isinstance(rows, DataFrame) else spark.createDataFrame(rows, schema)
    made.write.mode("append").json(path)


def staged(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Content staged as JSON lines; the schema is given, never inferred."""
    return spark.read.schema(schema).json(path)


def staged_one(spark: SparkSession, path: str, schema: str, key: str, value: str) -> DataFrame:
    """The staged rows of one key; an error if there are none."""
    rows = staged(spark, path, schema).where(F.col(key) == value)
    if rows.isEmpty():
        raise FileNotFoundError(f"nothing staged under {key} = {value!r}")
    return rows


def without_staged(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What stays after the rows of done are removed, for an overwrite of the staged table."""
    return rows.join(done.select(key).distinct(), key, "left_anti")
