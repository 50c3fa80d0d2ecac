"""Contiguous byte-balanced shards from global prefix sums; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm.common import documents, written


def prefix_sum_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row with its place: doc_id, size, text_crc32, shard, slot, offset.

    Rows stand in the order of doc_id (null ids first), then checksum, size and place in the input. size is the UTF-8
    length of the text (null: 0) plus 1. offset is the sum of the sizes of all rows before; the row goes to the shard
    in whose share of all bytes its middle lies, so each shard is a contiguous run within one row of the equal share.
    slot counts the rows of a shard from 0. Texts are not moved: only ids, sizes and checksums are shuffled.
    Empty input gives an empty result; repeated rows each take a slot.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    text = F.coalesce("text", F.lit(""))
    order = ["doc_id", "text_crc32", "size", "place"]
    rows = documents(docs, id_col, text_col).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("place")
    )
    # Written once, so that the parts, their totals and the sums inside them all see the same dealing.
    rows = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "shard-sizes")
    totals = rows.groupBy("part").agg(F.sum("size").alias("part_size"), F.count("*").alias("part_rows"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # over one row for each part only
    whole = W.partitionBy()
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_size").over(whole).alias("total"),
    )
    inside = W.partitionBy("part").orderBy(*order)
    placed = (
        rows.join(F.broadcast(offsets), "part")  # as many rows as shuffle partitions
        .withColumn("offset", F.col("size_before") + F.sum("size").over(inside) - F.col("size"))
        .withColumn("index", F.col("rows_before") + F.row_number().over(inside) - 1)
        .withColumn("shard", F.expr(f"cast((2 * offset + size) * {int(shards)} div (2 * total) as int)"))
        .select("doc_id", "size", "text_crc32", "shard", "index", "offset")
    )
    placed = written(placed, "shard-places")
    starts = placed.groupBy("shard").agg(F.min("index").alias("start"))
    return placed.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("index") - F.col("start")).alias("slot"), "offset")


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the rows of docs as Parquet below path/shard=N, each shard in slot order.

    Ids must be unique here: texts are joined to their places by id.
    """
    places = prefix_sum_shards(docs, shards, id_col, text_col).select("doc_id", "shard", "slot")
    texts = documents(docs, id_col, text_col)
    (texts.join(places, texts.doc_id.eqNullSafe(places.doc_id)).select(texts.doc_id, "text", "shard", "slot")
     .repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))
