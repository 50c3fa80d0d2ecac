"""Keyed result cache, batches, request spacing and typed settings, as relational operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.sources.shared import shared_path


def _dealt(rows: DataFrame, tag: str, *order: str) -> DataFrame:
    """rows in ranges of order, with the number of the range as _part. Written once, so that all uses see the same ranges."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    path = shared_path(rows.sparkSession, tag)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def valid(entries: DataFrame, now: Column, ttl: str, at: str = "cached_at") -> DataFrame:
    """Entries no older than ttl at now; an age of exactly ttl is valid."""
    return entries.where(F.col(at) >= now - F.expr(f"interval {ttl}"))


def with_payload(entries: DataFrame, payloads: DataFrame, key: str = "url_hash") -> DataFrame:
    """The entries whose payload is there; an entry without one is no valid entry."""
    return entries.join(payloads.select(key), key, "left_semi")


def removed(entries: DataFrame, gone: DataFrame, key: str = "url_hash") -> DataFrame:
    """The entries left when those of some keys are taken out; with all keys gone the index is cleared."""
    return entries.join(gone.select(key), key, "left_anti")


def expired(entries: DataFrame, now: Column, ttl: str, at: str = "cached_at") -> DataFrame:
    return entries.where(F.col(at) < now - F.expr(f"interval {ttl}"))


def upserted(entries: DataFrame, key: str = "url_hash", at: str = "cached_at", tie: str = "event_id") -> DataFrame:
    """The last written entry of each key. Aggregated before the shuffle, so a hot key makes no large group."""
    last = entries.groupBy(key).agg(F.max_by(F.struct(*entries.columns), F.struct(at, tie)).alias("last"))
    return last.select("last.*")


def hits(requests: DataFrame, entries: DataFrame, key: str = "url_hash") -> DataFrame:
    return requests.join(entries, key, "left_semi")


def misses(requests: DataFrame, entries: DataFrame, key: str = "url_hash") -> DataFrame:
    return requests.join(entries, key, "left_anti")


def evicted(entries: DataFrame, cap: int, size: str = "file_size", at: str = "cached_at", tie: str = "event_id") -> DataFrame:
    """The entries left: where all sizes exceed cap, the oldest quarter (at least one) goes.

    The boundary is the greatest (at, tie) among the oldest quarter, found inside one
    of many ranges of (at, tie), which the counts of the ranges tell.
    """
    total = entries.agg(F.sum(size).alias("all_size"), F.count("*").alias("n")).first()
    if not total.n or total.all_size <= cap:
        return entries
    keys, left = _dealt(entries.select(at, tie), "evicted", at, tie), max(1, total.n // 4)
    for part, n in sorted(tuple(r) for r in keys.groupBy("_part").count().collect()):  # a row for each range
        if left <= n:
            break
        left -= n
    go = keys.where(F.col("_part") == part).orderBy(at, tie).limit(left).agg(F.max(F.struct(at, tie)).alias("edge"))
    return entries.crossJoin(F.broadcast(go)).where(F.struct(at, tie) > F.col("edge")).drop("edge")  # one row is broadcast


def stats(entries: DataFrame, now: Column, ttl: str, size: str = "file_size", at: str = "cached_at") -> DataFrame:
    fresh = F.col(at) >= now - F.expr(f"interval {ttl}")
    return entries.agg(F.count("*").alias("total"), F.count_if(fresh).alias("valid"), F.count_if(~fresh).alias("expired"), F.sum(size).alias("size"))


def chunked(rows: DataFrame, size: int = 5, order: tuple[str, ...] = ("ts", "event_id"), by: str = "user_id") -> DataFrame:
    """rows with batch, numbered from 1 within each value of by, in order.

    Rows are numbered inside ranges of (by, order); a range goes on from the rows that earlier ones hold of its first by.
    """
    if "rn" in rows.columns:
        return rows.withColumn("batch", F.expr("cast((rn - 1) div %d as bigint) + 1" % size))
    dealt = _dealt(rows, "chunked", by, *order)
    earlier = W.partitionBy("_by").orderBy("_in").rowsBetween(W.unboundedPreceding, -1)  # over one row for each range
    counts = dealt.groupBy(F.col(by).alias("_by"), F.col("_part").alias("_in")).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(earlier)).where("_before is not null").drop("_n")
    rn = F.row_number().over(W.partitionBy("_part", by).orderBy(*order)) + F.coalesce("_before", F.lit(0))
    dealt = dealt.join(F.broadcast(before), (F.col("_part") == F.col("_in")) & F.col(by).eqNullSafe(F.col("_by")), "left")  # one row a range at most
    return dealt.withColumn("batch", F.floor((rn - 1) / size) + 1).select(*rows.columns, "batch")


def batch_stats(results: DataFrame, ok: Column) -> DataFrame:
    """One row: total, succeeded and the rate as text with one decimal."""
    out = results.agg(F.count("*").alias("total"), F.count_if(ok).alias("succeeded"))
    return out.withColumn("rate", F.format_string("%.1f%%", F.coalesce(F.try_divide(F.col("succeeded") * 100, F.col("total")), F.lit(0.0))))


def isolated(rows: DataFrame, work, schema: str) -> DataFrame:
    """work(row) for each row in Arrow batches; a row that raises gets status `error` and its message, not the batch.

    Rows are worked on one at a time, as each may fail by itself: a slow path, for work that only a Python call can do.

    schema holds the columns that work returns as a dict; status and message are added. Input columns are kept.
    """
    import pandas as pd

    names = [f.name for f in rows.sparkSession.createDataFrame([], schema).schema]
    whole = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(parts):
        for part in parts:
            made = []
            for row in part.to_dict("records"):
                try:
                    made.append({**work(row), "status": "success", "message": ""})
                except Exception as e:  # noqa: BLE001  isolation of rows is the point
                    made.append({**dict.fromkeys(names), "status": "error", "message": str(e)})
            yield pd.concat([part.reset_index(drop=True), pd.DataFrame(made, columns=[*names, "status", "message"])], axis=1)

    return rows.mapInPandas(run, f"{whole}, {schema}, status string, message string")


#: Least and greatest seconds between requests, and how many at once.
STRATEGIES = [("douyin", 6.0, 10.0, 2), ("xiaohongshu", 4.0, 7.0, 2), ("zhihu", 2.0, 4.0, 3), ("default", 3.0, 5.0, 2)]


def strategies(spark: SparkSession, extra: list[tuple] = ()) -> DataFrame:
    """(platform, least, most, at_once); a row of extra replaces the one of its platform."""
    rows = {r[0]: r for r in [*STRATEGIES, *extra]}
    return spark.createDataFrame(list(rows.values()), "platform string, least double, most double, at_once int")


def rate_violations(rows: DataFrame, key: str, at: str, least_seconds: float, tie: str = "event_id") -> DataFrame:
    """rows with gap, the seconds since the one before of the same key, where that is under the least.

    Gaps are taken inside ranges of (key, at, tie); a range's first row looks at the last one of its key in the ranges before.
    """
    dealt = _dealt(rows, "gaps", key, at, tie)
    lasts = dealt.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_in")).agg(F.max_by(at, F.struct(at, tie)).alias("_last"))
    lasts = lasts.withColumn("_last", F.lag("_last").over(W.partitionBy("_key").orderBy("_in"))).where("_last is not null")  # over one row for each range
    dealt = dealt.join(F.broadcast(lasts), (F.col("_part") == F.col("_in")) & F.col(key).eqNullSafe(F.col("_key")), "left")  # one row a range at most
    inside = W.partitionBy("_part", key).orderBy(at, tie)
    previous = F.when(F.row_number().over(inside) == 1, F.col("_last")).otherwise(F.lag(at).over(inside))
    gap = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(previous.cast("timestamp"))) / 1e6
    return dealt.withColumn("gap", gap).where(F.col("gap") < least_seconds).select(*rows.columns, "gap")


def coerced(value: Column) -> Column:
    """struct(kind, text): booleans first (also 1 and 0), then numbers, then JSON, else the string."""
    low = F.lower(value)
    typed = lambda kind, text: F.struct(F.lit(kind).alias("kind"), (F.lit(text) if isinstance(text, str) else text).alias("text"))
    return (
        F.when(low.isin("true", "yes", "on", "1"), typed("bool", "true"))
        .when(low.isin("false", "no", "off", "0"), typed("bool", "false"))
        .when(value.rlike(r"^[+-]?\d+$"), typed("int", value.try_cast("bigint").cast("string")))
        .when(value.rlike(r"^[+-]?\d+\.\d+$"), typed("float", value.try_cast("double").cast("string")))
        .when(value.rlike(r"(?s)^\s*[\[{]") & F.try_parse_json(value).isNotNull(), typed("json", value))
        .otherwise(typed("string", value))
    )
