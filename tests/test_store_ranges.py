"""Eviction, batches and gaps with one user that holds most rows: right, and no task has the whole user."""

import datetime as dt

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.operators import store


def events(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, (i % 4 or 7) if i % 5 == 0 else None if i % 7 == 0 else 1, start + dt.timedelta(seconds=i * 37 % 5000), 2) for i in range(3000)]
    return spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, file_size long").repartition(6)


def test_batches_and_gaps(spark):
    rows, w = events(spark), W.partitionBy("user_id").orderBy("ts", "event_id")
    got = {r.event_id: r.batch for r in store.chunked(rows).collect()}
    assert got == {r.event_id: (r.n - 1) // 5 + 1 for r in rows.withColumn("n", F.row_number().over(w)).collect()}
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))
    want = {r.event_id: r.gap / 1e6 for r in rows.withColumn("gap", gap).where("gap < 6000000").collect()}
    assert want and {r.event_id: r.gap for r in store.rate_violations(rows, "user_id", "ts", 6).collect()} == want


def test_eviction(spark):
    rows = events(spark)
    order = sorted((r.ts, r.event_id) for r in rows.collect())
    assert {(r.ts, r.event_id) for r in store.evicted(rows, 10, at="ts").collect()} == set(order[750:])


def test_a_large_user_is_dealt_to_several_ranges(spark):
    parts = store._dealt(events(spark), "ranges", "user_id", "ts", "event_id").where("user_id = 1").groupBy("_part").count().collect()
    assert len(parts) > 1
