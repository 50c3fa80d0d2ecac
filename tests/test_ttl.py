"""Entries that expire by timer: renewed, late and expired keys, over runs that go on from their checkpoint."""

from datetime import datetime, timedelta

from textloom.streaming import jobs, ttl

DAY = datetime(2024, 1, 1)


def at(hours):
    return DAY + timedelta(hours=hours)


def test_entries_expire_once_and_state_outlives_the_query(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    schema = "url_hash string, event_id long, cached_at timestamp_ntz"

    def run(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / name))
        stream = spark.readStream.schema(schema).parquet(f"{folder}/*")
        got = jobs.drained(ttl.expirations(stream, ttl_ms=10 * 3_600_000), out).collect()
        return sorted((str(r.url_hash), r.event_id, r.cached_at) for r in got)

    first = run("one", [("a", 1, at(0)), ("b", 2, at(1)), ("b", 3, at(9)), ("b", 4, at(9)), ("c", 5, at(15)), (None, 6, at(2)), ("d", 7, None)])
    # The watermark is an hour before the last write: only what ended by then is out, and of b only its last write counts.
    assert first == [("None", 6, at(2)), ("a", 1, at(0))]
    second = run("two", [("a", 8, at(16)), ("b", 9, at(15)), ("c", 10, at(3)), ("e", 11, at(24))])
    # a was written anew after it expired, b was renewed before it did, and the late write of c changes nothing.
    assert second == first
    third = run("three", [("z", 12, at(27))])
    assert third == sorted([*first, ("a", 8, at(16)), ("b", 9, at(15)), ("c", 5, at(15))])
    assert run("four", [("z", 13, at(1))]) == third


def test_equal_times_and_many_writes_of_one_key(spark, tmp_path):
    rows = [("hot", i, at(1) + timedelta(microseconds=i % 997)) for i in range(30_000)] + [("x", 1, at(300))]
    spark.createDataFrame(rows, "url_hash string, event_id long, cached_at timestamp_ntz").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url_hash string, event_id long, cached_at timestamp_ntz").parquet(str(tmp_path / "in"))
    got = jobs.drained(ttl.expirations(stream, ttl_ms=1000), str(tmp_path / "out")).collect()
    last = max((i % 997, i) for i in range(30_000))
    assert [(r.url_hash, r.event_id, r.cached_at) for r in got] == [("hot", last[1], at(1) + timedelta(microseconds=last[0]))]
