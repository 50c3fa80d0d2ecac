"""Documents in several batches against one index: hot fingerprints over several buckets, runs read where they are, words verified."""

import random

import numpy as np
from pyspark.sql import functions as F

from textloom.llm import common, substring_dedup
from tests.llm.test_methods import brute_repeats


def test_batches_of_a_reloaded_index_equal_the_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", 3)
    rng = random.Random(8)
    passage, rows = [rng.choice("abcdefghijkl") for _ in range(14)], []
    for i in range(60):
        own = lambda n: [rng.choice("mnopqrstuvwx") for _ in range(n)]
        rows.append((i, " ".join(own(rng.choice([0, 3, 12])) + (passage[rng.randrange(4) :] if i % 3 else []) + own(rng.choice([0, 1, 9])))))
    rows += [(70, rows[4][1]), (71, "a " * 40)]
    want = brute_repeats(rows, 8)
    runs, got, path = [], {}, str(tmp_path / "w")
    for part in (rows[:20], rows[20:21], rows[21:50], rows[50:]):
        index = substring_dedup.WindowIndex(spark, path, fan_in=3, runs=runs, buckets=5)
        out = substring_dedup.deduplicate_batch(index, spark.createDataFrame(part, "doc_id long, text string"), window=8, gram=3, with_text=True)
        got |= {r.doc_id: (r.n_words, r.n_removed, r.text) for r in out.collect()}
        runs = index.runs
    assert got == want
    salts = {(r.fingerprint, r.salt) for run in runs for r in index.read(run).select("fingerprint", "salt").collect()}
    assert any(s > 0 for _, s in salts)


def test_a_run_is_merge_joined_without_moving_it(spark, tmp_path):
    index = substring_dedup.WindowIndex(spark, str(tmp_path / "w"), buckets=5)
    run = index.add(spark.range(400).select(F.col("id").alias("fingerprint"), F.lit(1).cast("long").alias("stretch"), F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("key")))
    asked = spark.createDataFrame([(3,), (900,)], "fingerprint long")
    held = index.held(run, asked)
    plan = held._jdf.queryExecution().executedPlan().toString()
    own_side = plan[plan.index("SortMergeJoin") :].split("\n")
    depth = next(k for k, line in enumerate(own_side) if "Bucketed: true" in line)
    assert not any("Exchange" in line for line in own_side[:depth])
    assert [r.fingerprint for r in held.collect()] == [3]


def test_words_are_verified_where_word_hashes_collide(spark, monkeypatch):
    same = lambda words: np.array([1 + len(w) for w in words], np.uint64)  # noqa: E731  words of one length collide
    monkeypatch.setattr(substring_dedup, "word_hashes", same)
    rows = [(1, "aa b cc d ee f"), (2, "xx b cc d ee f"), (3, "aa b cc d yy f"), (4, "zz q cc d ee f")]
    frame = spark.createDataFrame([(i, 0, t, [int(p)], [int(p)], False) for i, t in rows for p in np.unique(substring_dedup.fingerprints(same(t.split()), 4, 2))], "doc_id long, key long, text string, marks array<long>, wide array<long>, old boolean")
    found = substring_dedup.stretches(frame, 4, 2)
    places = {(r.doc_id, r["at"] + k) for r in substring_dedup.repeated_places(found).collect() for k in range(r.n)}
    first, want = {}, set()
    for i, t in rows:
        w = t.split()
        for a in range(len(w) - 3):
            if first.setdefault(tuple(w[a : a + 4]), i) < i:
                want.add((i, a))
    assert places == want


def test_what_each_key_has_is_never_broadcast(spark):
    rows = spark.range(50).select("id", F.col("id").alias("doc_id"), F.xxhash64("id").alias("h"))
    found = common.salted_join(rows, common.written(rows.select("h", F.col("id").alias("owner")), "owners"), ["h"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan and found.where("id = owner").count() == 50
