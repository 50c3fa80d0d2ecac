"""The filters of the digest index, and documents that come in several calls."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.llm import common, exact_dedup


def keys(spark, texts):
    return spark.createDataFrame([(t.encode(),) for t in texts], "digest binary")


def test_filter_passes_what_it_holds_and_little_else(spark):
    held, others = [f"in{i}" for i in range(3000)], [f"out{i}" for i in range(3000)]
    both = keys(spark, held + others)
    field = common.fitted_filter(keys(spark, held).select(F.xxhash64("digest").alias("h")))
    passed = both.where(common.may_hold(F.xxhash64("digest"), field, spark)).collect()
    words = exact_dedup.passing(both, exact_dedup.bit_words(keys(spark, held), 1 << 20), 1 << 20).collect()
    assert sorted(bytes(r.digest) for r in words) == sorted(bytes(r.digest) for r in passed)  # the same bits, as words in a join
    names = {bytes(r.digest).decode() for r in passed}
    assert set(held) <= names and len(names & set(others)) < 30


def test_run_that_no_digest_may_be_in_is_not_read(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "i"), fan_in=9)
    made = lambda a, b: spark.createDataFrame([(f"d{i}".encode(), False, i, i) for i in range(a, b)], "digest binary, no_id boolean, doc_id long, row long")
    index.flush(made(0, 50))
    index.flush(made(50, 90))
    again = exact_dedup.DigestIndex(spark, index.path, runs=index.runs)
    assert {r["first"].doc_id for r in again.found(made(60, 65)).collect()} == {60, 61, 62, 63, 64}
    assert (again.read, again.skipped) == (1, 1)
    assert again.found(made(200, 210)).collect() == [] and again.skipped == 3


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_calls_with_one_index_equal_plain_groups(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(exact_dedup, "BROADCAST_HITS", broadcast)
    rng = random.Random(4)
    texts = ["", " ", "a b", "a  b", "c", "d e f", "g"]
    rows = [(i, rng.choice(texts)) for i in rng.sample(range(200), 90)] + [(None, "c"), (None, "new"), (7, "q"), (7, "q")]
    calls = [rows[:30], rows[30:60], rows[60:]]
    frames = [spark.createDataFrame(c, "doc_id long, text string") for c in calls]
    index, past = exact_dedup.DigestIndex(spark, str(tmp_path / "i"), fan_in=4), None
    seen = {}
    for call, df in zip(calls, frames, strict=True):
        index = exact_dedup.DigestIndex(spark, index.path, fan_in=4, runs=index.runs)
        got = exact_dedup.exact_dedup(df, batches=2, index=index, earlier=past).collect()
        norm = lambda t: " " if t.strip() == "" and t else " ".join(t.split()) if t.split() else t
        before = {k: list(v) for k, v in seen.items()}
        for i, t in call:
            seen.setdefault(norm(t), []).append(i)
        rank = lambda i: (i is None, i or 0)
        want = sorted((rank(i), rank(min(seen[norm(t)], key=rank)), len(seen[norm(t)])) for i, t in call)
        assert sorted((rank(r.doc_id), rank(r.keep_id), r.group_size) for r in got) == want
        kept = sorted(rank(r.doc_id) for r in got if r.kept)
        fresh = [rank(min(v, key=rank)) for k, v in seen.items() if not before.get(k) or min(map(rank, v)) < min(map(rank, before[k]))]
        assert kept == sorted(fresh)
        past = df if past is None else past.unionByName(df)


def test_collisions_with_earlier_calls(spark, tmp_path):
    weak = lambda norm: F.substring(norm, 1, 1).cast("binary")
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "i"))
    one, two = (spark.createDataFrame(r, "doc_id long, text string") for r in ([(1, "aa"), (2, "ab"), (3, "b")], [(4, "ab"), (5, "ac"), (0, "b")]))
    exact_dedup.exact_dedup(one, digest=weak, index=index)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(two, digest=weak, index=index, earlier=one).collect()}
    assert got == {4: (2, 2, False), 5: (5, 1, True), 0: (0, 2, True)}
