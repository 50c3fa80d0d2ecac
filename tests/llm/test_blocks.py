"""Benchmarks of any size and items of any length: the same matches in more tasks, in a plan of the same size."""

import numpy as np

from textloom.llm import decontamination

W = [f"w{i}" for i in range(200)]


def rows(index, items, **o):
    return sorted((r.segment, r.doc_no, r.item_id, [tuple(s) for s in r.spans]) for r in decontamination.find_matches(index, items, **o).collect())


def test_blocks_of_windows(spark):
    docs = spark.createDataFrame([(1, " ".join(W[20:90])), (2, "x " + " ".join(W[33:44]) + " y"), (3, "a b c"), (4, " ".join(W[180:]))], "doc_id long, text string")
    items = spark.createDataFrame([("long", " ".join(W)), ("short", "a b c"), ("none", ""), ("other", " ".join(W[30:60]))], "item_id string, text string")
    index = decontamination.build_index(docs)
    whole = rows(index, items)
    assert len(whole) == 6 and rows(index, items, block_windows=25) == whole


def test_the_plan_does_not_grow_with_the_benchmark(spark):
    docs = spark.createDataFrame([(i, " ".join(W[i : i + 30])) for i in range(40)], "doc_id long, text string")
    index = decontamination.build_index(docs, segment_words=200)
    sizes = []
    for n in (5, 120):
        items = spark.createDataFrame([(i, " ".join(W[i : i + 12])) for i in range(n)], "item_id long, text string")
        found = decontamination.find_matches(index, items, block_windows=10)
        sizes.append(len(found._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        assert found.count() == sum(i <= j and j + 12 <= i + 30 or any(max(i, j + k) == j + k and j + k + 10 <= i + 30 for k in range(3)) for i in range(40) for j in range(n))
    assert sizes[0] == sizes[1]


def test_one_term_that_is_in_every_document(spark):
    docs = spark.createDataFrame([(i, "the " * 12 + f"u{i}") for i in range(300)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the " * 11), (2, "the " * 9 + "u7"), (3, "the never seen words at all in any of the texts")], "item_id long, text string")
    got = {(r.doc_no, r.item_id) for r in decontamination.find_matches(decontamination.build_index(docs.coalesce(1)), items).collect()}
    assert got == {(i, "1") for i in range(300)} | {(7, "2")}


def test_position_lists_are_small_and_whole(spark):
    texts = [" ".join(W[(i * k) % (7 + i)] for k in range(150 + i)) for i in range(60)] + ["", None, "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    index = decontamination.build_index(docs, segment_words=3000).collect()
    held = [r for r in index if r.term is not None]
    assert sum(len(r.positions) for r in held) < 2 * sum(r.n for r in held)
    at = {(r.segment, r.start + k): w for r in index if r.term is None for k, w in enumerate(decontamination.words_of(texts[r.doc_id]))}
    found = [((r.segment, int(p)), r.term) for r, x in zip(held, decontamination.unpacked([r.positions for r in held]), strict=True) for p in x]
    assert len(found) == len(at) == sum(r.n for r in held) and dict(found) == at
    edges = [0, 1, 127, 128, 2**14 - 1, 2**14, 2**21, 2**28 - 1, 2**28, 2**31 - 1]
    data, ends = decontamination.packed(np.array(edges))
    assert [x.tolist() for x in decontamination.unpacked([data[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)])] == [[x] for x in edges] and decontamination.unpacked([]) == []
