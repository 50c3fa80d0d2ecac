"""One-permutation fingerprints: against true similarities, and the order of successors against a sorted list."""

import random

import numpy as np
import pytest

from textloom.llm import fingerprints as fp
from textloom.llm.near_dup import shingle_set


def words(draw, n):
    return [f"w{draw.randrange(50_000)}" for _ in range(n)]


def likeness(a, b, prints=fp.Prints()):
    return prints.likeness(prints.of(a), prints.of(b))


def true(a, b, size=5):
    x, y = set(shingle_set(a, size).tolist()), set(shingle_set(b, size).tolist())
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("prints", [fp.Prints(), fp.Prints(log_bins=10, bits=8), fp.Prints(log_bins=11, bits=1)])
def test_likeness_is_near_the_similarity(prints):
    draw, off = random.Random(3), []
    for share in (0.0, 0.3, 0.6, 0.8, 0.9, 1.0):
        for n in (6, 40, 300, 3000):
            a = words(draw, n)
            cut = round(n * (1 - share))
            a, b = " ".join(a), " ".join(words(draw, cut) + a[cut:])
            off.append(likeness(a, b, prints) - true(a, b))
    assert max(map(abs, off)) < 0.2 and abs(np.mean(off)) < 0.02 and np.sqrt(np.mean(np.square(off))) < 0.06


def test_agreement_by_chance_is_taken_off():
    draw = random.Random(4)
    found = [likeness(" ".join(words(draw, n)), " ".join(words(draw, n))) for n in (5, 5, 6, 9, 50, 400) for _ in range(30)]
    assert np.mean(found) < 0.015 and max(found) < 0.15


def test_empty_bins_take_the_first_filled_one_of_their_own_order():
    prints = fp.Prints(log_bins=5)
    low = np.full(32, fp.EMPTY)
    low[[3, 17, 30]] = [11, 22, 33]
    dense = prints.densified(low)
    for i in range(32):
        order = sorted(range(32), key=lambda j, i=i: int(prints._picks[i, j]))
        assert dense[i] == (low[i] if low[i] != fp.EMPTY else low[next(j for j in order if low[j] != fp.EMPTY)])
    every = fp.Prints(log_bins=5).minima(np.arange(4000, dtype=np.uint64))
    assert (prints.densified(every) == every).all()


def test_parts_merge_by_the_smaller_value():
    prints, shingles = fp.Prints(), shingle_set(" ".join(words(random.Random(1), 500)), 5)
    assert (np.minimum(prints.minima(shingles[:200]), prints.minima(shingles[150:])) == prints.minima(shingles)).all()


def test_short_empty_and_equal_texts():
    p = fp.Prints()
    assert p.of(None) == p.of("") == p.of(" \n\t") == b"" and len(p.of("one")) == 256
    assert likeness("", None) == 1 and likeness("", "one") == 0 and likeness("One two", "one  TWO") == 1 and likeness("one two", "one three") < 0.2
    for bits in (1, 2, 4, 8):
        q = fp.Prints(log_bins=6, bits=bits)
        kept = q.unpacked(q.of("a b c d e f g h"))
        assert len(kept) == 64 and kept.max() < 1 << bits
    with pytest.raises(ValueError):
        fp.Prints(bits=3)


def plain(docs, prints=fp.Prints()):
    import pyspark.sql.functions  # noqa: F401

    rows = sorted(docs, key=lambda d: d[0])
    out = []
    for k, (i, text) in enumerate(rows):
        own, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        out.append((i, len(own), edited, prints.of(own), prints.of(edited), likeness(own, edited), likeness(own, after)))
    return out


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_successors_and_edited_texts(spark, ranges):
    draw = random.Random(8)
    docs = [(i * 7 - 300, " ".join(words(draw, draw.choice((0, 1, 3, 30, 200))))) for i in range(90)] + [(10_001, None), (10_002, "é👍漢" * 9)]
    draw.shuffle(docs)
    rows = fp.against_next(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS id", "'x' AS edited").repartition(5), ranges=ranges).collect()
    got = sorted((r.doc_id, r.n_chars, r.edited, bytes(r.fingerprint), bytes(r.edited_fingerprint), r.near_edited, r.near_next) for r in rows)
    assert got == plain(docs)


def test_one_document_repeated_and_null_ids(spark):
    one = fp.against_next(spark.createDataFrame([(4, "abcd")], "doc_id long, text string")).collect()
    assert [(r.edited, r.near_next) for r in one] == [("abab", 1.0)]
    rows = fp.against_next(spark.createDataFrame([(None, "n n"), (1, "a b"), (1, "c d"), (1, "c d"), (9, None)], "doc_id long, text string"), ranges=3).collect()
    assert len(rows) == 5 and sum(r.doc_id is None for r in rows) == 1
    assert fp.against_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fingerprints_of_a_table(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, None)], "doc_id long, text string")
    made = {r.doc_id: bytes(r.fingerprint) for r in fp.fingerprints(docs).collect()}
    assert made[1] == made[2] == fp.Prints().of("A b c d e f") and made[3] == b""
    joined = fp.fingerprints(docs).crossJoin(fp.fingerprints(docs).limit(1).selectExpr("fingerprint AS other"))
    assert {r[0] for r in joined.select(fp.likeness(joined.fingerprint, joined.other)).collect()} == {0.0, 1.0}
