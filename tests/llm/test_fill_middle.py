"""Fill-in-the-middle against a plain loop over lines, and exact round trips."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import fill_middle as fm

TEXTS = ["one\ntwo\nthree", "", None, "\n", "\n\n\n", "a <P> b\n", "no end", "ends\n", "é👍\n漢字\r\nx", "<S", "S>\n<", "a\n" * 500, "<M>", " \n "]


def lines_of(text):
    out, start = [], 0
    for i, c in enumerate(text):
        if c == "\n":
            out.append(text[start : i + 1])
            start = i + 1
    return out + ([text[start:]] if start < len(text) else [])


def plain(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units, digest = lines_of(text), hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("options", [{}, {"rate": 40, "spm": 10, "seed": 3}])
def test_rows_are_those_of_a_plain_loop_and_restore(spark, options):
    docs = [(i, TEXTS[i % len(TEXTS)]) for i in range(140)]
    rows = fm.fill_in_middle(spark.createDataFrame(docs, "doc_id long, text string").withColumn("output", F.lit(1)), **options)
    got = rows.withColumn("again", fm.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=str) == sorted(((i, *plain(i, t, **options)) for i, t in docs), key=str)
    assert sorted((r.doc_id, r.again) for r in got) == sorted((i, t or "") for i, t in docs)


def test_null_and_repeated_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a\nb\n"), (None, "a\nb\n"), (5, "c")], "doc_id long, text string")
    got = fm.fill_in_middle(docs).collect()
    assert len(got) == 3 and len({tuple(r) for r in got}) == 2
    assert fm.fill_in_middle(docs.limit(0)).count() == 0


def test_a_very_long_text(spark):
    text = "word " * 400_000 + "\n" * 50_000 + "tail"
    row = fm.fill_in_middle(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    got = row.select("n", fm.restored(F.col("output"), F.col("form")).alias("again")).first()
    assert got.n == 50_001 and got.again == text


def test_sentinels_that_may_overlap():
    for bad in (("<P>", "<P>", "<M>"), ("aXa", "aYa", "b"), ("", "x", "y"), ("<P>", "P", "<M>")):
        with pytest.raises(ValueError):
            fm.told_apart(bad)


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet="a\n\ré ", max_size=40))
def test_boundaries_are_the_ends_of_lines(text):
    import regex

    ends, at = [], 0
    for line in lines_of(text):
        at += len(line)
        ends.append(at)
    assert fm.boundaries(regex.compile(f"({fm.LINES})*"), text) == ends
