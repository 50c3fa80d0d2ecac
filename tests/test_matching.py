"""Terms in texts by one automaton, against a plain look for each term."""

import random

from pyspark.sql import functions as F

from textloom.functions import matching
from textloom.operators import keywords


def test_terms_inside_and_around():
    draw = random.Random(7)
    for _ in range(200):
        terms = ["".join(draw.choice("ab ") for _ in range(draw.randint(0, 4))) for _ in range(draw.randint(0, 9))]
        own = matching.Terms(terms)
        for _ in range(10):
            text = "".join(draw.choice("abc ") for _ in range(draw.randint(0, 9)))
            assert own.inside(text) == {i for i, t in enumerate(terms) if t in text}
            assert own.related(text) == {i for i, t in enumerate(terms) if t in text or text in t}


def test_columns(spark):
    groups = [["数据", "a"], [], ["a", "ab", ""]]
    rows = spark.createDataFrame([("ab 数据", ["a", "x", ""]), ("", []), (None, None), ("zz", ["abc"])], "t string, w array<string>")
    got = rows.select(matching.term_numbers(F.col("t"), [t for g in groups for t in g]), matching.term_counts(F.col("t"), groups), matching.related_counts(F.col("w"), groups)).collect()
    assert [tuple(r) for r in got] == [([0, 1, 2, 3, 4], [2, 0, 3], [3, 0, 7]), ([4], [0, 0, 1], [0, 0, 0]), (None, [0, 0, 0], None), ([4], [0, 0, 1], [1, 0, 3])]


def test_word_totals_are_taken_once_a_document(spark):
    docs = spark.createDataFrame([(1, "aa bb aa"), (2, "bb cc"), (2, "bb cc"), (3, None)], "doc_id long, text string")
    from textloom.functions.lexicons import LATIN

    rows = keywords.tfidf(docs, 4, LATIN)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "inline(" not in plan and "aggregate(" not in plan  # the exploded rows are read from a table
    assert sorted((r.doc_id, r.rank, r.word) for r in rows.collect()) == [(1, 1, "aa"), (1, 2, "bb"), (2, 1, "cc"), (2, 1, "cc"), (2, 2, "bb"), (2, 2, "bb")]


def test_few_rows_at_a_time_are_python_objects(spark):
    import pyarrow as pa

    from textloom.functions import text

    rows = spark.range(0, 3 * text.ROWS + 7, 1, 1).selectExpr("id", "if(id % 5 = 0, null, cast(id as string)) as t")
    plan = text.by_row("int", pa.int32(), lambda t: None if t is None else len(t))
    got = rows.select("id", plan("t").alias("n")).collect()
    assert [r.n for r in got] == [None if r.id % 5 == 0 else len(str(r.id)) for r in got] and rows.limit(0).select(plan("t")).collect() == []
