"""Each registered query with SQL against DuckDB on the smallest tables; lexicon queries must match some rows and not all."""

import glob
import os

import duckdb
import pytest

from textloom.plans import documents, pages, quality

SF = "/root/testdata/sf0.001"
QUERIES = documents.Q | pages.Q | quality.Q
SQL = documents.SQL | pages.SQL | quality.SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    return con


def rounded(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(float(f"{r[i]:.9g}") if isinstance(r[i], float) else r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = duck.execute(SQL[name])
    assert sorted(df.columns) == sorted(c[0] for c in got.description)
    assert rounded(df.collect(), df.columns) == rounded(got.fetchall(), [c[0] for c in got.description])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize(("name", "column"), [("domain_kg", "domain"), ("difficulty", "difficulty"), ("quality_level", "level"), ("validate_gate", "valid"), ("title_valid", "valid"), ("low_quality", "low")])
def test_lexicons_are_not_vacuous(spark, name, column):
    assert QUERIES[name](spark, "/root/testdata/sf0.01").select(column).distinct().count() > 1


def test_entry_module():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
