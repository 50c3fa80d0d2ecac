"""Column helpers for text: trimming and tokens as Python defines them, and counts of contained terms."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space for Unicode-aware trimming; \s with (?U) leaves out the information separators.
EDGE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
GAPS = r"(?U)[\s\x1c-\x1f]+"
WORD = r"[\p{L}\p{N}]+"
#: Rows whose values a task holds as Python objects at once.
ROWS = 200


def by_row(kind: str, made: pa.DataType, one: Callable) -> Callable[..., Column]:
    """one of the values of each row as a function of columns, in Arrow batches of which only ROWS rows at a time are Python objects."""

    @F.arrow_udf(kind)
    def rows(*columns: pa.Array) -> pa.Array:
        pieces = [pa.array([one(*x) for x in zip(*(c.slice(a, ROWS).to_pylist() for c in columns), strict=True)], made) for a in range(0, len(columns[0]), ROWS)]
        return pa.concat_arrays(pieces) if pieces else pa.array([], made)

    return rows


def by_text(kind: str, one: Callable) -> Callable[..., Column]:
    """one of the values of each row as a function of columns with whole texts: rows go to Python and back a hundred at a time
    (spark.sql.execution.python.udf.maxRecordsPerBatch), where an Arrow batch would hold 10,000 texts."""
    return F.udf(one, kind, useArrow=False)


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value planned and evaluated once, however often of() names it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def literals(terms: Sequence[str]) -> Column:
    """The terms as an array column; an empty list gives an empty array of strings."""
    return F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGE, "")


def filled(c: Column, default: str = "") -> Column:
    """c, or the default where it is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def first_filled(*cs: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])


def ws_tokens(c: Column) -> Column:
    return F.filter(F.split(c, GAPS), lambda x: x != "")


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), 0)


def contains_any(c: Column, terms: Sequence[str]) -> Column:
    """Whether c holds one of the terms; without a lambda, so that it may stand inside one."""
    return reduce(or_, (F.contains(c, F.lit(t)) for t in terms)) if terms else F.lit(False)


def contained(c: Column, terms: Sequence[str]) -> Column:
    """Those of the terms that c contains, in their order."""
    return F.filter(literals(terms), lambda t: F.contains(c, t))


def count_contained(c: Column, terms: Sequence[str]) -> Column:
    return F.size(contained(c, terms))


def either_contains(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def sentences(c: Column, delimiters: str) -> Column:
    """Stripped stretches between single delimiter characters, empty ones included."""
    return F.transform(F.split(c, f"[{delimiters}]"), strip)


def first_match(c: Column, patterns: Sequence[str], group: int = 1) -> Column:
    """The group of the first pattern that matches non-empty, null if none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, group), F.lit("")) for p in patterns])


def kept(*conditions: tuple[Column, Column | str]) -> Column:
    """The values whose condition holds, as an array in the given order."""
    made = [F.when(c, v if isinstance(v, Column) else F.lit(v)) for c, v in conditions]
    return F.filter(F.array(*made), lambda x: x.isNotNull())
