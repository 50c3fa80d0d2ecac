"""Registered queries over text without spaces, which is made of every document's words.

The given tables hold no such text. Each word becomes one to three letters of a block of 256 Han characters, chosen by its
digest, with nothing between words; full stops and line ends stay as ends of runs.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import lexicons
from textloom.functions.text import by_text
from textloom.operators import keywords, segmenting
from textloom.sources.shared import written

Q, SQL = {}, {}
FOUND = segmenting.Found()


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


class _Letters(dict):
    """The letters of words, made when one first comes; a worker keeps those of the first 100,000."""

    def __missing__(self, word: str) -> str:
        digest = hashlib.md5(word.encode(), usedforsecurity=False).digest()
        out = "".join([chr(0x4E00 + digest[i]) for i in range(1 + (len(word) > 3) + (len(word) > 8))])
        if len(self) < 100_000:
            self[word] = out
        return out


#: Ends of runs, which become full stops; no text has these of its own left.
_KEPT = keywords.Kept({ord(c): " 。 " for c in ".!?\n"})


def unspaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) of the documents without spaces."""
    letters = _Letters({"。": "。"})

    def one(text: str) -> str:
        return "".join(map(letters.__getitem__, text.translate(_KEPT).split()))

    made = by_text("string", one)(F.lower(F.coalesce("text", F.lit(""))))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", made.alias("text"))


_LETTER = "chr(19968 + ('0x' || substr(md5(w), {}, 2))::INTEGER)"
_LETTERS = " || ".join([_LETTER.format(1), f"CASE WHEN length(w) > 3 THEN {_LETTER.format(3)} ELSE '' END", f"CASE WHEN length(w) > 8 THEN {_LETTER.format(5)} ELSE '' END"])
_UNSPACED = rf"""z AS (SELECT doc_id, coalesce(array_to_string(list_transform(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+|[.!?\n]'),
  lambda w: CASE WHEN w IN ('.', '!', '?', chr(10)) THEN '。' ELSE {_LETTERS} END), ''), '') AS text FROM documents)"""


def _side(wider: str, name: str) -> str:
    return f"""{name} AS (SELECT t.gram, greatest(ln(t.n) - (coalesce(logs, 0) + CASE WHEN t.n > coalesce(inside, 0) THEN (t.n - coalesce(inside, 0)) * ln(t.n - coalesce(inside, 0)) ELSE 0 END) / t.n, 0) AS {name}
  FROM tied t LEFT JOIN (SELECT {wider} AS gram, sum(n) AS inside, sum(n * ln(n)) AS logs FROM c WHERE length(gram) >= 3 GROUP BY 1) b ON t.gram = b.gram)"""


@query(rf"""WITH {_UNSPACED}, r AS (SELECT unnest(regexp_extract_all(text, '\p{{Han}}+')) AS run FROM z),
k AS (SELECT run, unnest(range(1, least(length(run), {FOUND.longest + 1}) + 1)) AS k FROM r),
g AS (SELECT substr(run, i, k) AS gram FROM (SELECT run, k, unnest(range(1, length(run) - k + 2)) AS i FROM k)),
c AS (SELECT gram, count(*) AS n FROM g GROUP BY gram),
total AS (SELECT sum(n) AS total FROM c WHERE length(gram) = 1),
often AS (SELECT gram, n, unnest(range(1, length(gram))) AS k FROM c WHERE length(gram) BETWEEN 2 AND {FOUND.longest} AND n >= {FOUND.least}),
tied AS (SELECT o.gram, o.n, min(ln(o.n::DOUBLE * total / (h.n * t.n))) AS cohesion FROM often o JOIN c h ON h.gram = substr(o.gram, 1, o.k) JOIN c t ON t.gram = substr(o.gram, o.k + 1), total
  GROUP BY o.gram, o.n HAVING min(ln(o.n::DOUBLE * total / (h.n * t.n))) >= {FOUND.cohesion}),
{_side("substr(gram, 1, length(gram) - 1)", "r_side")},
{_side("substr(gram, 2)", "l_side")}
SELECT t.gram AS word, n, round(cohesion, 6) AS cohesion, round(least(r_side, l_side), 6) AS freedom FROM tied t JOIN r_side ON t.gram = r_side.gram JOIN l_side ON t.gram = l_side.gram
WHERE least(r_side, l_side) >= {FOUND.freedom} UNION ALL SELECT gram, n, 0, 0 FROM c WHERE length(gram) = 1""")
def discovered_words(spark, sf_dir):
    words = segmenting.discovered(segmenting.runs(unspaced(spark, sf_dir)), FOUND)
    return words.select("word", "n", F.round("cohesion", 6).alias("cohesion"), F.round("freedom", 6).alias("freedom"))


def _cut(spark: SparkSession, docs: DataFrame):
    return segmenting.cutter(spark, segmenting.vocabulary(segmenting.discovered(segmenting.runs(docs), FOUND)))


@query()
def segmented_text(spark, sf_dir):
    docs = written(unspaced(spark, sf_dir), "unspaced")  # read for its words, and to be cut
    return docs.select("doc_id", segmenting.segmented_line(F.col("text"), _cut(spark, docs)).alias("words"))


@query()
def segmented_top20(spark, sf_dir):
    docs = written(unspaced(spark, sf_dir), "unspaced")  # read for its words, and to be cut
    return keywords.top_words(docs, keywords.keyword_rule(lexicons.LATIN), cut=_cut(spark, docs))
