"""Keywords inside the row: plans without a shuffle, repeated ids, and rankings against plain Python."""

import math
import re
from collections import Counter, defaultdict

import regex
from pyspark.sql import functions as F

from textloom.functions.lexicons import LATIN, ZH
from textloom.functions.text import WORD
from textloom.operators import keywords
from textloom.plans import documents

SF = "/root/testdata/sf0.001"


def test_no_exchange(spark):
    for name in ("keyword_top20", "domain_kg", "concept_edges", "difficulty"):
        plan = documents.Q[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, name


def test_rows_of_one_id_are_apart(spark):
    rows = spark.createDataFrame([(1, "alpha beta"), (1, "gamma gamma"), (2, None), (3, "")], "doc_id long, text string")
    got = sorted((r.doc_id, list(r.keywords)) for r in keywords.keyword_arrays(rows, LATIN).collect())
    assert got == [(1, ["alpha", "beta"]), (1, ["gamma"]), (2, []), (3, [])]
    scored = keywords.tfidf(rows, 4, LATIN).where("rank = 1").select("word").collect()
    assert sorted(r.word for r in scored) == ["alpha", "gamma"]


def test_row_counts_equal_counts_of_token_rows(spark):
    docs = documents.docs(spark, SF)
    for lexicon in (LATIN, ZH):
        by_rows = keywords.top_keywords(keywords.tokens(docs).where(keywords.is_keyword(F.col("word"), lexicon)))
        inside = keywords.top_words(docs, keywords.keyword_rule(lexicon))
        assert sorted(map(tuple, inside.collect())) == sorted(map(tuple, by_rows.collect()))


def plain_textrank(words, window=4, iterations=5, damping=0.85):
    weight, out = Counter(), defaultdict(int)
    for i, a in enumerate(words):
        for b in words[i + 1 : i + 1 + window]:
            if a != b:
                weight[a, b] += 1
                weight[b, a] += 1
    for (a, _), n in weight.items():
        out[a] += n
    score = dict.fromkeys(out, 1.0)
    for _ in range(iterations):
        got = defaultdict(float)
        for (a, b), n in weight.items():
            got[b] += n / out[a] * score[a]
        score = {w: 1 - damping + damping * got[w] for w in score}
    return score


def test_textrank_against_plain_python(spark):
    texts = {r.doc_id: r.text for r in documents.docs(spark, SF).collect()}
    rows = defaultdict(list)
    for r in documents.Q["keyword_textrank"](spark, SF).orderBy("doc_id", "rank").collect():
        rows[r.doc_id].append((r.word, r.score))
    rule = keywords.keyword_rule(LATIN)
    for i, t in texts.items():
        words = [w for w in re.findall(r"[^\W_]+", t.lower()) if rule(w)]
        want = plain_textrank(words)
        got = rows[i]
        assert len(got) == min(20, len(want)) and all(math.isclose(v, want[w], abs_tol=1e-6) for w, v in got)
        left = max((v for w, v in want.items() if w not in dict(got)), default=-1)
        assert not got or got[-1][1] >= left - 1e-6


def test_words_are_those_of_the_pattern():
    every = "".join(f"{chr(c)}a" if c % 3 else chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for text in (every, "", " ", "a_b\x1cc\u3000d\xa0é\u0301x 12,5"):
        assert keywords.words_of(text) == regex.findall(WORD, text)


def plain_tfidf(texts, rule, k):
    counts = [Counter(w for w in re.findall(r"[^\W_]+", t.lower()) if rule(w)) for t in texts]
    df = Counter(w for c in counts for w in c)
    out = []
    for i, c in enumerate(counts):
        scored = [(-round(n / sum(c.values()) * math.log(len(texts) / df[w]), 9), at, w) for at, (w, n) in enumerate(c.items())]
        out += [(i, rank, w, -minus) for rank, (minus, _, w) in enumerate(sorted(scored)[:k], 1)]
    return out


def test_tfidf_leaves_out_only_words_that_cannot_be_among_the_best(spark):
    texts = [r.text for r in documents.docs(spark, SF).collect()]
    texts += ["aa bb cc dd ee ff", "ff ee dd cc bb aa", "aa aa bb", ""]  # equal scores: by place
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rule = keywords.keyword_rule(LATIN)
    want = plain_tfidf(texts, rule, 5)
    for known in (0, 300, 100_000):
        got = sorted(map(tuple, keywords.tfidf(docs, len(texts), LATIN, 5, known_words=known).collect()))
        assert [x[:3] for x in got] == [x[:3] for x in want] and all(math.isclose(x[3], y[3], abs_tol=2e-9) for x, y in zip(got, want, strict=True))
    dfs = keywords.word_frequencies(docs, rule).cache()
    known, rest = keywords.frequent_words(dfs, 300)
    assert 0 < len(known) <= 300 and rest == dfs.where(~F.col("word").isin(*known)).agg(F.max("df")).first()[0]
    rows = docs.withColumn("row", F.col("doc_id"))
    likely = keywords.likely_words(rows, len(texts), 5, spark.sparkContext.broadcast(known), rest, rule).count()
    pairs = dfs.agg(F.sum("df")).first()[0]
    assert len(want) <= likely < pairs / 2


def test_whole_texts_go_to_python_a_few_at_a_time(spark):
    for name, steps in (("keyword_group_overlap", 1), ("summary_template", 1), ("summary_extractive", 2)):
        plan = documents.Q[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BatchEvalPython") == steps and "ArrowEvalPython" not in plan, name
        assert plan.count("aggregate(") <= 5 * len(LATIN.domains), name  # the domain is not planned anew for each use
