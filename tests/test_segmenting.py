"""Words of unspaced text: counts against plain Python, the likeliest path against all paths, and what the keyword family makes of it."""

import math
import random
from collections import Counter

import pytest

from textloom.functions.lexicons import LATIN
from textloom.operators import keywords, segmenting

WORDS = ["天地", "玄黄", "宇宙", "洪荒大", "日月", "盈", "昃", "辰宿列", "张"]


def all_cuts(words, floor, run):
    """Every way to cut a run, each with its weight."""
    if not run:
        yield 0.0, []
    for k in range(1, len(run) + 1):
        if k == 1 or run[:k] in words:
            for weight, rest in all_cuts(words, floor, run[k:]):
                yield words.get(run[:k], floor) + weight, [run[:k], *rest]


def test_path_is_the_best_of_all():
    draw = random.Random(2)
    for _ in range(300):
        grams = ["".join(draw.choice("甲乙丙") for _ in range(draw.randint(1, 4))) for _ in range(6)]
        words = {g: -draw.random() * 9 for g in grams}
        vocab = segmenting.Vocabulary(words)
        run = "".join(draw.choice("甲乙丙丁") for _ in range(draw.randint(0, 9)))
        cut = vocab.cut(run)
        weight = sum(words.get(w, vocab.floor) for w in cut)
        assert "".join(cut) == run and weight == pytest.approx(max(w for w, _ in all_cuts(words, vocab.floor, run)))


def test_of_equal_paths_the_longer_first_word_wins():
    assert segmenting.Vocabulary({"甲乙": -1.0, "丙": -1.0, "甲": -1.0, "乙丙": -1.0}).cut("甲乙丙") == ["甲乙", "丙"]


def corpus(n=400, seed=5):
    draw = random.Random(seed)
    return [(i, "。".join("".join(draw.choice(WORDS) for _ in range(draw.randint(1, 8))) for _ in range(4)) + " and 2024 words") for i in range(n)]


def plain_words(texts, found=segmenting.Found()):
    import regex

    runs = [r for t in texts for r in regex.findall(segmenting.UNSPACED, t)]
    n = Counter(r[i : i + k] for r in runs for k in range(1, found.longest + 2) for i in range(len(r) - k + 1))
    total = sum(c for g, c in n.items() if len(g) == 1)
    entropy = lambda counts: -sum(c / sum(counts) * math.log(c / sum(counts)) for c in counts if c)
    out = {g: (c, 0.0, 0.0) for g, c in n.items() if len(g) == 1}
    for g, c in n.items():
        if 2 <= len(g) <= found.longest and c >= found.least:
            cohesion = min(math.log(c * total / (n[g[:k]] * n[g[k:]])) for k in range(1, len(g)))
            sides = [[m for w, m in n.items() if len(w) == len(g) + 1 and side(w) == g] for side in (lambda w: w[:-1], lambda w: w[1:])]
            freedom = min(entropy([*s, c - sum(s)]) for s in sides)
            if cohesion >= found.cohesion and freedom >= found.freedom:
                out[g] = (c, cohesion, freedom)
    return out


def test_discovered_words_are_those_of_plain_counting(spark):
    docs = spark.createDataFrame([*corpus(), (900, None), (901, ""), (902, "latin only"), (903, "盈" * 3000)], "doc_id long, text string").repartition(3)
    found = segmenting.Found(cohesion=1.0, freedom=0.8)
    got = {r.word: (r.n, r.cohesion, r.freedom) for r in segmenting.discovered(segmenting.runs(docs), found).collect()}
    want = plain_words([t for _, t in corpus()] + ["盈" * 3000], found)
    assert got.keys() == want.keys()
    for word, row in got.items():
        assert row == pytest.approx(want[word], abs=1e-9)
    assert {"天地", "玄黄", "宇宙", "日月"} <= got.keys()


def test_counts_do_not_depend_on_when_a_task_passes_them_on(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(30), "doc_id long, text string")
    whole = sorted(map(tuple, segmenting.gram_counts(segmenting.runs(docs), 3).collect()))
    monkeypatch.setattr(segmenting, "HELD_GRAMS", 5)
    monkeypatch.setattr(segmenting, "PIECE", 4)
    assert sorted(map(tuple, segmenting.gram_counts(segmenting.runs(docs), 3).collect())) == whole


@pytest.mark.parametrize("longest", [1, 2, 3, 5])
def test_words_of_any_length_are_those_of_plain_counting(spark, longest):
    docs = spark.createDataFrame(corpus(80), "doc_id long, text string").repartition(3)
    found = segmenting.Found(longest=longest, cohesion=0.5, freedom=0.3)
    got = {r.word: (r.n, r.cohesion, r.freedom) for r in segmenting.discovered(segmenting.runs(docs), found).collect()}
    want = plain_words([t for _, t in corpus(80)], found)
    assert got.keys() == want.keys() and all(row == pytest.approx(want[w], abs=1e-9) for w, row in got.items())


def test_long_grams_with_rare_parts_are_not_counted(spark):
    draw = random.Random(1)
    letters = [chr(0x4E00 + i) for i in range(3000)]
    texts = ["".join(draw.choice(letters) for _ in range(500)) for _ in range(40)] + ["天地玄黄宇"] * 6
    runs = segmenting.runs(spark.createDataFrame([(t,) for t in texts], "text string"))
    often = runs.sparkSession.createDataFrame([("天地玄",), ("地玄黄",)], "gram string")
    filtered = segmenting._counted(runs, [4], segmenting._gram_filter(often.limit(0), 3), segmenting._gram_filter(often, 3)).collect()
    assert ("天地玄黄", 6) in {(r.gram, r.n) for r in filtered} and len(filtered) < 200


def test_no_text_gives_no_words(spark):
    empty = spark.createDataFrame([(1, None), (2, "only latin")], "doc_id long, text string")
    words = segmenting.discovered(segmenting.runs(empty))
    assert words.collect() == []
    assert segmenting.vocabulary(words).tokens("天地 x") == ["天", "地", "x"]


def test_keywords_take_the_words(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    vocab = segmenting.vocabulary(segmenting.discovered(segmenting.runs(docs), segmenting.Found(cohesion=1.0, freedom=0.8)), terms={"洪荒大": 400})
    cut = segmenting.cutter(spark, vocab)
    assert vocab.tokens("天地玄黄 and 洪荒大2x") == ["天地", "玄黄", "and", "洪荒大", "2x"]
    got = keywords.top_words(docs, keywords.keyword_rule(LATIN), k=50, cut=cut).collect()
    rule, want = keywords.keyword_rule(LATIN), set()
    for i, t in corpus():
        want |= {(i, w, n) for w, n in Counter(w for w in vocab.tokens(t) if rule(w)).items()}
    assert {(r.doc_id, r.word, r.n) for r in got} == want and {"天地", "宇宙"} <= {r.word for r in got}
    one = docs.limit(1)
    assert keywords.keyword_arrays(one, LATIN, cut=cut).first().keywords and keywords.tfidf(docs, 400, LATIN, cut=cut).count() > 400 and keywords.textrank(one, LATIN, cut=cut).count() > 0


def test_the_engine_takes_the_words(spark):
    from pyspark.sql import functions as F

    from textloom import api
    from textloom.functions.lexicons import ZH

    text = "数据分析方法很好数据分析方法" * 3
    vocab = segmenting.Vocabulary({"数据": -2.0, "分析": -2.0, "方法": -2.0, "很好": -3.0})
    rows = spark.createDataFrame([(1, "题", text)], "doc_id long, title string, text string")
    assert api.analysed(rows, ZH, segmenting.cutter(spark, vocab)).first().keywords == ["数据", "分析", "方法", "很好"]
    assert api.analysed(rows, ZH).first().keywords == [text]
    page = f"<title>一个很长的标题</title><p>{text * 9}</p>"
    engine = api.Engine(spark, vocabulary=vocab)
    made = engine.process(spark.createDataFrame([(1, "https://www.zhihu.com/question/5", page)], "page_id long, url string, html string"), F.lit("2024-01-01")).first()
    assert made.document is None or "数据" in made.document


def test_grams_are_numbers_until_they_are_counted(spark):
    """As strings, every gram of a long text passed through the engine's counting; numbers keep all letters, up to the last code point."""
    draw = random.Random(3)
    texts = ["".join(chr(draw.choice([0, 65, 0x4E00, 0x4E01, 0x10FFFF])) for _ in range(draw.randint(0, 40))) for _ in range(60)]
    rows = spark.createDataFrame([(t,) for t in texts], "run string").repartition(3)
    want = Counter(t[i : i + k] for t in texts for k in range(1, 8) for i in range(len(t) - k + 1))
    made = segmenting._counted(rows, range(1, 8))
    assert {r.gram: r.n for r in made.collect()} == want and made.count() == len(want)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [key0" in plan and "Aggregate [gram" not in plan


def test_few_words_of_many_letters_keep_their_order():
    vocab = segmenting.Vocabulary({"甲": -9.0, "甲乙": -1.0, "乙丙": -1.0, "丙": -3.0, "甲乙丙丁": -2.0}, floor=-0.5)
    for run in ("", "甲", "丁", "甲乙丙", "丁甲乙丙丁", "甲" * 5000 + "乙丙"):
        weight = lambda words: sum(vocab.words.get(w, vocab.floor) for w in words)
        cut = vocab.cut(run)
        assert "".join(cut) == run and (len(run) > 9 or weight(cut) == max(w for w, _ in all_cuts(vocab.words, vocab.floor, run)))


@pytest.mark.parametrize("name", ["segmented_text", "segmented_top20"])
def test_unspaced_text_is_made_once(spark, name, tmp_path, monkeypatch):
    from textloom.plans import segments

    made = []
    monkeypatch.setattr(segments, "unspaced", lambda s, d, own=segments.unspaced: made.append(d) or own(s, d))
    text = "One two, the twentieth of THIRTEEN.\nÉlan? x2!" * 30
    spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = segments.Q[name](spark, str(tmp_path))
    assert out.count() >= 0 and len(made) == 1
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "documents.parquet" not in "".join(out.inputFiles()) and plan.count("PythonUDF") <= 1 and "md5" not in plan


def test_unspaced_text_is_that_of_the_sql(spark):
    import duckdb

    from textloom.plans import segments

    got = dict(segments.unspaced(spark, "/root/testdata/sf0.001").collect())
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    assert got == dict(con.execute(f"WITH {segments._UNSPACED} SELECT doc_id, text FROM z").fetchall())
