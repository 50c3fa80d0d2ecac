"""Operators on hand-made fixtures, Chinese ones among them; expectations are worked out by hand."""

import pytest
from pyspark.sql import functions as F

from textloom import api
from textloom.functions import context, html, urls
from textloom.functions.lexicons import LATIN, ZH
from textloom.functions.text import strip, ws_tokens
from textloom.operators import analysis, graph, keywords, quality, render, store, supervise
from textloom.sources import sinks


def one(spark, *cols, **values):
    """The values of the columns over one row of the given strings."""
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return tuple(df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def words(*w):
    return F.array(*map(F.lit, w)) if w else F.array().cast("array<string>")


def test_strip_and_tokens_follow_python(spark):
    text = "　  a b\x1c c \n"
    assert one(spark, strip(F.col("t")), ws_tokens(F.col("t")), t=text) == (text.strip(), text.split())


def test_keyword_filter_and_ties(spark):
    rows = spark.createDataFrame([(1, p, w) for p, w in enumerate("技术 方法 的 AI 技术 123 方法 é3 学".split())], "doc_id long, pos int, word string")
    got = keywords.top_keywords(rows.where(keywords.is_keyword(F.col("word"), ZH))).orderBy("rank").collect()
    assert [(r.word, r.n) for r in got] == [("技术", 2), ("方法", 2), ("é3", 1)]


def test_groups_take_the_first_match(spark):
    kw = words("学习方法", "软件工具", "实践策略", "应用", "别的")
    got = {n: one(spark, c)[0] for n, c in keywords.grouped(kw, ZH).items()}
    assert got == {"core": ["别的"], "method": ["学习方法", "实践策略"], "tool": ["软件工具"], "application": ["应用"]}
    over = {n: one(spark, c)[0] for n, c in keywords.overlapping(kw, ZH, F.lit(True)).items()}
    assert over["技术方法"] == ["学习方法", "软件工具"] and over["实践应用"] == ["实践策略", "应用"] and over["其他关键点"] == ["别的"]
    assert {n: one(spark, c)[0] for n, c in keywords.overlapping(kw, ZH, F.lit(False)).items()}["其他关键点"] == ["学习方法", "软件工具", "实践策略", "应用", "别的"]


def test_domain_ties_and_none(spark):
    assert tuple(one(spark, analysis.keyword_domain(words("投资"), ZH))[0]) == ("business", 1.0)  # in two domains: the first declared
    assert tuple(one(spark, analysis.keyword_domain(words("xyz"), ZH))[0]) == ("general", 0.0)
    assert tuple(one(spark, analysis.keyword_domain(words(), ZH))[0]) == ("general", 0.0)
    assert tuple(one(spark, analysis.weighted_domain(F.lit("健康生活"), words("x"), ZH))[0]) == ("lifestyle", 3.2)


def test_entities(spark):
    got = {n: one(spark, c)[0] for n, c in analysis.keyword_entities(words("科技公司", "开放平台", "软件", "技能", "理论"), ZH).items()}
    assert got == {"person": [], "organization": ["科技公司", "开放平台"], "tool": ["软件"], "skill": ["技能"], "concept": ["理论"]}
    found = {n: one(spark, c)[0] for n, c in analysis.pattern_entities(F.lit("王小明老师 said Foo Bar at 大地科技"), words("方法"), ZH).items()}
    assert "方法" in found["concept"] and "大地科技" in found["organization"] and "said Foo Bar at" in found["person"]


def test_phrases_have_two_keywords_and_a_fit_length(spark):
    text = "技术和方法都很重要的一句。技术方法。" + "技术方法" * 26 + "。只有技术的一句话在这里！技术 方法 十个字x"
    assert one(spark, analysis.key_phrases(F.lit(text), words("技术", "方法"), ZH))[0] == ["技术和方法都很重要的一句", "技术 方法 十个字x"]


def test_summaries(spark):
    assert one(spark, analysis.template_summary(F.lit("题"), F.lit("短"), words("a"), ZH))[0] == "关于题的简要内容。"
    long = F.lit("字" * 60)
    assert one(spark, analysis.template_summary(F.lit("题"), long, words("a", "b"), ZH))[0] == "主要内容围绕题展开，涉及a, b等关键概念。"
    text = F.lit("这里没有什么可说的东西呀。技术与方法结合起来能够改变很多很多的事情和人。短。")
    assert one(spark, analysis.extractive_summary(F.lit("题"), text, words("技术", "方法"), words(), ZH))[0] == "技术与方法结合起来能够改变很多很多的事情和人"


def test_edges_and_caps(spark):
    kw = words(*"abcdefgh")
    got = [(e.source, e.target) for e in one(spark, graph.concept_edges(kw))[0]]
    assert got == [(a, b) for i, a in enumerate("abcde") for b in "abcdef"[i + 1 :]][:10]
    assert one(spark, graph.entity_edges({"x": words("a", "b"), "y": words()}))[0] == []
    three = {"x": words(*"abcde"), "y": words(*"fghij"), "z": words(*"klmno")}
    assert len(one(spark, graph.entity_edges(three))[0]) == 15
    assert len(one(spark, graph.functional_edges(words(*"abcd"), words(*"efgh")))[0]) == 10
    assert one(spark, graph.dependencies(words("a", "b")))[0] == [] and len(one(spark, graph.dependencies(kw))[0]) == 2
    assert one(spark, graph.hierarchy(kw))[0] == {"a": ["b", "c", "d"]} and one(spark, graph.hierarchy(words()))[0] == {}


@pytest.mark.parametrize(("n", "text"), [(0, "< 1分钟"), (299, "< 1分钟"), (300, "1分钟"), (17999, "59分钟"), (18000, "1小时0分钟"), (37000, "2小时3分钟")])
def test_reading_time(spark, n, text):
    assert one(spark, graph.reading_time(F.lit(n)))[0] == text


def test_difficulty(spark):
    assert one(spark, graph.difficulty(words("技术", "高级", "复杂", "深入"), F.lit(0), ZH), graph.difficulty(words(), F.lit(9), ZH), graph.difficulty(words("技术"), F.lit(8), ZH)) == ("advanced", "intermediate", "beginner")


def test_links(spark):
    cases = {
        "https://www.douyin.com/video/123?x": ("douyin", "123"), "https://v.douyin.com/Ab1/": ("douyin", None), "http://www.iesdouyin.com/share/video/9": ("douyin", "9"),
        "https://www.bilibili.com/video/BV1xx": ("bilibili", None), "https://xhslink.com/a1": ("xiaohongshu", None), "https://www.zhihu.com/question/5": ("zhihu", None), "ftp://www.douyin.com/video/1": (None, "1"),
    }
    for url, want in cases.items():
        assert one(spark, urls.platform(F.col("u")), urls.identifier(F.col("u"), urls.VIDEO_ID), u=url) == want
    typed = lambda u: one(spark, urls.typed_id(F.col("u")), u=u)[0]
    assert tuple(typed("https://www.zhihu.com/question/5/answer/7")) == ("5-7", "answer") and tuple(typed("https://www.zhihu.com/question/5")) == ("5", "question")
    assert tuple(typed("https://zhuanlan.zhihu.com/p/8")) == ("8", "article") and typed("https://x.com/") is None
    norm = lambda u: one(spark, urls.normalised(F.col("u")), u=u)[0]
    assert norm("https://www.douyin.com/video/1?b=2&ts=3&a=1&b=4&c=#top") == "https://www.douyin.com/video/1?b=2&b=4&a=1"
    assert norm("https://x.com/a?ts=1&b=#f") == "https://x.com/a?ts=1&b=" and norm("https://www.douyin.com/video/1?ts=3") == "https://www.douyin.com/video/1"
    assert one(spark, urls.authority(F.col("u")), u="http://me@h.com:80/x")[0] == "me@h.com:80"
    assert one(spark, urls.content_type(F.lit("zhihu"), F.lit("x/answer/1")), urls.content_type(F.lit("q"), F.lit("")))== ("qa_answer", "digital_content")


def test_markup(spark):
    page = '<TITLE lang="x"> A &amp; <b>B</b> </TITLE><meta content="d" name="description"><img src="1"><img alt="" src=\'2\'><img src="1">'
    h = F.col("h")
    assert one(spark, html.tag_text(h, "title"), html.meta(h, "description"), html.images(h), html.tag_text(h, "h1"), h=page) == ("A & B", "d", ["1", "2"], "")
    assert html.balanced('x{"a":"}\\"}{"}y', 1) == '{"a":"}\\"}{"}' and html.balanced("{", 0) is None
    assert one(spark, html.script_json(["S"])(h), h='S = {bad}; S={"a":{"b":1}};z')[0] == '{"a":{"b":1}}'
    assert one(spark, html.deep_find(["b"])(h), html.deep_find(["z"])(h), h='{"b":"","c":[{"b":2}]}') == ("2", None)


def test_lenient_json(spark):
    j = F.col("j")
    assert one(spark, html.lenient_json(j), j=' {"a":1}\n')[0] == '{"a":1}' and one(spark, html.lenient_json(j), j='So: {"a":{"b":2}} ok')[0] == '{"a":{"b":2}}' and one(spark, html.lenient_json(j), j="no {x}")[0] is None
    full = one(spark, html.assessment(j), j='{"content_depth":100,"practicality":100,"logical_coherence":100,"innovation":100,"professionalism":100}')[0]
    assert full.overall_score == pytest.approx(55) and one(spark, html.assessment(j), j="broken")[0].overall_score == 68.0


def test_context(spark):
    t = F.col("t")
    assert one(spark, context.context_title(t), context.context_author(t), t="@someone long #topic#\nby Anna") == ("someone long", "someone")
    assert one(spark, context.context_title(t), t='@ab "the url" #a good topic')[0] == "a good topic"
    assert one(spark, context.labelled(t, ["作者"]), t="作者：甲\n作者:乙：丙\nx")[0] == "乙：丙"
    assert one(spark, context.clean_title(t), t="抖音 - 我的视频 - 抖音")[0] == "我的视频" and one(spark, context.clean_title(t), t="抖音")[0] == "抖音"
    assert one(spark, context.file_name(t), context.file_name_strict(t), t='a/b: "c"  d') == ("ab_c_d", "a_b___c__d")
    assert len(one(spark, context.file_name(t), t="x" * 60)[0]) == 50 and one(spark, context.file_name_strict(t), t="...")[0] == "untitled"
    assert one(spark, context.overlay(F.lit("p"), F.lit(None).cast("string"), F.lit(True)), context.overlay(F.lit("p"), F.lit("c"), F.lit(True))) == ("p", "c")


def test_gate(spark):
    ok = dict(p="zhihu", t="学习编程的方法", a="甲", d="一段足够长的描述文字在这里", c="学习" + "字" * 60)
    cols = [F.col(k) for k in ok]
    assert one(spark, quality.issues(*cols), **ok)[0] == []
    assert one(spark, quality.issues(*cols), **ok | {"t": "视频_1", "d": ""})[0] == ["title_generated", "title_meaningless", "description_empty"]
    assert one(spark, quality.issues(*cols), **ok | {"c": None})[0] == ["missing_content"]


@pytest.mark.parametrize(("n", "points"), [(0, 0), (999, 59.94), (1000, 60), (3000, 100), (8000, 100), (8001, 99.9975), (20000, 80)])
def test_length_bands(spark, n, points):
    assert one(spark, quality.length_score(F.lit(n)))[0] == pytest.approx(points)


def test_sections_items_and_scores(spark):
    doc = "## 核心概念 x\n- " + "甲" * 20 + "\n- 短\n*暂无" + "：" * 30 + "\n### 方法论\n**" + "乙" * 60
    parts = quality.sections(F.col("d"))
    assert one(spark, quality.items(parts["core_concepts"]), quality.items(parts["methodologies"]), parts["insights"], d=doc) == (1, 1, "")
    assert one(spark, quality.structure_score(parts), d=doc)[0] == pytest.approx(35.0)
    std = {k: one(spark, c)[0] for k, c in quality.adjusted_standards(F.lit("education"), F.lit(2500)).items()}
    assert std == {"factor": pytest.approx(1.44), "pass_threshold": pytest.approx(100.8), "min_core_concepts": 4, "min_methodologies": 2, "min_practical_tips": 4, "min_insights": 2}
    low = {k: one(spark, c)[0] for k, c in quality.adjusted_standards(F.lit("lifestyle"), F.lit(100)).items()}
    assert low["factor"] == pytest.approx(0.56) and low["pass_threshold"] == 50.0  # the branch under 200 is never reached
    zero = {k: F.lit(0) for k in quality.SECTIONS_ZH}
    assert one(spark, quality.priorities(zero, {"practicality": F.lit(50.0)}))[0] == ["core_concepts", "practical_tips", "practicality", "insights", "methodologies"]
    assert one(spark, quality.level(F.lit(90)), quality.level(F.lit(89.9)), quality.level(F.lit(59))) == ("excellent", "good", "bad")


def test_failing_documents_are_done_again(spark):
    rows = spark.createDataFrame([(1, 80.0), (2, 30.0), (3, 0.0)], "doc_id long, base double")
    got = quality.until_passed(rows, lambda d: d.withColumn("overall", F.col("base")), lambda d: d.withColumn("base", F.col("base") + 25), rounds=3)
    assert {r.doc_id: (r.overall, r.retries) for r in got.collect()} == {1: (80.0, 0), 2: (80.0, 2), 3: (75.0, 3)}
    assert one(spark, quality.judged_improvements({"depth": F.lit(60.0), "use": F.lit(80.0)}, words("short", "long advice")))[0] == ["raise_depth", "long advice"]
    assert store.strategies(spark, [("zhihu", 1.0, 2.0, 9)]).where("platform = 'zhihu'").first().at_once == 9


def test_supervision(spark):
    rows = [(1, "zhihu", "知乎", "甲", "综合知识 未知标题 未知作者 视频 内容分析 知识图谱 核心概念"), (2, "zhihu", "一个足够长的标题在此", "乙", "词 " * 400), (3, "zhihu", "一个足够长的标题在此", "未知作者", "词 " * 400)]
    got = {r.doc_id: r for r in supervise.scored(spark.createDataFrame(rows, "doc_id long, platform string, title string, author string, content string")).collect()}
    assert got[1].issues == ["title_short", "content_short", "title_forbidden", "template", "few_words", "forbidden_title"] and got[1].quality_score == 0.0
    assert got[2].issues == ["few_words"] and got[2].quality_score == pytest.approx(0.8)
    assert got[3].issues == ["duplicate", "few_words", "default_author"] and got[3].quality_score == pytest.approx(0.4)


def test_batch_counts_only_successes(spark):
    rows = spark.createDataFrame([("a", "success", "视频"), ("a", "success", "好标题"), ("a", "error", "视频"), ("b", "error", "x")], "platform string, status string, title string")
    assert [tuple(r) for r in supervise.batch_report(rows).collect()] == [("a", 2, 2, 1)]
    assert tuple(supervise.batch_totals(rows).first()) == (4, 2, 1, 3, False)
    assert supervise.batch_totals(rows.where("false")).first().alert is False
    assert [tuple(r) for r in supervise.recommendations(supervise.batch_report(rows)).collect()] == [("a", "check_extractor"), ("all", "check_templates"), ("all", "check_sources")]


def test_cache(spark):
    rows = spark.sql("select * from values (1L,'k1',timestamp_ntz'2024-01-01 00:00:00',5L),(2L,'k1',timestamp_ntz'2024-01-02 00:00:00',5L),(3L,'k2',timestamp_ntz'2024-01-02 00:00:00',5L) as t(event_id,url_hash,cached_at,file_size)")
    now = F.expr("timestamp_ntz'2024-01-03 00:00:00'")
    assert sorted(r.event_id for r in store.valid(rows, now, "24 hours").collect()) == [2, 3]  # an age of exactly the limit is valid
    assert sorted(r.event_id for r in store.upserted(rows).collect()) == [2, 3]
    assert sorted(r.event_id for r in store.evicted(rows, 10).collect()) == [2, 3] and store.evicted(rows, 15).count() == 3 and store.evicted(rows.where("false"), 0).count() == 0
    assert tuple(store.stats(rows, now, "24 hours").first()) == (3, 2, 1, 15)


def test_settings_and_isolation(spark):
    got = {v: tuple(one(spark, store.coerced(F.col("v")), v=v)[0]) for v in ("true", "1", "0", "No", "3", "3.5", "[1]", "{bad", "text")}
    assert got == {"true": ("bool", "true"), "1": ("bool", "true"), "0": ("bool", "false"), "No": ("bool", "false"), "3": ("int", "3"), "3.5": ("float", "3.5"), "[1]": ("json", "[1]"), "{bad": ("string", "{bad"), "text": ("string", "text")}
    rows = store.isolated(spark.createDataFrame([(1,), (0,)], "x long"), lambda r: {"y": 10 // r["x"]}, "y long").orderBy("x").collect()
    assert [(r.y, r.status) for r in rows] == [(None, "error"), (10, "success")]


def test_names_and_rendering(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "a b", "c", "a  b"])] + [(2500, "a b")], "doc_id long, title string")
    assert {r.doc_id: r.file_name for r in sinks.named(rows).collect()} == {0: "a_b.md", 1: "a_b_1.md", 2: "c.md", 3: "a_b_2.md", 2500: "a_b_3.md"}
    assert one(spark, render.content_text(F.lit("t"), F.lit("a"), F.lit(""), F.lit(1234567)))[0] == "Title: t\nAuthor: a\nViews: 1,234,567"
    assert one(spark, render.tags(F.lit("www"), F.lit("article"), F.lit("x")))[0] == ["knowledge", "analysis", "site", "web", "article", "reading", "x"]
    assert "## Takeaways\n\n- k" in one(spark, render.knowledge_markdown(F.lit('{"core_topic":"c","key_takeaways":["k"]}')))[0]


def test_engine(spark):
    body = "学习编程的方法与技术。" * 30
    rows = [(1, "https://www.zhihu.com/question/1", f'<title>学习编程的好方法</title><meta name="author" content="甲"><meta name="description" content="关于学习编程方法的描述文字"><p>{body}</p>'), (2, "https://other.org/", "<p>x</p>"), (3, "https://zhuanlan.zhihu.com/p/2", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    engine = api.Engine(spark)
    got = {r.doc_id: r for r in engine.process(pages, F.lit("2024-01-01")).collect()}
    assert got[1].status == "success" and got[1].document.startswith("# 学习编程的好方法\n\n> 2024-01-01") and got[2].status == got[3].status == "error"
    assert got[2].platform == "unsupported" and "title_empty" in got[3].message and got[2].document is None
    cache = pages.where("page_id = 1").select(urls.url_key(F.col("url")).alias("url_hash"), F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("cached_at"))
    assert {r.doc_id for r in engine.batch(pages, cache, F.expr("timestamp_ntz'2024-01-01 12:00:00'")).collect()} == {2, 3}
    assert engine.supported_platforms().count() == 4


def test_caps_hold_on_documents(spark):
    from textloom.plans import documents

    rows = documents.ranked(spark, "/root/testdata/sf0.001")
    sizes = rows.select(F.max(F.size("keywords")), *[F.max(F.size(c)) for c in analysis.keyword_entities(F.col("keywords"), LATIN).values()]).first()
    assert sizes[0] <= 20 and max(sizes[1:]) <= 5
    scattered = rows.repartition(7).select("doc_id", "keywords").collect()
    assert sorted(map(str, scattered)) == sorted(map(str, rows.select("doc_id", "keywords").collect()))


def test_template_ratio_stays_in_the_engine(spark):
    rows = spark.createDataFrame([("视频", "综合知识 abc"), ("x", None), ("x", "未知标题视频视频"), ("未知标题", "")], "title string, content string")
    got = rows.select(supervise.template_ratio(F.col("title"), F.col("content")).alias("r"))
    assert [round(r.r * 9) for r in got.collect()] == [2, 0, 2, 1] and "EvalPython" not in got._jdf.queryExecution().executedPlan().toString()
