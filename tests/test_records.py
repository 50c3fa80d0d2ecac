"""Records of pages: values of state, markup, shared text and defaults for each platform."""

import json
import random

from pyspark.sql import functions as F

from textloom import api
from textloom.functions.lexicons import LATIN, ZH
from textloom.operators import keywords, records


def rec(spark, make, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(make(*map(F.col, values)).alias("r")).first().r


STATES = {
    "answer": {"initialState": {"entities": {"answers": {"9": {"question": {"title": "Q"}, "content": "C", "excerpt": "E", "voteup_count": 4, "comment_count": 2, "author": {"name": "A"}, "created_time": 11, "updated_time": 12}, "10": {"content": "later"}}}}},
    "question": {"x": [{"questions": {"1": {"title": "T", "detail": "D", "excerpt": "E", "visit_count": 50, "comment_count": 1, "author": {"name": "N"}, "topics": [{"name": "t1"}, {"name": "t2"}], "created": 3, "updated_time": 4}}}]},
    "article": {"articles": {"1": {"title": "T", "content": "C", "voteup_count": 5, "author": {"name": "N"}, "created": 3, "updated": 6}}},
    "pin": {"pins": {"1": {"content": "C", "excerpt_new": "X", "like_count": 8, "comment_count": 9, "author": {"name": "N"}, "created": 3, "updated": 6}}},
}


def test_the_four_kinds_of_answers(spark):
    got = {k: rec(spark, lambda p, s, k: records.qa_record(p, records.qa_entry(s, k), k), page="", state=json.dumps(s), kind=k) for k, s in STATES.items()}
    a, q, t, p = (got[k] for k in ("answer", "question", "article", "pin"))
    assert (a.title, a.author, a.content, a.excerpt, a.voteup_count, a.comment_count, a.view_count, a.created_time, a.updated_time, a.topics) == ("Q", "A", "C", "E", 4, 2, 0, "11", "12", [])
    assert (q.title, q.content, q.view_count, q.comment_count, q.topics, q.created_time, q.updated_time) == ("T", "D", 50, 1, ["t1", "t2"], "3", "4")
    assert (t.title, t.content, t.voteup_count, t.created_time, t.updated_time) == ("T", "C", 5, "3", "6")
    assert (p.title, p.content, p.excerpt, p.voteup_count, p.comment_count) == ("知乎想法", "C", "X", 8, 9)


def test_markup_of_answers(spark):
    page = (
        '<meta property="og:title" content="Site 知乎"><h1>other</h1><h1 class="a QuestionHeader-title b">Real &amp; title</h1><div class="RichContent-inner"><p>Some <b>text</b></p></div>'
        '<div class="AuthorInfo-names">no</div><span class="AuthorInfo-name x"><div><a href="/p">Ann</a></div></span>'
    )
    r = rec(spark, lambda p: records.qa_from_markup(p), page=page)
    assert (r.title, r.content, r.author) == ("Real & title", "Some text", "Ann")
    r = rec(spark, records.qa_record, page="<title>only</title>", state=None, kind="pin")
    assert (r.title, r.author, r.content, r.topics) == ("only", "未知作者", "", [])


def test_videos_and_notes(spark):
    video = {"a": {"aweme_list": [{"desc": "words", "author": {"unique_id": "u"}, "statistics": {"play_count": 1200, "digg_count": 3, "comment_count": 0, "share_count": 2}, "video": {"duration": 61, "cover": {"url_list": ["c1", "c2"]}}, "create_time": 77}]}}
    of_state = lambda p, s, x: records.video_record(p, records.video_entry(s), x)
    r = rec(spark, of_state, page='<meta name="description" content="about">', state=json.dumps(video), shared="")
    assert (r.title, r.author, r.description, r.view_count, r.like_count, r.share_count, r.cover_url, r.duration, r.publish_time) == ("words", "u", "about", 1200, 3, 2, "c1", 61, "77")
    text = rec(spark, lambda p, s, x: records.video_text(of_state(p, s, x)), page='<meta name="description" content="about">', state=json.dumps(video), shared="")
    assert text == "标题: words\n作者: u\n\n视频描述:\nabout\n\n播放量: 1,200\n点赞数: 3\n"
    shared = rec(spark, of_state, page="", state=None, shared="#一个很长的标题# 作者：someone")
    assert (shared.title, shared.author) == ("一个很长的标题", "someone")
    note = {"note": {"noteDetailMap": {"k": {"note": {"title": "t", "desc": "d", "user": {"id": "i"}, "imageList": [{"urlDefault": "p"}, {}], "video": {"consumer": {"originVideoKey": "v"}}, "interactInfo": {"likedCount": "12", "collectedCount": "1万"}, "tagList": [{"name": "g"}], "time": 5}}}}}
    n = rec(spark, lambda p, s: records.note_record(p, records.note_entry(s)), page="", state=json.dumps(note))
    assert (n.title, n.author, n.description, n.images, n.video_url, n.like_count, n.collect_count, n.tags, n.publish_time) == ("t", "i", "d", ["p"], "v", 12, 0, ["g"], "5")
    assert rec(spark, lambda p, s: records.note_text(records.note_record(p, records.note_entry(s)), F.lit("图片1: x")), page="", state=json.dumps(note)) == "标题: t\n作者: i\n\n笔记描述:\nd\n\n标签: g\n\n图片文字内容:\n图片1: x\n\n点赞数: 12\n"
    assert [rec(spark, records.note_type, v=v) for v in ("u", "", None)] == ["video", "note", "note"]


def test_defaults_and_captured_answers(spark):
    one = lambda c: spark.range(1).select(c.alias("r")).first().r
    assert (one(records.default_video()).title, one(records.default_note()).title, one(records.default_qa(F.lit("pin"))).title, one(records.default_qa(F.lit("?"))).title) == ("抖音视频", "小红书笔记", "知乎想法", "知乎内容")
    r = rec(spark, records.api_record, info=json.dumps({"title": "T", "owner": {"name": "O"}, "desc": "D", "duration": 9, "stat": {"view": 3}, "pic": "p", "bvid": "BV1"}), tags='[{"tag_name": "a"}, {}]', parts='[{"page": 1, "part": "x", "duration": 4}]')
    assert (r.title, r.author, r.view_count, r.tags, len(r.parts), r.cover_url, r.bvid) == ("T", "O", 3, ["a", ""], 1, "p", "BV1")
    assert rec(spark, lambda i, t, p: records.api_text(records.api_record(i, t, p)), info="{}", tags=None, parts=None) == "标题: 未知标题\n作者: 未知作者\n\n简介:\n\n\n"


def test_page_ids_in_order_of_patterns(spark):
    page = 'x /video/5 item_id=4 "item_id":"3" "video_id":"2"'
    assert rec(spark, records.page_identifier, page=page) == "2" and rec(spark, records.page_identifier, page="/video/77") == "77" and rec(spark, records.page_identifier, page="none") is None


def test_engine_takes_each_platform_from_its_own_source(spark):
    urls = ["https://www.douyin.com/video/1", "https://www.zhihu.com/question/1/answer/9", "https://www.xiaohongshu.com/explore/ab", "https://www.bilibili.com/video/BV1", "https://other.org/"]
    state = {1: json.dumps(STATES["answer"])}
    rows = [(i, u, f"<title>page title {i}</title><script>window.__INITIAL_STATE__ = {state[i]};</script>" if i in state else f"<title>page title {i}</title>", '{"title": "captured", "owner": {"name": "O"}}' if i == 3 else None) for i, u in enumerate(urls)]
    got = {r.doc_id: r for r in api.Engine(spark).extract(spark.createDataFrame(rows, "page_id long, url string, html string, info string")).collect()}
    assert [got[i].title for i in range(5)] == ["page title 0", "Q", "page title 2", "captured", "page title 4"]
    assert got[1].author == "A" and got[1].content.startswith("标题: Q\n作者: A\n类型: answer\n\n摘要:\nE\n\n内容:\nC\n\n赞同数: 4\n") and got[4].status == "error"


def test_rich_analysis(spark):
    text = "the fast nation and the slow nation mention attention. station nation! one nation; creation of attention in the station"
    rows = spark.createDataFrame([(1, "A nation", "", text), (2, "", "", "short")], "doc_id long, title string, description string, content string")
    got = {r.doc_id: r.analysis for r in api.richly_analysed(rows, LATIN).collect()}
    assert got[2].domain == "unknown" and got[2].keywords == [] and got[2].summary == LATIN.texts["too_short"]
    first = got[1].keywords
    assert first[0] == "nation" and len(first) == len(set(first)) and got[1].domain != "unknown" and got[1].text_length > 100
    assert set(keywords.cooccurrence_scores(["a", "b", "a"])) == {"a", "b"} and keywords.cooccurrence_scores(["a", "a"]) == {}
    assert ZH.texts["too_short"] == "内容过短，无法进行有效分析"


def test_rich_analysis_of_long_runs_and_words(spark):
    """Long matches of the patterns took a stack frame a repetition, which ended the executor; long words and blanks quadratic time."""
    names = "Abc Def " * 20_000
    texts = [names + "nation. Ann Lee and the station", "abcdefgh" * 20_000 + " Ann Lee", "a" + " " * 200_000 + "b nation. Ann Lee; the nation"]
    rows = spark.createDataFrame([(i, "", "", t) for i, t in enumerate(texts)], "doc_id long, title string, description string, content string")
    got = [r.analysis for r in api.richly_analysed(rows, LATIN).orderBy("doc_id").collect()]
    assert got[0].entities.person[-2:] == [names.strip(), "Ann Lee"] and got[0].entities.organization[-1:] != names
    assert [g.entities.person[-1] for g in got[1:]] == ["Ann Lee"] * 2 and got[2].key_phrases == ["the nation"]


def test_rich_keywords_are_those_of_both_rankings(spark):
    draw = random.Random(4)
    texts = [" ".join(draw.choice("abcdefghij") + draw.choice("klm12") * draw.randint(0, 2) for _ in range(n)) for n in (0, 1, 2, 50, 400)] + [None, "a the of", "xx yy " * 40]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    rule, words = keywords.keyword_rule(LATIN), lambda c: F.transform(c, lambda x: x["word"])
    both = F.array_union(words(keywords.ranked_words(F.col("t"), rule, 6)), words(keywords.ranked_by_company(F.col("t"), rule, 5)))
    for r in rows.select("t", keywords.united(F.col("t"), rule, 6, 5).alias("got"), both.alias("want")).collect():
        scores = keywords.cooccurrence_scores([w for w in keywords.words_of((r.t or "").lower()) if rule(w)])
        company = sorted(scores, key=lambda w: (-round(scores[w], 9), w))[:5]
        assert r.got == r.want and r.got[:6] + [w for w in company if w not in r.got[:6]] == r.got
