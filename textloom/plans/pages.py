"""Registered queries over pages, events and fixtures: links, titles, markup, cache, batches and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import context, html, tree, urls
from textloom.operators import records, render, store
from textloom.plans import sqltext as q
from textloom.sources import sinks

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).withColumn("title", html.tag_text(F.col("html"), "title"))


def unescape(x: str) -> str:
    for name, char in html.ENTITIES:
        x = f"replace({x}, {q.text(name)}, {q.text(char)})"
    return x


def tag(name: str) -> str:
    inner = rf"regexp_extract(html, '(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}>', 1)"
    return q.strip(unescape(f"regexp_replace({inner}, '(?s)<[^>]*>', '', 'g')"))


_HOST_SQL = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
HOSTS = (("blog", (r"^https?://blog\.",)), ("m", (r"^https?://m\.",)), ("www", (r"^https?://www\.",)))
PARTS = (("net", (".net/", ".net?")), ("org", (".org",)))
LANGS = (("english", r"/(en)/(\d+)"), ("german", r"/(de)/(\d+)"), ("french", r"/(fr)/(\d+)"))
PLATFORM = "CASE " + " ".join(f"WHEN regexp_matches(url, '{p[0]}') THEN {q.text(n)}" for n, p in HOSTS) + " END"


@query(f"SELECT page_id, {PLATFORM} AS platform FROM pages")
def url_platform(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.platform(F.col("url"), HOSTS).alias("platform"))


def _by_parts(default: str) -> str:
    return "CASE " + " ".join(f"WHEN {q.any_in('lower(url)', p)} THEN {q.text(n)}" for n, p in PARTS) + f" ELSE {q.text(default)} END"


@query(f"SELECT page_id, {_by_parts('default')} AS platform FROM pages")
def url_platform_strategy(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.platform_by_parts(F.col("url"), PARTS, "default").alias("platform"))


@query(f"SELECT page_id, {_by_parts('unknown')} AS platform FROM pages")
def url_platform_supervisor(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.platform_by_parts(F.col("url"), PARTS, "unknown").alias("platform"))


IDS = (r"/(\d+)\.html", r"/(\d+)/", r"/(\d+)")


@query("SELECT page_id, coalesce(" + ", ".join(f"nullif(regexp_extract(url, '{p}', 1), '')" for p in IDS) + ") AS id FROM pages")
def url_ids(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.identifier(F.col("url"), IDS).alias("id"))


_CASES = [f"WHEN regexp_matches(url, '{p}') THEN {{}}" for _, p in LANGS]
_ID = "CASE " + " ".join(c.format(f"regexp_extract(url, '{p}', 1) || '-' || regexp_extract(url, '{p}', 2)") for c, (_, p) in zip(_CASES, LANGS, strict=True)) + " END"
_TYPE = "CASE " + " ".join(c.format(q.text(n)) for c, (n, _) in zip(_CASES, LANGS, strict=True)) + " END"


@query(f"SELECT page_id, {_ID} AS id, {_TYPE} AS type FROM pages")
def url_typed_id(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.typed_id(F.col("url"), LANGS).alias("t")).select("page_id", "t.*")


@query(f"""SELECT page_id, CASE coalesce({PLATFORM}, '') WHEN 'blog' THEN CASE WHEN contains(url, 'zvideo') THEN 'knowledge_video' WHEN contains(url, 'zhuanlan') THEN 'article'
WHEN contains(url, 'answer') THEN 'qa_answer' ELSE 'knowledge_content' END WHEN 'm' THEN 'short_video' WHEN 'www' THEN 'video_content' ELSE 'digital_content' END AS content_type FROM pages""")
def url_content_type(spark, sf_dir):
    as_named = F.create_map(*map(F.lit, ("blog", "zhihu", "m", "douyin", "www", "bilibili")))
    name = F.try_element_at(as_named, F.coalesce(urls.platform(F.col("url"), HOSTS), F.lit("")))
    return pages(spark, sf_dir).select("page_id", urls.content_type(F.coalesce(name, F.lit("")), F.col("url")).alias("content_type"))


@query(f"""SELECT page_id, coalesce({PLATFORM}, 'unsupported') AS platform, CASE WHEN {PLATFORM} IS NULL THEN 'error' ELSE 'success' END AS status,
CASE WHEN {PLATFORM} IS NULL THEN 'no extractor for this url' ELSE '' END AS message FROM pages""")
def url_route(spark, sf_dir):
    rows = urls.routed(pages(spark, sf_dir), F.coalesce(urls.platform(F.col("url"), HOSTS), F.lit("")), [n for n, _ in HOSTS])
    return rows.select("page_id", "platform", "status", "message")


AUTHORITY = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)"
_BARE = "regexp_replace(url, '(?s)#.*$', '')"
_PAIRS = f"list_filter(string_split(regexp_extract({_BARE}, '(?s)\\?(.*)$', 1), '&'), lambda p: regexp_matches(p, '(?s)^[^=]+=.') AND split_part(p, '=', 1) NOT IN ('ref', 'utm_source'))"
NORMAL = f"CASE WHEN contains({AUTHORITY}, 'example.com') OR contains({AUTHORITY}, 'example.net') THEN split_part({_BARE}, '?', 1) || CASE WHEN len({_PAIRS}) > 0 THEN '?' || array_to_string({_PAIRS}, '&') ELSE '' END ELSE {_BARE} END"
OPTIONS = {"hosts": ("example.com", "example.net"), "drop": ("ref", "utm_source")}


@query(f"SELECT page_id, {NORMAL} AS url FROM pages")
def url_normalize(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.normalised(F.col("url"), **OPTIONS).alias("url"))


@query(f"SELECT page_id, md5({NORMAL}) AS key, md5(url) AS id FROM pages")
def url_key(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.url_key(F.col("url"), **OPTIONS).alias("key"), F.md5(F.col("url").cast("binary")).alias("id"))


# Each link with a query that names the same things in other codes, repeats keys and leaves values out.
_CODED = "concat('HTTP://www.example.com/p/', page_id, '?b=%7e', page_id, '&utm%5Fsource=x&a+b=c%2Bd+', page_id % 7, '&e=&=n&b=~*&ref=1&z=', replace(replace(coalesce(url, ''), '#', '%23'), '&', '%26'), '#f')"
_CODED_Z = "replace(url_encode(coalesce(url, '')), '%20', '+')"


@query(f"""SELECT page_id, 'http://www.example.com/p/' || page_id || '?b=~' || page_id || '&b=~%2A&a+b=c%2Bd+' || (page_id % 7) || '&=n' || CASE WHEN coalesce(url, '') <> '' THEN '&z=' || {_CODED_Z} ELSE '' END AS url FROM pages""")
def url_query_codes(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.normalised(F.expr(_CODED), **OPTIONS).alias("url"))


@query(f"SELECT page_id, {AUTHORITY} AS authority FROM pages")
def url_authority(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.authority(F.col("url")).alias("authority"))


TITLED = f"t AS (SELECT page_id, url, html, {tag('title')} AS title FROM pages)"
_FA = rf"regexp_replace(regexp_replace(title, '[\\/*?:\"<>|]', '', 'g'), '{q.BLANK}+', '_', 'g')"
FILE_A = f"coalesce(nullif(CASE WHEN length({_FA}) > 50 THEN left({_FA}, 47) || '...' ELSE {_FA} END, ''), 'document')"


@query(f"WITH {TITLED} SELECT page_id, {FILE_A} AS name FROM t")
def filename_a(spark, sf_dir):
    return titled(spark, sf_dir).select("page_id", context.file_name(F.col("title")).alias("name"))


_FB1 = q.strip(r"""regexp_replace(title, '[<>:"/\\|?*\x00-\x1f]', '_', 'g')""")
_FB = rf"regexp_replace(regexp_replace({_FB1}, '{q.BLANK}+', '_', 'g'), '^\.+|\.+$', '', 'g')"


@query(f"WITH {TITLED} SELECT page_id, coalesce(nullif(CASE WHEN length({_FB}) > 100 THEN regexp_replace(left({_FB}, 100), '[_.]+$', '') ELSE {_FB} END, ''), 'untitled') AS name FROM t")
def filename_b(spark, sf_dir):
    return titled(spark, sf_dir).select("page_id", context.file_name_strict(F.col("title")).alias("name"))


NOISE = (r"^The[ \-–—]*", r"[ \-–—]*\.$", r"^En", r"^ *- *")
_CLEAN = q.strip("title")
for _p in NOISE:
    _CLEAN = f"regexp_replace({_CLEAN}, '(?i){_p}', '')"


@query(f"WITH {TITLED} SELECT page_id, coalesce(nullif({q.strip(_CLEAN)}, ''), {q.strip('title')}) AS title FROM t")
def title_clean(spark, sf_dir):
    return titled(spark, sf_dir).select("page_id", context.clean_title(F.col("title"), NOISE).alias("title"))


BAD, GENERIC = ("the ", "keit", "404"), ("of.", "los.")


@query(f"WITH {TITLED} SELECT page_id, NOT {q.any_in('lower(title)', BAD)} AND length({q.strip('title')}) >= 3 AND lower({q.strip('title')}) NOT IN ('of.', 'los.') AS valid FROM t")
def title_valid(spark, sf_dir):
    return titled(spark, sf_dir).select("page_id", context.valid_title(F.col("title"), BAD, GENERIC).alias("valid"))


@query(f"WITH {TITLED} SELECT page_id, {q.any_in('lower(title)', BAD)} OR {tag('h1')} = '' AS low FROM t")
def low_quality(spark, sf_dir):
    rows = titled(spark, sf_dir)
    return rows.select("page_id", context.low_quality(F.col("title"), html.tag_text(F.col("html"), "h1"), terms=BAD).alias("low"))


MARKERS = ("cookie", "sponsored", "track(3)", "subscribe")


@query(f"SELECT page_id, url FROM pages WHERE NOT {q.any_in('lower(html)', MARKERS)}")
def captcha_filter(spark, sf_dir):
    return pages(spark, sf_dir).where(~html.has_marker(F.col("html"), MARKERS)).select("page_id", "url")


@query(f"WITH {TITLED} SELECT page_id, title FROM t")
def html_title(spark, sf_dir):
    return titled(spark, sf_dir).select("page_id", "title")


@query(f"WITH {TITLED}, h AS (SELECT *, {tag('h1')} AS h1 FROM t) SELECT page_id, CASE WHEN length(h1) > 30 THEN h1 WHEN length(title) > 30 THEN title ELSE '' END AS title FROM h")
def html_cascade(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", html.title_cascade(F.col("html"), 30).alias("title"))


@query(f"""SELECT page_id, {tag('h1')} AS h1, {tag('title')} AS title, regexp_extract(html, '<nav>.*?<a href="([^"]*)"', 1) AS first_link,
CASE WHEN html LIKE '%class="ad"%' THEN {q.strip(unescape(r"""regexp_replace(regexp_extract(html, '(?is)<div class="ad">(.*?)</div>', 1), '(?s)<[^>]*>', '', 'g')"""))} END AS ad FROM pages""")
def html_elements(spark, sf_dir):
    wanted = ("article h1", "title", "nav ul li a@href", "div.ad")
    found = tree.selected(F.col("html"), wanted)
    return pages(spark, sf_dir).select("page_id", *[F.get(found, F.lit(i)).alias(n) for i, n in enumerate(("h1", "title", "first_link", "ad"))])


# Elements inside elements of their own kind, around each page's own title and text.
_NEST = """'<html><head><title> </title><meta property="og:image" content="i' || page_id || '.png"></head><body><div class="RichContent-inner"><div>in <div>deep ' || page_id || '</div></div> out</div><div class="x AuthorInfo-name"><div><i>by</i></div><span><a href="/u">' || coalesce({host}, '') || '</a></span></div>'"""


@query(f"""SELECT page_id, {q.strip(f"'in deep ' || page_id || ' out'")} AS content, {_HOST_SQL} AS author, {tag('h1')} AS title, 'i' || page_id || '.png' AS cover FROM pages""")
def html_nested(spark, sf_dir):
    rows = pages(spark, sf_dir).select("page_id", F.concat(F.expr(_NEST.replace("{host}", _HOST_SQL)), F.coalesce("html", F.lit(""))).alias("html"))
    qa, video = records.from_markup(F.col("html"), "qa"), records.from_markup(F.col("html"), "video")
    return rows.select("page_id", qa["content"].alias("content"), qa["author"].alias("author"), qa["title"].alias("title"), video["cover_url"].alias("cover"))


@query("""SELECT page_id, regexp_extract(html, '(?i)<meta[^>]*\\bcharset=["'']?([a-zA-Z0-9_-]+)', 1) AS charset FROM pages""")
def html_meta(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", html.charset(F.col("html")).alias("charset"))


#: Pages with images, descriptions and page state, for the tests; the queries read the table.
SAMPLE_PAGES = [
    (1, '<meta property="og:title" content="A fine &amp; long title"><img src="a.png"><img src="b.png"><img src="a.png"><script>window._ROUTER_DATA = {"a":{"aweme_detail":{"desc":"one } two","author":{"nickname":"n"},"statistics":{"play_count":7},"video":{"duration":61000,"cover":{"url_list":["c.jpg"]}},"create_time":5}}};</script>'),
    (2, '<meta content="described" name="description"><h1>Second title</h1><script>window.__INITIAL_STATE__ = {"note":{"noteDetailMap":{"x":{"note":{"title":"t","user":{"nickname":"u"},"imageList":[{"urlDefault":"i1"}],"tagList":[{"name":"tag"}],"interactInfo":{"likedCount":"12"}}}}}};</script>'),
    (3, "<title>Third</title><script>window._ROUTER_DATA = {broken;</script>"),
    (4, None),
]


_IMG = r"""regexp_extract_all(html, '(?is)<img[^>]*\bsrc=["'']([^"'']+)["'']', 1)"""
_META_A = r"""regexp_extract(html, '(?is)<meta[^>]*\bname=["'']description["''][^>]*\bcontent=["'']([^"'']*)["'']', 1)"""
_META_B = r"""regexp_extract(html, '(?is)<meta[^>]*\bcontent=["'']([^"'']*)["''][^>]*\bname=["'']description["'']', 1)"""
_META = f"CASE WHEN {_META_A} <> '' THEN {_META_A} WHEN {_META_B} <> '' THEN {_META_B} END"


@query(f"WITH i AS (SELECT *, {_IMG} AS found FROM pages) SELECT page_id, CASE WHEN html IS NOT NULL THEN {q.joined('list_filter(found, lambda x, i: list_position(found, x) = i)')} END AS images, {unescape(_META)} AS description FROM i")
def html_images(spark, sf_dir):
    rows = pages(spark, sf_dir)
    return rows.select("page_id", F.array_join(html.images(F.col("html")), "|").alias("images"), html.meta(F.col("html"), "description").alias("description"))


# The pages given hold no page state, so each gets one that is made of its own row; every page is read whole.
_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
_NOTE = """'{"title": "' || page_id || '", "user": {"nickname": "' || {host} || '"}, "imageList": [{"urlDefault": "i' || page_id || '"}], "interactInfo": {"likedCount": "' || page_id * 3 || '"}, "tagList": [{"name": "t1"}, {"name": "t2"}]}'"""
_VIDEO = """'{"desc": "d } ' || page_id || '", "author": {"nickname": "' || {host} || '"}, "statistics": {"play_count": ' || page_id * 1000 || ', "digg_count": 7}, "video": {"duration": ' || page_id * 500 || ', "cover": {"url_list": ["c' || page_id || '"]}}, "create_time": 5}'"""
_ANSWER = """'{"answers": {"' || page_id || '": {"question": {"title": "' || {host} || '"}, "content": "body ' || page_id || '", "voteup_count": ' || page_id * 2 || ', "author": {"name": "a' || page_id || '"}, "created_time": 9}}}'"""
_JSON = {k: v.replace("{host}", _HOST) for k, v in {"note": _NOTE, "video": _VIDEO, "answer": _ANSWER}.items()}
#: The state of a page: of every fourth the answer, a note, a video, or one that is broken.
_STATE = f"""CASE page_id % 4 WHEN 0 THEN 'window.__INITIAL_STATE__ = ' || {_JSON["answer"]} WHEN 1 THEN 'window.__INITIAL_STATE__ = ' || '{{"note": {{"noteDetailMap": {{"x": {{"note": ' || {_JSON["note"]} || '}}}}}}}}'
WHEN 2 THEN 'window._ROUTER_DATA = ' || '{{"a": [{{"aweme_detail": ' || {_JSON["video"]} || '}}]}}' ELSE 'window._ROUTER_DATA = {{broken' END"""
STATED = f"st AS (SELECT page_id, url, coalesce(html, '') || '<script>' || {_STATE} || ';</script>' AS html FROM pages)"


def stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", "url", F.concat(F.coalesce("html", F.lit("")), F.lit("<script>"), F.expr(_STATE), F.lit(";</script>")).alias("html"))


def _stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stated(spark, sf_dir).withColumn("state", records.state_of(F.col("html")))


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).withColumn("state", html.script_json(["window._ROUTER_DATA", "window.__INITIAL_STATE__"])(F.col("html")))


@query()
def html_script_json(spark, sf_dir):
    return _state(spark, sf_dir).select("page_id", "state")


@query()
def json_deep_find(spark, sf_dir):
    return _state(spark, sf_dir).select("page_id", html.deep_find(["nickname"])(F.col("state")).alias("nickname"), html.find_with(["title", "user"], ["noteDetailMap"])(F.col("state")).alias("note"))


def _videos(rows: DataFrame) -> DataFrame:
    """Fields of the engine's record of the video in a page's state, its duration in seconds; null where there is none."""
    rows = rows.withColumn("entry", records.video_entry(F.col("state")))
    rows = rows.select("page_id", F.col("entry").isNotNull().alias("there"), records.video_record(F.lit(""), F.col("entry"), F.lit("")).alias("v"))
    field = lambda c: F.when(F.col("there"), F.nullif(F.col(f"v.{c}"), F.lit("")))
    return rows.select(
        "page_id", field("title").alias("title"), field("author").alias("author"), "v.view_count", "v.like_count", F.floor(F.col("v.duration") / 1000).alias("duration"),
        field("cover_url").alias("cover_url"), field("publish_time").cast("bigint").alias("create_time"),
    )


@query()
def json_field_map(spark, sf_dir):
    return _videos(_state(spark, sf_dir))


@query(f"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN {_JSON["answer"]} WHEN 1 THEN '{{"note": {{"noteDetailMap": {{"x": {{"note": ' || {_JSON["note"]} || '}}}}}}}}' WHEN 2 THEN '{{"a": [{{"aweme_detail": ' || {_JSON["video"]} || '}}]}}' END AS state FROM pages""")
def page_state_json(spark, sf_dir):
    return _stated(spark, sf_dir).select("page_id", "state")


@query(f"""SELECT page_id, CASE WHEN page_id % 4 IN (1, 2) THEN '"' || {_HOST} || '"' END AS nickname, CASE WHEN page_id % 4 = 1 THEN '{{"note": ' || {_JSON["note"]} || '}}' END AS note FROM pages""")
def page_state_find(spark, sf_dir):
    return _stated(spark, sf_dir).select("page_id", html.deep_find(["nickname"])(F.col("state")).alias("nickname"), html.find_with(["title", "user"], ["noteDetailMap"])(F.col("state")).alias("note"))


@query(f"""SELECT page_id, CASE WHEN v THEN 'd }} ' || page_id END AS title, CASE WHEN v THEN {_HOST} END AS author, CASE WHEN v THEN page_id * 1000 ELSE 0 END AS view_count, CASE WHEN v THEN 7 ELSE 0 END AS like_count,
CASE WHEN v THEN page_id * 500 // 1000 ELSE 0 END AS duration, CASE WHEN v THEN 'c' || page_id END AS cover_url, CASE WHEN v THEN 5 END AS create_time FROM (SELECT *, page_id % 4 = 2 AS v FROM pages)""")
def page_state_video(spark, sf_dir):
    return _videos(_stated(spark, sf_dir))


_KIND = "CASE page_id % 4 WHEN 0 THEN 'answer' ELSE 'article' END"
_QM_CONTENT = f"coalesce(nullif({unescape(_META)}, ''), '')"
_QM_TITLE = f"coalesce(nullif({tag('h1')}, ''), nullif({tag('title')}, ''), {q.text(records.DEFAULT_TITLES['qa'])})"


@query(f"""SELECT page_id, CASE WHEN v THEN {_HOST} ELSE {_QM_TITLE} END AS title, CASE WHEN v THEN 'a' || page_id ELSE {q.text(records.UNKNOWN_AUTHOR)} END AS author,
CASE WHEN v THEN 'body ' || page_id ELSE {_QM_CONTENT} END AS content, CASE WHEN v THEN page_id * 2 ELSE 0 END AS votes, CASE WHEN v THEN '9' ELSE '' END AS created FROM (SELECT *, page_id % 4 = 0 AS v FROM pages)""")
def qa_records(spark, sf_dir):
    rows = _stated(spark, sf_dir).withColumn("kind", F.expr(_KIND)).withColumn("entry", records.qa_entry(F.col("state"), F.col("kind")))
    rows = rows.withColumn("r", records.qa_record(F.col("html"), F.col("entry"), F.col("kind")))
    return rows.select("page_id", "r.title", "r.author", "r.content", F.col("r.voteup_count").alias("votes"), F.col("r.created_time").alias("created"))


@query(f"""SELECT page_id, CASE WHEN v THEN page_id::VARCHAR ELSE coalesce(nullif({tag('h1')}, ''), nullif({tag('title')}, '')) END AS title, CASE WHEN v THEN {_HOST} ELSE {q.text(records.UNKNOWN_AUTHOR)} END AS author,
CASE WHEN v THEN page_id * 3 ELSE 0 END AS likes, CASE WHEN v THEN 'i' || page_id ELSE '' END AS images, CASE WHEN v THEN 't1|t2' ELSE '' END AS tags, 'note' AS kind FROM (SELECT *, page_id % 4 = 1 AS v FROM pages)""")
def note_records(spark, sf_dir):
    rows = _stated(spark, sf_dir).withColumn("entry", records.note_entry(F.col("state")))
    rows = rows.withColumn("r", records.note_record(F.col("html"), F.col("entry")))
    return rows.select("page_id", "r.title", "r.author", F.col("r.like_count").alias("likes"), F.array_join("r.images", "|").alias("images"), F.array_join("r.tags", "|").alias("tags"), records.note_type(F.col("r.video_url")).alias("kind"))


_IDS = "CASE page_id % 4 WHEN 0 THEN 'x' || html WHEN 1 THEN html || '\"item_id\":\"' || page_id || '\"' WHEN 2 THEN 'aweme_id=' || page_id || html ELSE html || ' /video/' || page_id END"


@query("SELECT page_id, CASE WHEN html IS NULL OR page_id % 4 = 0 THEN NULL ELSE page_id::VARCHAR END AS id FROM pages")
def page_text_ids(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", records.page_identifier(F.expr(_IDS)).alias("id"))


_N = "page_id * 1000"


@query(f"""SELECT page_id, '标题: ' || url || chr(10) || '作者: ' || {_HOST} || chr(10) || chr(10) || CASE WHEN page_id % 2 = 0 THEN '视频描述:' || chr(10) || 'd' || page_id || chr(10) || chr(10) ELSE '' END
|| CASE WHEN page_id > 0 THEN '播放量: ' || format('{{:,}}', {_N}) || chr(10) ELSE '' END AS video,
'标题: ' || url || chr(10) || '作者: ' || {_HOST} || chr(10) || '类型: article' || chr(10) || chr(10) || CASE WHEN page_id % 2 = 0 THEN '内容:' || chr(10) || 'd' || page_id || chr(10) || chr(10) ELSE '' END
|| '相关话题: a, b' || chr(10) || CASE WHEN page_id > 0 THEN '赞同数: ' || format('{{:,}}', {_N}) || chr(10) ELSE '' END AS qa,
'标题: ' || url || chr(10) || '作者: ' || {_HOST} || chr(10) || chr(10) || '简介:' || chr(10) || 'd' || page_id || chr(10) || chr(10) || '标签: x, y' || chr(10) || chr(10) || '分P信息:' || chr(10) || 'P1: p' || page_id || ' (' || page_id || '秒)' || chr(10) || 'P2:  (0秒)' || chr(10) AS api
FROM pages""")
def content_shapes(spark, sf_dir):
    described = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("d"), F.col("page_id").cast("string"))).otherwise("")
    head = [F.col("url").alias("title"), F.expr(_HOST).alias("author")]
    none, views = F.lit(0), F.expr(_N)
    video = F.struct(*head, described.alias("description"), views.alias("view_count"), none.alias("like_count"), none.alias("comment_count"))
    qa = F.struct(*head, F.lit("").alias("excerpt"), described.alias("content"), F.array(F.lit("a"), F.lit("b")).alias("topics"), views.alias("voteup_count"), none.alias("comment_count"), none.alias("view_count"))
    info = F.expr("""'{"title": "' || url || '", "owner": {"name": "' || """ + _HOST + """ || '"}, "desc": "d' || page_id || '"}'""")
    parts = F.expr("""'[{"page": 1, "part": "p' || page_id || '", "duration": ' || page_id || '}, {"page": 2}]'""")
    api = records.api_record(info, F.lit('[{"tag_name": "x"}, {"tag_name": "y"}]'), parts)
    rows = pages(spark, sf_dir).select("page_id", video.alias("v"), qa.alias("q"), api.alias("a"))
    return rows.select("page_id", records.video_text(F.col("v")).alias("video"), records.qa_text(F.col("q"), F.lit("article")).alias("qa"), records.api_text(F.col("a")).alias("api"))


_WRAP = "CASE event_type WHEN 'click' THEN 'Here: ' || props || ' (end)' WHEN 'view' THEN 'no answer' ELSE '  ' || props || chr(10) END"
_WHOLE = f"trim({_WRAP}, ' ' || chr(10))"


@query(f"""WITH w AS (SELECT event_id, {_WRAP} AS a, {_WHOLE} AS s FROM events), p AS (SELECT event_id, CASE WHEN json_valid(s) THEN s WHEN json_valid(regexp_extract(a, '(?s)\\{{.*\\}}', 0)) THEN regexp_extract(a, '(?s)\\{{.*\\}}', 0) END AS parsed FROM w)
SELECT event_id, parsed, CASE WHEN parsed IS NULL THEN 'k|title' ELSE 'title' END AS missing FROM p""")
def json_lenient_parse(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    answer = F.when(F.col("event_type") == "click", F.concat(F.lit("Here: "), F.col("props"), F.lit(" (end)"))).when(F.col("event_type") == "view", "no answer").otherwise(F.concat(F.lit("  "), F.col("props"), F.lit("\n")))
    parsed = rows.select("event_id", html.lenient_json(answer).alias("parsed"))
    return parsed.select("event_id", "parsed", F.array_join(html.missing_fields(F.col("parsed"), ["k", "title"]), "|").alias("missing"))


@query(f"""WITH {TITLED} SELECT page_id, 'Title: ' || title || chr(10) || 'Author: ' || {AUTHORITY} || CASE WHEN {tag('h1')} <> '' THEN chr(10) || chr(10) || 'Description:' || chr(10) || {tag('h1')} ELSE '' END
|| chr(10) || 'Views: ' || format('{{:,}}', length(html)) AS content FROM t""")
def content_text(spark, sf_dir):
    rows = titled(spark, sf_dir)
    return rows.select("page_id", render.content_text(F.col("title"), urls.authority(F.col("url")), html.tag_text(F.col("html"), "h1"), F.length("html")).alias("content"))


@query(rf"""WITH {TITLED}, n AS (SELECT page_id, {FILE_A} AS base FROM t),
k AS (SELECT page_id, base, row_number() OVER (PARTITION BY base ORDER BY page_id) - 1 AS k FROM n),
u AS (SELECT regexp_extract(base, '^(.*)_([1-9]\d{{0,8}})$', 1) AS base, TRY_CAST(regexp_extract(base, '^(.*)_([1-9]\d{{0,8}})$', 2) AS INTEGER) AS number FROM (SELECT DISTINCT base FROM n)),
t2 AS (SELECT base, list_sort(list(DISTINCT number)) AS taken FROM u WHERE number IS NOT NULL GROUP BY base),
f AS (SELECT page_id, k.base, CASE WHEN k = 0 THEN 0 ELSE list_reduce(list_prepend(k, coalesce(taken, []::BIGINT[])), lambda a, b: CASE WHEN b <= a THEN a + 1 ELSE a END) END AS k FROM k LEFT JOIN t2 ON k.base = t2.base)
SELECT page_id, base || CASE WHEN k = 0 THEN '' ELSE '_' || k::VARCHAR END || '.md' AS file_name FROM f""")
def sink_names(spark, sf_dir):
    return sinks.named(titled(spark, sf_dir), order="page_id").select("page_id", "file_name")


_CT = "CASE WHEN contains(url, '.html') THEN 'article' ELSE 'short_video' END"


def _typed(spark, sf_dir):
    rows = titled(spark, sf_dir).withColumn("platform", F.coalesce(urls.platform(F.col("url"), HOSTS), F.lit("other")))
    return rows.withColumn("content_type", F.when(F.contains("url", F.lit(".html")), "article").otherwise("short_video"))


_TAGS = (
    f"list_slice(list_concat(list_concat({q.array(render.TAGS)}, CASE coalesce({PLATFORM}, 'other') " + " ".join(f"WHEN {q.text(k)} THEN {q.array(v)}" for k, v in render.PLATFORM_TAGS.items()) + " ELSE []::VARCHAR[] END), "
    + f"list_concat(CASE {_CT} " + " ".join(f"WHEN {q.text(k)} THEN {q.array(v)}" for k, v in render.TYPE_TAGS.items()) + " ELSE []::VARCHAR[] END, CASE WHEN title <> '' THEN [title] ELSE []::VARCHAR[] END)), 1, 8)"
)


@query(f"WITH {TITLED} SELECT page_id, {q.joined(_TAGS)} AS tags FROM t")
def unified_tags(spark, sf_dir):
    rows = _typed(spark, sf_dir)
    return rows.select("page_id", F.array_join(render.tags(F.col("platform"), F.col("content_type"), F.col("title")), "|").alias("tags"))


#: Texts for the template document's parts, by what each part of it is looked up by.
TEMPLATES = [
    ("structure", "type", "article", "Opening, argument, close."), ("structure", "type", "short_video", "Hook, core, call."), ("structure", "type", "", "Parts in order."),
    ("audience", "pair", "www/article", "Readers at a desk."), ("audience", "pair", "m/short_video", "Viewers on the way."), ("audience", "pair", "", "Anyone."),
    ("platform", "platform", "blog", "Posts by date."), ("platform", "platform", "www", "Pages by place."), ("platform", "platform", "", "Pages."),
]


def _template_sql(part: str) -> str:
    by = {"type": _CT, "platform": f"coalesce({PLATFORM}, 'other')", "pair": f"coalesce({PLATFORM}, 'other') || '/' || {_CT}"}
    own = [(kind, value, text) for p, kind, value, text in TEMPLATES if p == part]
    return "CASE " + " ".join(f"WHEN {by[k]} = {q.text(v)} THEN {q.text(t)}" for k, v, t in own if v) + f" ELSE {q.text(next(t for _, v, t in own if not v))} END"


@query(f"""WITH {TITLED} SELECT page_id, '---' || chr(10) || 'title: ' || title || chr(10) || '---' || """ + " || ".join(f"chr(10) || chr(10) || '## {p.capitalize()}' || chr(10) || chr(10) || {_template_sql(p)}" for p in ("structure", "audience", "platform"))
       + f""" || chr(10) || chr(10) || '> ' || {_CT} || ' on ' || coalesce({PLATFORM}, 'other') || ': ' || title AS document FROM t""")
def template_document(spark, sf_dir):
    return render.template_document(_typed(spark, sf_dir), TEMPLATES).select("page_id", "document")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE '图片1: ' || url || ' end' || chr(10) END || '图片3: ' || page_id AS text FROM pages")
def ocr_lines(spark, sf_dir):
    line = lambda text, conf: F.struct(text.cast("string").alias("text"), (F.lit(conf) if isinstance(conf, float) else conf).alias("conf"))
    sure = F.when(F.col("page_id") % 3 == 0, 0.6).otherwise(0.9)
    images = F.array(F.array(line(F.col("url"), sure), line(F.lit("low"), 0.5), line(F.lit("end"), sure)), F.array(line(F.lit(" "), 0.9)), F.array(line(F.col("page_id"), 0.7)))
    return pages(spark, sf_dir).select("page_id", render.ocr_text(images).alias("text"))


# Cache, batches, spacing and settings over events: the user is the key, ts the time of writing.
NOW, TTL = "2024-01-25 00:00:00", "240 hours"
ENTRIES = "e AS (SELECT event_id, md5(user_id::VARCHAR) AS url_hash, user_id, ts AS cached_at, floor(value)::BIGINT AS file_size FROM events)"
LAST = "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url_hash ORDER BY cached_at DESC, event_id DESC) AS rn FROM e) WHERE rn = 1)"
_FRESH = f"cached_at >= TIMESTAMP '{NOW}' - INTERVAL {TTL}"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_id", F.md5(F.col("user_id").cast("string").cast("binary")).alias("url_hash"), "user_id", F.col("ts").alias("cached_at"), F.floor("value").alias("file_size"))


def now():
    return F.expr(f"timestamp_ntz'{NOW}'")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return rows.select("c_custkey", F.md5(F.col("c_custkey").cast("string").cast("binary")).alias("url_hash"))


@query(f"WITH {ENTRIES}, {LAST} SELECT c_custkey, md5(c_custkey::VARCHAR) AS url_hash FROM customer WHERE md5(c_custkey::VARCHAR) IN (SELECT url_hash FROM l WHERE {_FRESH})")
def cache_hits(spark, sf_dir):
    return store.hits(requests(spark, sf_dir), store.valid(store.upserted(entries(spark, sf_dir)), now(), TTL)).select("c_custkey", "url_hash")


@query(f"WITH {ENTRIES}, {LAST} SELECT c_custkey, md5(c_custkey::VARCHAR) AS url_hash FROM customer WHERE md5(c_custkey::VARCHAR) NOT IN (SELECT url_hash FROM l WHERE {_FRESH})")
def cache_misses(spark, sf_dir):
    return store.misses(requests(spark, sf_dir), store.valid(store.upserted(entries(spark, sf_dir)), now(), TTL)).select("c_custkey", "url_hash")


@query(f"WITH {ENTRIES}, {LAST}, p AS (SELECT DISTINCT md5(user_id::VARCHAR) AS url_hash FROM events WHERE event_type = 'click') SELECT event_id, url_hash FROM l WHERE {_FRESH} AND url_hash IN (SELECT url_hash FROM p)")
def cache_payloads(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'click'").select(F.md5(F.col("user_id").cast("string").cast("binary")).alias("url_hash"))
    return store.with_payload(store.valid(store.upserted(entries(spark, sf_dir)), now(), TTL), rows).select("event_id", "url_hash")


@query(f"WITH {ENTRIES} SELECT event_id, url_hash FROM e WHERE url_hash NOT IN (SELECT md5(c_custkey::VARCHAR) FROM customer)")
def cache_remove(spark, sf_dir):
    return store.removed(entries(spark, sf_dir), requests(spark, sf_dir)).select("event_id", "url_hash")


@query(f"WITH {ENTRIES}, {LAST} SELECT event_id, url_hash, user_id, cached_at, file_size FROM l")
def cache_upsert(spark, sf_dir):
    return store.upserted(entries(spark, sf_dir))


@query(f"WITH {ENTRIES} SELECT event_id, url_hash, cached_at FROM e WHERE NOT ({_FRESH})")
def cache_expire(spark, sf_dir):
    return store.expired(entries(spark, sf_dir), now(), TTL).select("event_id", "url_hash", "cached_at")


@query(f"""WITH {ENTRIES}, r AS (SELECT *, row_number() OVER (ORDER BY cached_at, event_id) AS rn, sum(file_size) OVER () AS s, count(*) OVER () AS n FROM e)
SELECT event_id, url_hash, cached_at, file_size FROM r WHERE s <= 1000 OR rn > greatest(1, n // 4)""")
def cache_evict(spark, sf_dir):
    return store.evicted(entries(spark, sf_dir), 1000).select("event_id", "url_hash", "cached_at", "file_size")


@query(f"WITH {ENTRIES} SELECT count(*) AS total, count(*) FILTER ({_FRESH}) AS valid, count(*) FILTER (NOT ({_FRESH})) AS expired, sum(file_size)::BIGINT AS size FROM e")
def cache_stats(spark, sf_dir):
    return store.stats(entries(spark, sf_dir), now(), TTL)


@query("SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 5 + 1 AS batch FROM events")
def batch_chunks(spark, sf_dir):
    return store.chunked(spark.read.parquet(f"{sf_dir}/events.parquet")).select("event_id", "user_id", "batch")


@query("SELECT count(*) AS total, count(*) FILTER (event_type <> 'view') AS succeeded, printf('%.1f%%', count(*) FILTER (event_type <> 'view') * 100 / count(*)::DOUBLE) AS rate FROM events")
def batch_stats(spark, sf_dir):
    return store.batch_stats(spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_type") != "view")


@query("""SELECT * FROM (SELECT event_id, user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6::DOUBLE AS gap FROM events) WHERE gap < 3600""")
def rate_violations(spark, sf_dir):
    return store.rate_violations(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "ts", 3600).select("event_id", "user_id", "gap")


@query(r"""WITH v AS (SELECT event_id, unnest([0, 1, 2]) AS k, unnest([json_extract_string(props, '$.k'), event_type, props]) AS v FROM events)
SELECT event_id, k, CASE WHEN lower(v) IN ('true', 'yes', 'on', '1', 'false', 'no', 'off', '0') THEN 'bool' WHEN regexp_matches(v, '^[+-]?\d+$') THEN 'int' WHEN json_valid(v) THEN 'json' ELSE 'string' END AS kind,
CASE WHEN lower(v) IN ('true', 'yes', 'on', '1') THEN 'true' WHEN lower(v) IN ('false', 'no', 'off', '0') THEN 'false' ELSE v END AS text FROM v""")
def env_coerce(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    values = rows.select("event_id", F.posexplode(F.array(F.get_json_object("props", "$.k"), "event_type", "props")).alias("k", "v"))
    return values.select("event_id", "k", store.coerced(F.col("v")).alias("c")).select("event_id", "k", "c.*")
