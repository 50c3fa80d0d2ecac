"""Records of captured pages: fields of embedded page state, of markup and of captured interface answers, and their texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import context, html, tree
from textloom.functions.text import filled, first_filled, first_match, strip

# Names that the pages of the platforms use, and texts of records without values.
STATE_VARIABLES = (
    "window._ROUTER_DATA", "window.__INITIAL_STATE__", "window.INITIAL_STATE", "window._SSR_HYDRATED_DATA", "window.__INITIAL_SSR_STATE__", "window.RENDER_DATA", "self.__pace_data",
)
PAGE_ID_PATTERNS = (
    r'"aweme_id":"(\d+)"', r'"video_id":"(\d+)"', r'"item_id":"(\d+)"', r'"itemId":"(\d+)"', r'"awemeId":"(\d+)"',
    r'(?s)window\.__INITIAL_STATE__.*?"aweme_id":"(\d+)"', r'(?s)window\.__INITIAL_STATE__.*?"itemId":"(\d+)"', r'"aweme":\{"aweme_id":"(\d+)"',
    r"aweme_id=(\d+)", r"item_id=(\d+)", r"/video/(\d+)",
)
QA_KEYS = {"answer": "answers", "question": "questions", "article": "articles", "pin": "pins"}
#: For each field of a Q&A record, where the four kinds hold it.
QA_PATHS = {
    "title": {"answer": "question.title", "question": "title", "article": "title"},
    "author": dict.fromkeys(QA_KEYS, "author.name"),
    "content": {"answer": "content", "question": "detail", "article": "content", "pin": "content"},
    "excerpt": {"answer": "excerpt", "question": "excerpt", "article": "excerpt", "pin": "excerpt_new"},
    "voteup_count": {"answer": "voteup_count", "article": "voteup_count", "pin": "like_count"},
    "comment_count": dict.fromkeys(QA_KEYS, "comment_count"),
    "view_count": {"question": "visit_count"},
    "created_time": {"answer": "created_time", "question": "created", "article": "created", "pin": "created"},
    "updated_time": {"answer": "updated_time", "question": "updated_time", "article": "updated", "pin": "updated"},
}
QA_TITLES = {"answer": "知乎回答", "question": "知乎问题", "article": "知乎专栏", "pin": "知乎想法"}
QA_SITE = "知乎"
UNKNOWN_AUTHOR = "未知作者"
DEFAULT_TITLES = {"video": "抖音视频", "note": "小红书笔记", "qa": "知乎内容", "api": "未知标题"}
LABELS = {
    "title": "标题", "author": "作者", "kind": "类型", "video": "视频描述", "note": "笔记描述", "api": "简介", "tags": "标签", "images": "图片文字内容", "excerpt": "摘要", "content": "内容", "topics": "相关话题",
    "views": "播放量", "likes": "点赞数", "comments": "评论数", "collects": "收藏数", "votes": "赞同数", "visits": "浏览量", "parts": "分P信息",
}
#: For each kind of page the selectors of a field, best first.
CASCADES = {
    "video": {
        "title": ('meta[property="og:title"]', 'meta[name="twitter:title"]', 'meta[property="twitter:title"]', "title"),
        "description": ('meta[property="og:description"]', 'meta[name="description"]', 'meta[name="twitter:description"]'),
        "author": ('meta[name="author"]', 'meta[property="og:site_name"]', ".author-name", ".user-name"),
        "cover_url": ('meta[property="og:image"]', 'meta[name="twitter:image"]'),
    },
    "qa": {
        "title": ('meta[property="og:title"]', 'meta[name="twitter:title"]', "h1.QuestionHeader-title", "h1", "title"),
        "content": ('meta[property="og:description"]', 'meta[name="description"]', ".RichContent-inner", ".QuestionRichText", ".Post-RichText"),
        "author": (".AuthorInfo-name a", ".UserLink-link", ".author-link-line a"),
    },
}
SELECTORS = tuple(dict.fromkeys(s for fields in CASCADES.values() for order in fields.values() for s in order))

_NO_WORDS = "array<string>"


def page_identifier(page: Column, patterns: Sequence[str] = PAGE_ID_PATTERNS) -> Column:
    """The id in the text of a page: of the first pattern that finds one, else null."""
    return first_match(page, patterns)


def note_type(video_url: Column) -> Column:
    return F.when(F.coalesce(video_url, F.lit("")) != "", "video").otherwise("note")


def state_of(page: Column, names: Sequence[str] = STATE_VARIABLES) -> Column:
    """The page state as JSON text: of the first variable that holds any."""
    return html.script_json(names)(page)


def _number(c: Column) -> Column:
    return F.coalesce(c.try_cast("bigint"), F.lit(0))


def qa_entry(state: Column, kind: Column) -> Column:
    """As JSON, the first object under the key of the kind in a page state; null if there is none."""
    return html.first_entry()(state, F.coalesce(*[F.when(kind == k, key) for k, key in QA_KEYS.items()]))


def qa_from_entry(entry: Column, kind: Column) -> Column:
    """struct of the fields in QA_PATHS and topics, of the object that qa_entry() found; null fields where there is none."""
    at = lambda paths: F.call_function("get_json_object", entry, F.coalesce(*[F.when(kind == k, f"$.{p}") for k, p in paths.items()]))
    fields = {name: _number(at(paths)) if name.endswith("_count") else at(paths) for name, paths in QA_PATHS.items()}
    fields["title"] = F.when(entry.isNotNull() & (kind == "pin"), QA_TITLES["pin"]).otherwise(fields["title"])
    topics = F.transform(F.from_json(F.call_function("get_json_object", entry, F.when(kind == "question", "$.topics")), "array<struct<name: string>>"), lambda t: t["name"])
    return F.struct(*[c.alias(n) for n, c in fields.items()], topics.alias("topics"), entry.isNotNull().alias("found"))


def markup(page: Column) -> Column:
    """What a page's elements hold, for every selector of the cascades; one pass a page serves all of them."""
    return tree.selected(page, SELECTORS)


def from_markup(page: Column, kind: str) -> Column:
    """struct of the fields of CASCADES for this kind of page; a field that no element gives is null."""
    found = markup(page)
    rules = CASCADES[kind]
    title = {"longer_than": 5} if kind == "video" else {"without": QA_SITE}
    return F.struct(*[tree.first_good(found, SELECTORS, order, **(title if name == "title" else {})).alias(name) for name, order in rules.items()])


def qa_from_markup(page: Column) -> Column:
    """struct(title, content, author) by the cascades of Q&A pages; titles with the site's name are passed over."""
    return from_markup(page, "qa")


def qa_record(page: Column, entry: Column, kind: Column) -> Column:
    """The Q&A record of a page: qa_entry() of its state first, then markup, then the defaults."""
    s, m = qa_from_entry(entry, kind), qa_from_markup(page)
    pick = lambda name: F.when(s["found"], s[name]).otherwise(m[name])
    no_words = F.array().cast(_NO_WORDS)
    return F.struct(
        first_filled(pick("title"), html.tag_text(page, "title"), F.lit(DEFAULT_TITLES["qa"])).alias("title"), filled(pick("author"), UNKNOWN_AUTHOR).alias("author"),
        filled(first_filled(pick("content"), html.meta(page, "description")), "").alias("content"), filled(s["excerpt"], "").alias("excerpt"),
        *[F.coalesce(s[n], F.lit(0)).alias(n) for n in ("voteup_count", "comment_count", "view_count")],
        *[filled(s[n], "").alias(n) for n in ("created_time", "updated_time")], F.coalesce(s["topics"], no_words).alias("topics"),
    )


VIDEO_STATE = (
    "`desc` string, author struct<nickname: string, unique_id: string>, statistics struct<play_count: bigint, digg_count: bigint, comment_count: bigint, share_count: bigint>, "
    "video struct<duration: bigint, cover: struct<url_list: array<string>>>, create_time string"
)
NOTE_STATE = (
    "title string, `desc` string, user struct<nickname: string, id: string>, imageList array<struct<urlDefault: string>>, video struct<consumer: struct<originVideoKey: string>>, "
    "interactInfo struct<likedCount: string, commentCount: string, shareCount: string, collectedCount: string>, tagList array<struct<name: string>>, time string"
)


def video_entry(state: Column) -> Column:
    """As JSON, the object of a video in a page state."""
    return html.find_with(["desc", "author"], ["aweme_detail", "aweme_list"])(state)


def note_entry(state: Column) -> Column:
    """As JSON, the object of a note in a page state; a map of notes holds them in wrappers."""
    found = html.find_with(["title", "user"], ["noteDetailMap"])(state)
    return F.coalesce(F.get_json_object(found, "$.note"), found)


def video_record(page: Column, entry: Column, shared: Column) -> Column:
    """The record of a short video: its object, then markup, then the text it was shared with, then the defaults."""
    v, m = F.from_json(entry, VIDEO_STATE), from_markup(page, "video")
    n = lambda c: F.coalesce(c, F.lit(0))
    return F.struct(
        filled(first_filled(v["desc"], m["title"], html.tag_text(page, "title"), context.context_title(shared)), DEFAULT_TITLES["video"]).alias("title"),
        filled(first_filled(v["author"]["nickname"], v["author"]["unique_id"], m["author"], context.context_author(shared)), UNKNOWN_AUTHOR).alias("author"),
        filled(m["description"], "").alias("description"), n(v["statistics"]["play_count"]).alias("view_count"), n(v["statistics"]["digg_count"]).alias("like_count"),
        n(v["statistics"]["comment_count"]).alias("comment_count"), n(v["statistics"]["share_count"]).alias("share_count"), filled(v["create_time"], "").alias("publish_time"),
        filled(first_filled(F.get(v["video"]["cover"]["url_list"], F.lit(0)), m["cover_url"]), "").alias("cover_url"), n(v["video"]["duration"]).alias("duration"),
    )


def note_record(page: Column, entry: Column) -> Column:
    """The record of a picture note: its object, then markup, then the defaults."""
    n = F.from_json(entry, NOTE_STATE)
    listed = lambda c: F.filter(F.coalesce(c, F.array().cast(_NO_WORDS)), lambda x: x.isNotNull())
    counts = {"like_count": "likedCount", "comment_count": "commentCount", "share_count": "shareCount", "collect_count": "collectedCount"}
    return F.struct(
        filled(first_filled(n["title"], html.title_cascade(page), html.tag_text(page, "title")), DEFAULT_TITLES["note"]).alias("title"),
        filled(first_filled(n["user"]["nickname"], n["user"]["id"], html.meta(page, "author")), UNKNOWN_AUTHOR).alias("author"), filled(first_filled(n["desc"], html.meta(page, "description")), "").alias("description"),
        listed(F.transform(n["imageList"], lambda i: i["urlDefault"])).alias("images"), filled(n["video"]["consumer"]["originVideoKey"], "").alias("video_url"),
        *[_number(n["interactInfo"][k]).alias(name) for name, k in counts.items()], listed(F.transform(n["tagList"], lambda t: t["name"])).alias("tags"), filled(n["time"], "").alias("publish_time"),
    )


def api_record(info: Column, tags: Column, parts: Column) -> Column:
    """The record of a video from the captured answers of its site's interface, JSON texts of info, tags and parts."""
    j = lambda path: F.get_json_object(info, f"$.{path}")
    return F.struct(
        filled(j("title"), DEFAULT_TITLES["api"]).alias("title"), filled(j("owner.name"), UNKNOWN_AUTHOR).alias("author"), filled(j("desc"), "").alias("description"), _number(j("duration")).alias("duration"),
        filled(j("bvid"), "").alias("bvid"), _number(j("pubdate")).alias("pubdate"), _number(j("stat.view")).alias("view_count"), filled(j("pic"), "").alias("cover_url"),
        F.coalesce(F.transform(F.from_json(tags, "array<struct<tag_name: string>>"), lambda t: F.coalesce(t["tag_name"], F.lit(""))), F.array().cast(_NO_WORDS)).alias("tags"),
        F.coalesce(F.from_json(parts, "array<struct<page: bigint, part: string, duration: bigint>>"), F.array().cast("array<struct<page: bigint, part: string, duration: bigint>>")).alias("parts"),
    )


def _label(name: str, value: Column, end: str = "\n") -> Column:
    return F.concat(F.lit(f"{LABELS[name]}: "), value, F.lit(end))


def _block(name: str, text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(f"{LABELS[name]}:\n"), text, F.lit("\n\n"))).otherwise("")


def _words(name: str, words: Column, end: str) -> Column:
    return F.when(F.size(words) > 0, _label(name, F.array_join(words, ", "), end)).otherwise("")


def _count(name: str, n: Column) -> Column:
    return F.when(n > 0, _label(name, F.format_number(n, 0))).otherwise("")


def _head(r: Column) -> Column:
    return F.concat(_label("title", r["title"]), _label("author", r["author"], "\n\n"))


def video_text(r: Column) -> Column:
    return F.concat(_head(r), _block("video", r["description"]), _count("views", r["view_count"]), _count("likes", r["like_count"]), _count("comments", r["comment_count"]))


def note_text(r: Column, image_text: Column) -> Column:
    return F.concat(_head(r), _block("note", r["description"]), _words("tags", r["tags"], "\n\n"), _block("images", image_text), _count("likes", r["like_count"]), _count("collects", r["collect_count"]), _count("comments", r["comment_count"]))


def qa_text(r: Column, kind: Column) -> Column:
    head = F.concat(_label("title", r["title"]), _label("author", r["author"]), _label("kind", kind, "\n\n"))
    return F.concat(head, _block("excerpt", r["excerpt"]), _block("content", r["content"]), _words("topics", r["topics"], "\n"), _count("votes", r["voteup_count"]), _count("comments", r["comment_count"]), _count("visits", r["view_count"]))


def api_text(r: Column) -> Column:
    lines = F.transform(r["parts"], lambda p: F.concat(F.lit("P"), F.coalesce(p["page"], F.lit(0)).cast("string"), F.lit(": "), filled(p["part"], ""), F.lit(" ("), F.coalesce(p["duration"], F.lit(0)).cast("string"), F.lit("秒)\n")))
    parts = F.when(F.size(r["parts"]) > 1, F.concat(F.lit(f"\n{LABELS['parts']}:\n"), F.array_join(lines, ""))).otherwise("")
    return F.concat(_head(r), F.lit(f"{LABELS['api']}:\n"), r["description"], F.lit("\n\n"), _words("tags", r["tags"], "\n"), parts)


def default_video() -> Column:
    """The record of a video of which nothing could be read."""
    return video_record(F.lit(""), F.lit(None).cast("string"), F.lit(""))


def default_note() -> Column:
    return note_record(F.lit(""), F.lit(None).cast("string"))


def default_qa(kind: Column) -> Column:
    """A Q&A record without values; its title names the kind."""
    title = F.coalesce(*[F.when(kind == k, t) for k, t in QA_TITLES.items()], F.lit(DEFAULT_TITLES["qa"]))
    return qa_record(F.lit(""), F.lit(None).cast("string"), kind).withField("title", title)
