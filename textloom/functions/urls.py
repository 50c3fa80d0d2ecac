"""URL predicates, identifiers and normalisation as column expressions; patterns and host rules are parameters."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import first_match, literals

# What decides the platform and the identifiers of a link.
PLATFORM_PATTERNS = (
    ("douyin", (r"^https?://(?:www\.)?douyin\.com/video/(\d+)", r"^https?://v\.douyin\.com/([a-zA-Z0-9]+)/?", r"^https?://(?:www\.)?iesdouyin\.com/share/video/(\d+)", r"^https?://(?:www\.)?douyin\.com/user/.*modal_id=(\d+)")),
    ("bilibili", (r"^https?://(?:www\.)?bilibili\.com/video/([a-zA-Z0-9]+)", r"^https?://b23\.tv/([a-zA-Z0-9]+)")),
    ("xiaohongshu", (r"^https?://(?:www\.)?xiaohongshu\.com/explore/([a-f0-9]+)", r"^https?://(?:www\.)?xiaohongshu\.com/discovery/item/([a-f0-9]+)", r"^https?://xhslink\.com/([a-zA-Z0-9]+)")),
    ("zhihu", (r"^https?://(?:www\.)?zhihu\.com/question/(\d+)/answer/(\d+)", r"^https?://(?:www\.)?zhihu\.com/question/(\d+)", r"^https?://zhuanlan\.zhihu\.com/p/(\d+)", r"^https?://(?:www\.)?zhihu\.com/pin/(\d+)")),
)
VIDEO_ID = (r"/video/(\d+)", r"video/(\d+)", r"aweme/v1/aweme/detail.*?aweme_id=(\d+)", r"aweme_id=(\d+)", r"item_id=(\d+)", r"itemId=(\d+)", r"modal_id=(\d+)")
NOTE_ID = (r"/explore/([a-f0-9]+)", r"/item/([a-f0-9]+)", r"xhslink\.com/([a-zA-Z0-9]+)")
BV_ID = (r"(BV[a-zA-Z0-9]+)",)
QA_TYPES = (("answer", r"/question/(\d+)/answer/(\d+)"), ("question", r"/question/(\d+)"), ("article", r"/p/(\d+)"), ("pin", r"/pin/(\d+)"))
STRATEGY_HOSTS = (("douyin", ("douyin", "iesdouyin")), ("xiaohongshu", ("xiaohongshu", "xhs.com")), ("zhihu", ("zhihu",)))
SUPERVISOR_HOSTS = (("douyin", ("douyin",)), ("xiaohongshu", ("xiaohongshu",)), ("zhihu", ("zhihu",)), ("bilibili", ("bilibili",)))
VOLATILE_KEYS = ("timestamp", "ts", "_t", "time")


def matches_any(url: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | url.rlike(p)
    return out


def platform(url: Column, table: Iterable[tuple[str, Sequence[str]]] = PLATFORM_PATTERNS) -> Column:
    """The first platform of the table with a matching pattern; null if none matches."""
    return F.coalesce(*[F.when(matches_any(url, patterns), F.lit(name)) for name, patterns in table])


def platform_by_parts(url: Column, table: Iterable[tuple[str, Sequence[str]]], default: str) -> Column:
    """The first platform of which a part stands anywhere in the lower-cased url."""
    low = F.lower(url)
    return F.coalesce(*[F.when(F.exists(literals(parts), lambda p: F.contains(low, p)), F.lit(name)) for name, parts in table], F.lit(default))


def identifier(url: Column, patterns: Sequence[str]) -> Column:
    return first_match(url, patterns)


def typed_id(url: Column, types: Sequence[tuple[str, str]] = QA_TYPES) -> Column:
    """struct(id, type) of the first type whose pattern matches; ids of two groups are joined by a hyphen."""
    out = F.lit(None).cast("struct<id:string,type:string>")
    for name, pattern in reversed(types):
        parts = [F.regexp_extract(url, pattern, i + 1) for i in range(pattern.count("("))]
        out = F.when(url.rlike(pattern), F.struct(F.concat_ws("-", *parts).alias("id"), F.lit(name).alias("type"))).otherwise(out)
    return out


def content_type(name: Column, url: Column) -> Column:
    """Type of content from platform and link."""
    has = lambda p: F.contains(url, F.lit(p))
    qa = F.when(has("zvideo"), "knowledge_video").when(has("zhuanlan"), "article").when(has("answer"), "qa_answer").otherwise("knowledge_content")
    return F.when(name == "douyin", "short_video").when(name == "xiaohongshu", "lifestyle_note").when(name == "zhihu", qa).when(name == "bilibili", "video_content").otherwise("digital_content")


def routed(pages: DataFrame, name: Column, supported: Sequence[str]) -> DataFrame:
    """pages with platform, status and message: rows of other platforms are errors of the platform `unsupported`."""
    ok = name.isin(*supported)
    return pages.withColumns({
        "platform": F.when(ok, name).otherwise("unsupported"), "status": F.when(ok, "success").otherwise("error"),
        "message": F.when(ok, F.lit("")).otherwise("no extractor for this url"),
    })


def query_decoded(c: Column) -> Column:
    """A key or value of a query: + is a space, percent codes are UTF-8 bytes, and a % that begins no code stays."""
    return F.url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def query_encoded(c: Column) -> Column:
    """Percent codes for all but letters, digits and _.-~, and + for a space."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalised(url: Column, hosts: Sequence[str] = ("douyin.com", "iesdouyin.com"), drop: Sequence[str] = VOLATILE_KEYS) -> Column:
    """The url with its scheme in lower case, without fragment and empty query; on the hosts its query is read and written anew.

    Then keys in drop and keys without a value are left out, repeated keys stand at the place of their first, and keys and
    values are decoded and encoded again, so that links which differ in their codes only have one form.
    """
    bare = F.regexp_replace(F.regexp_replace(url, "(?s)#.*$", ""), r"\?$", "")
    scheme = F.regexp_extract(bare, "^[a-zA-Z][a-zA-Z0-9+.-]*(?=:)", 0)
    bare = F.concat(F.lower(scheme), F.substr(bare, F.length(scheme) + 1))
    base, query = F.substring_index(bare, "?", 1), F.regexp_extract(bare, r"(?s)\?(.*)$", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p.rlike("(?s)^[^=]*=."))
    read = F.transform(pairs, lambda p: F.struct(query_decoded(F.substring_index(p, "=", 1)).alias("k"), query_decoded(F.substr(p, F.locate("=", p) + 1)).alias("v")))
    read = F.filter(read, lambda p: ~F.array_contains(literals(drop), p["k"]))
    keys = F.array_distinct(F.transform(read, lambda p: p["k"]))
    grouped = F.flatten(F.transform(keys, lambda k: F.filter(read, lambda p: p["k"] == k)))
    made = F.array_join(F.transform(grouped, lambda p: F.concat(query_encoded(p["k"]), F.lit("="), query_encoded(p["v"]))), "&")
    cleaned = F.concat(base, F.when(F.size(grouped) > 0, F.concat(F.lit("?"), made)).otherwise(""))
    return F.when(F.exists(literals(hosts), lambda h: F.contains(authority(url), h)), cleaned).otherwise(bare)


def authority(url: Column) -> Column:
    """What stands between :// and the path, port and user included; empty without ://."""
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def url_key(url: Column, **options) -> Column:
    return F.md5(normalised(url, **options).cast("binary"))
