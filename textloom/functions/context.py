"""Fields from free text given along with a link, and their overlay on what the page gave."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import contains_any, literals, strip

# Patterns in the order in which they are tried, and terms that spoil a title.
TITLE_PATTERNS = (r"@([^#\n@]+)", r"#([^#\n@]+)#?", r'"([^"]+)"', r"：(.+?)(?:\n|$)")
AUTHOR_PATTERNS = (r"@([a-zA-Z0-9._]+)", r"作者[:：]\s*([^\n]+)", r"by\s+([^\n]+)")
LINK_TERMS = ("链接", "url", "http")
INVALID_TITLE = ("验证码", "中间页", "安全验证", "人机验证", "captcha", "verify", "拦截", "隐患", "404", "not found", "error")
GENERIC_TITLES = ("抖音", "douyin", "视频", "短视频", "未知")
TITLE_NOISE = (r"^抖音[\s\-–—]*", r"[\s\-–—]*抖音$", r"^Douyin[\s\-–—]*", r"[\s\-–—]*Douyin$", r"^\s*-\s*", r"\s*-\s*$", r"^\s*·\s*", r"\s*·\s*$")
PAGE_MARKERS = ("验证码", "captcha", "verify", "安全验证", "人机验证", "中间页")


def _first_hit(text: Column, pattern: str) -> Column:
    return strip(F.get(F.regexp_extract_all(text, F.lit(pattern), 1), F.lit(0)))


def context_title(text: Column, patterns: Sequence[str] = TITLE_PATTERNS, spoilers: Sequence[str] = LINK_TERMS) -> Column:
    """The first hit of the first pattern whose first hit is over five characters and holds no link term; else null."""
    hits = [_first_hit(text, p) for p in patterns]
    return F.coalesce(*[F.when((F.length(h) > 5) & ~contains_any(F.lower(h), spoilers), h) for h in hits])


def context_author(text: Column, patterns: Sequence[str] = AUTHOR_PATTERNS) -> Column:
    hits = [_first_hit(text, p) for p in patterns]
    return F.coalesce(*[F.when(F.length(h) > 2, h) for h in hits])


def labelled(text: Column, labels: Sequence[str]) -> Column:
    """What follows the colon on the last line that holds one of the labels and a colon; null if there is none."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.exists(literals(labels), lambda k: F.contains(x, k)) & x.rlike("[:：]"))
    return strip(F.regexp_extract(F.try_element_at(lines, F.lit(-1)), r"^[^:：]*[:：](.*)$", 1))


def long_lines(text: Column, longer_than: int = 20) -> Column:
    """The lines over so many characters that have no colon, joined by a space."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: (F.length(x) > longer_than) & ~x.rlike("[:：]")), " ")


def mentions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"@([\p{L}\p{N}._]+)"), 1)


def hashtags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"#([\p{L}\p{N}_]+)"), 1)


def overlay(page: Column, context: Column, replace: Column) -> Column:
    """The context's value where the page is poor and the context has one, else the page's."""
    return F.when(replace, F.coalesce(context, page)).otherwise(page)


def clean_title(title: Column, noise: Sequence[str] = TITLE_NOISE) -> Column:
    """The title without site names and rules at its ends; the stripped title where nothing would be left."""
    out = strip(title)
    for p in noise:
        out = F.regexp_replace(out, "(?iu)" + p, "")
    return F.coalesce(F.nullif(strip(out), F.lit("")), strip(title))


def valid_title(title: Column, invalid: Sequence[str] = INVALID_TITLE, generic: Sequence[str] = GENERIC_TITLES) -> Column:
    t = strip(title)
    return ~contains_any(F.lower(title), invalid) & (F.length(t) >= 3) & ~F.lower(t).isin(*generic)


def low_quality(title: Column, content: Column, images: Column | None = None, terms: Sequence[str] = INVALID_TITLE) -> Column:
    """A spoiling term in the title, or neither content nor images."""
    bare = F.coalesce(content, F.lit("")) == ""
    if images is not None:
        bare = bare & (F.coalesce(F.size(images), F.lit(0)) <= 0)
    return contains_any(F.lower(title), terms) | bare


def file_name(title: Column, default: str = "document") -> Column:
    """Without forbidden characters, white space as _, at most 50 characters."""
    out = F.regexp_replace(F.regexp_replace(title, r'[\\/*?:"<>|]', ""), r"(?U)\s+", "_")
    cut = F.when(F.length(out) > 50, F.concat(F.substring(out, 1, 47), F.lit("..."))).otherwise(out)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(default))


def file_name_strict(title: Column, longest: int = 100) -> Column:
    """Forbidden and control characters and white space as _, no dots at the ends, cut to longest."""
    out = F.regexp_replace(strip(F.regexp_replace(title, r'[<>:"/\\|?*\x00-\x1f]', "_")), r"(?U)\s+", "_")
    out = F.regexp_replace(out, r"^\.+|\.+$", "")
    cut = F.when(F.length(out) > longest, F.regexp_replace(F.substring(out, 1, longest), "[_.]+$", "")).otherwise(out)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("untitled"))
