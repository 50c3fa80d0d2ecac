"""Titles, metadata, images and embedded JSON of captured pages."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.text import first_filled, literals, strip

ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescaped(c: Column) -> Column:
    """The few character references that titles use; & last."""
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def tag_text(html: Column, tag: str) -> Column:
    """The stripped text of the first element of this name, inner tags removed; empty if there is none."""
    inner = F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
    return strip(unescaped(F.regexp_replace(inner, "(?s)<[^>]*>", "")))


def meta(html: Column, name: str, attribute: str = "name") -> Column:
    """The content of the first meta element with this name, in either order of attributes."""
    a = F.regexp_extract(html, rf"""(?is)<meta[^>]*\b{attribute}=["']{re.escape(name)}["'][^>]*\bcontent=["']([^"']*)["']""", 1)
    b = F.regexp_extract(html, rf"""(?is)<meta[^>]*\bcontent=["']([^"']*)["'][^>]*\b{attribute}=["']{re.escape(name)}["']""", 1)
    return unescaped(first_filled(a, b))


def charset(html: Column) -> Column:
    return F.regexp_extract(html, r"""(?i)<meta[^>]*\bcharset=["']?([a-zA-Z0-9_-]+)""", 1)


def images(html: Column) -> Column:
    """Distinct image sources in page order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"""(?is)<img[^>]*\bsrc=["']([^"']+)["']"""), 1))


def title_cascade(html: Column, longer_than: int = 5, without: str = "") -> Column:
    """The first of og:title, twitter:title, h1 and title that is long enough and lacks the site's name."""
    made = [meta(html, "og:title", "property"), meta(html, "twitter:title"), tag_text(html, "h1"), tag_text(html, "title")]
    good = [F.when((F.length(c) > longer_than) & (~F.contains(c, F.lit(without)) if without else F.lit(True)), c) for c in made]
    return F.coalesce(*good, F.lit(""))


def has_marker(html: Column, markers: Sequence[str]) -> Column:
    """Whether the lower-cased text holds one of the markers, wherever it stands."""
    low = F.lower(html)
    return F.exists(literals(markers), lambda m: F.contains(low, m))


#: What matters to where an object ends: brackets, quotes and escaped characters.
_MARKS = re.compile(r'[{}"]|\\.', re.DOTALL)
#: Levels of nesting beyond which a page's state counts as broken.
DEEPEST = 500


def object_ends(text: str) -> dict[int, tuple[int, int]]:
    """For each brace that opens an object and is closed again: where it ends, and how many levels are below it.

    Braces inside strings are not counted. Which stretches are strings depends on the number of quotes since the start,
    odd or even; so one pass with a stack for either case serves every start, and what never closes costs no more.
    """
    out: dict[int, tuple[int, int]] = {}
    stacks: tuple[list, list] = ([], [])
    odd = 0
    for m in _MARKS.finditer(text):
        c, stack = m[0], stacks[odd]
        if c == '"':
            odd = 1 - odd
        elif c == "{":
            stack.append([m.start(), 0])
        elif c == "}" and stack:
            start, below = stack.pop()
            out[start] = (m.end(), below)
            if stack:
                stack[-1][1] = max(stack[-1][1], below + 1)
    return out


def balanced(text: str, start: int) -> str | None:
    """The JSON object that opens at start, braces inside strings not counted; None if it never closes."""
    end = object_ends(text[start:]).get(0)
    return text[start : start + end[0]] if end else None


def parsed(text: str | None):
    """The value of a JSON text; None if it is null, broken or nested too deeply."""
    try:
        return json.loads(text)
    except (TypeError, ValueError, RecursionError):
        return None


def as_json(value) -> str | None:
    return None if value is None else json.dumps(value, ensure_ascii=False)


def script_json(names: Sequence[str]):
    """A pandas UDF: the first valid JSON object assigned to one of the variable names, in their order; else null."""
    patterns = [re.compile(re.escape(n) + r"\s*=\s*(?=\{)") for n in names]

    @F.pandas_udf(T.StringType())
    def extract(html: pd.Series) -> pd.Series:
        def one(page):
            starts = [m.end() for p in patterns for m in p.finditer(page)] if page else []
            ends = object_ends(page) if starts else {}
            for start in starts:
                end, below = ends.get(start, (0, 0))
                if end and below < DEEPEST and parsed(page[start:end]) is not None:
                    return page[start:end]
            return None

        return html.map(one)

    return extract


def find_first(node, test):
    """Depth-first, the first dict that test takes (its result, if not empty); iterative, so depth does not matter."""
    stack = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            hit = test(x)
            if hit:
                return hit
            stack += list(x.values())[::-1]
        elif isinstance(x, list):
            stack += x[::-1]
    return None


def deep_find(keys: Sequence[str]):
    """A pandas UDF: as JSON, the first non-empty value under one of the keys, depth first; null for broken JSON."""
    wanted = tuple(keys)

    @F.pandas_udf(T.StringType())
    def find(texts: pd.Series) -> pd.Series:
        def one(text):
            return as_json(find_first(parsed(text), lambda d: next((d[k] for k in wanted if d.get(k)), None)))

        return texts.map(one)

    return find


def first_entry():
    """A pandas UDF of JSON texts and keys: as JSON, the first value of the object that stands under the key, depth first."""

    @F.pandas_udf(T.StringType())
    def find(texts: pd.Series, keys: pd.Series) -> pd.Series:
        def one(text, key):
            hit = find_first(parsed(text), lambda d: d.get(key)) if key else None
            return as_json(next(iter(hit.values()))) if isinstance(hit, dict) else None

        return pd.Series([one(t, k) for t, k in zip(texts, keys, strict=True)])

    return find


def find_with(required: Sequence[str], wrappers: Sequence[str] = ()):
    """A pandas UDF: as JSON, the first object that has all required keys, or stands under a wrapper key."""
    need, wrap = tuple(required), tuple(wrappers)

    def test(d):
        for w in wrap:
            v = d.get(w)
            if isinstance(v, list) and v:
                v = v[0]
            if isinstance(v, dict) and v:
                return next(iter(v.values())) if w.endswith("Map") else v
        return d if all(k in d for k in need) else None

    @F.pandas_udf(T.StringType())
    def find(texts: pd.Series) -> pd.Series:
        def one(text):
            return as_json(find_first(parsed(text), test))

        return texts.map(one)

    return find


def lenient_json(answer: Column) -> Column:
    """The text if it is JSON, else the widest stretch from { to } if that is, else null."""
    whole, wide = strip(answer), F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    valid = lambda c: F.try_parse_json(F.nullif(c, F.lit(""))).isNotNull()
    return F.when(valid(whole), whole).when(valid(wide), wide)


def missing_fields(parsed: Column, required: Sequence[str]) -> Column:
    return F.filter(literals(required), lambda f: ~F.array_contains(F.coalesce(F.json_object_keys(parsed), F.array().cast("array<string>")), f))


#: Scores of an assessment that cannot be read.
ASSESSMENT_DEFAULT = {"content_depth": 70.0, "practicality": 70.0, "logical_coherence": 70.0, "innovation": 70.0, "professionalism": 70.0, "overall_score": 68.0, "confidence": 0.3}
ASSESSMENT_WEIGHTS = {"content_depth": 0.25, "practicality": 0.25, "logical_coherence": 0.2, "innovation": 0.15, "professionalism": 0.15}


def assessment(answer: Column) -> Column:
    """struct of scores in a model's answer; without an overall score the two names with an underscore add nothing to it."""
    schema = ", ".join(f"{k} double" for k in ASSESSMENT_DEFAULT)
    j = F.from_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0), schema)
    ok = lenient_json(answer).isNotNull()
    total = sum((F.coalesce(j[k], F.lit(0.0)) * w for k, w in ASSESSMENT_WEIGHTS.items() if "_" not in k), F.lit(0.0))
    own = {k: F.coalesce(j[k], F.lit(0.0)) for k in ASSESSMENT_WEIGHTS} | {"overall_score": F.coalesce(j["overall_score"], total), "confidence": F.coalesce(j["confidence"], F.lit(0.5))}
    return F.struct(*[F.when(ok, own[k]).otherwise(d).alias(k) for k, d in ASSESSMENT_DEFAULT.items()])
