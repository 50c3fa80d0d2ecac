"""Elements by selector over the stack of open elements, and page state without recursion or rescanning."""

import json
import time

import pytest
from pyspark.sql import functions as F

from textloom.functions import html, tree
from textloom.operators import records


def first(page, *selectors):
    return tree.first_values(page, selectors)


def test_nested_elements_of_one_name_are_whole():
    page = '<div class="a b"><div>one <div>two</div> three</div> four</div><div class="b">next</div>'
    assert first(page, ".b", "div div", "div.a.b div div", ".c", "*") == ["one two three four", "one two three", "two", None, "one two three four"]


def test_chains_attributes_and_void_elements():
    page = '<a href="x">no</a><div class="in"><br><img src="i.png"/><p>t<span><a HREF="y" Class=" q  r ">yes</a></span></div><meta name=k content=" v "><meta name="k" content="w">'
    assert first(page, ".in a", ".in a@href", "a", "img@src", "meta[name=k]", 'meta[name="k"]', "[src]@src", ".in > a" if False else "div a.r.q", "p a") == ["yes", "y", "no", "i.png", "v", "v", "i.png", "yes", "yes"]
    assert first(page, "a@title", "br") == ["", ""]


def test_end_tags_that_close_nothing_and_elements_that_never_close():
    assert first("<p>a</b>b</p>c", "p") == ["ab"]
    assert first("<div><b>x</div>y<i>z", "b", "i", "div") == ["x", "z", "x"]
    assert first("<div class=o><p>a</div><p>b</p>", ".o p", "p") == ["a", "a"]


def test_scripts_comments_and_references_are_no_text():
    page = "<title>A &amp; B &eacute; &#39;</title><div>x<script>var p = '</div>'; 1 < 2</script><!-- <b>no</b> --><style>b{}</style>y</div>"
    assert first(page, "title", "div", "b") == ["A & B é '", "xy", None]


def test_references_without_a_semicolon_are_text():
    page = "<title>a &amp;&amp</title><h1>&ampx; &copy2; &#38 &quot &lt;&gt;</h1><a href='/?a=1&copy=2&amp;lt=3'>x</a>"
    assert first(page, "title", "h1", "a@href") == ["a &&amp", "&ampx; &copy2; &#38 &quot <>", "/?a=1&copy=2&lt=3"]


def test_hostile_pages_take_linear_time():
    began = time.time()
    deep = "<div class=k>" * 40_000 + "<a>x</a>" * 20_000
    assert first(deep, ".k .none a", ".k a") == [None, "x"]
    assert first("<p " * 30_000 + "<![broken" + "<!--" * 20_000, "h1") == [None]
    assert first("<p a='" * 30_000 + "<p b=\"" * 30_000 + "<q c='>" * 9000 + "<h1>t", "h1") in ([None], ["t"])
    assert time.time() - began < 20


def test_bad_selectors():
    for bad in ("", "a > b", "p:first", "..x"):
        with pytest.raises(ValueError):
            tree.selector(bad)


def test_cascades_of_videos(spark):
    page = '<meta property="og:title" content="abc"><title>A long title</title><meta property="og:site_name" content=""><div class="user-name x"><b>Ann</b> B</div><meta property="og:image" content="c.png"><meta name="description" content="about">'
    rows = spark.createDataFrame([(page,), ("",), (None,)], "p string").select(records.from_markup(F.col("p"), "video").alias("m")).collect()
    assert [tuple(r.m) for r in rows] == [("A long title", "about", "Ann B", "c.png"), (None,) * 4, (None,) * 4]
    r = spark.createDataFrame([(page,)], "p string").select(records.video_record(F.col("p"), F.lit(None).cast("string"), F.lit("")).alias("r")).first().r
    assert (r.title, r.author, r.description, r.cover_url) == ("A long title", "Ann B", "about", "c.png")


def test_one_parse_serves_all_cascades_of_a_page(spark):
    rows = spark.createDataFrame([("<h1>x</h1>",)], "p string")
    made = rows.select(records.from_markup(F.col("p"), "video"), records.from_markup(F.col("p"), "qa"), records.qa_record(F.col("p"), F.lit(None).cast("string"), F.lit("pin")))
    assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [values(") == 1


def plain(text, start):
    depth, quoted, i = 0, False, start
    while i < len(text):
        ch = text[i]
        if quoted:
            if ch == "\\":
                i += 1
            elif ch == '"':
                quoted = False
        elif ch == '"':
            quoted = True
        elif ch == "{":
            depth += 1
        elif ch == "}":
            depth -= 1
            if depth == 0:
                return text[start : i + 1]
        i += 1
    return None


def test_objects_end_where_a_plain_scan_of_valid_ones_ends():
    import random

    draw, seen = random.Random(3), 0
    for _ in range(4000):
        text = "".join(draw.choice(['{', '}', '"', '{"a":', '1', '"}"', '\\"', 'x = {', '"k":"v"', ',']) for _ in range(draw.randint(1, 14)))
        ends = html.object_ends(text)
        for i, c in enumerate(text):
            want = plain(text, i) if c == "{" and text[max(i - 1, 0)] != "\\" else None
            try:
                json.loads(want or "")
            except ValueError:
                continue
            seen += 1
            assert text[i : ends[i][0]] == want
    assert seen > 300


def test_deep_and_unclosed_state_is_null_and_costs_one_pass(spark):
    deep = "window.S = " + '{"a":' * 50_000 + "1" + "}" * 50_000
    lists = 'window.S = {"a":' + "[" * 50_000 + "]" * 50_000 + "}"
    unclosed = "window.S = {x " * 20_000 + ' window.S = {"ok": 1}'
    odd = 'window.S = {"never closed; window.S = {"ok": 2}'
    rows = spark.createDataFrame([(1, deep), (2, unclosed), (3, odd), (4, lists), (5, None), (6, 'window.T = {"t": 1} window.S = {"nickname": "n"}')], "i int, p string")
    began = time.time()
    state = html.script_json(["window.S", "window.T"])(F.col("p"))
    got = {r.i: (r.s, r.n) for r in rows.select("i", state.alias("s"), html.deep_find(["nickname"])(state).alias("n")).collect()}
    assert got == {1: (None, None), 2: ('{"ok": 1}', None), 3: ('{"ok": 2}', None), 4: (None, None), 5: (None, None), 6: ('{"nickname": "n"}', '"n"')}
    assert time.time() - began < 20
    found = rows.select("i", html.deep_find(["a"])(F.substring("p", 12, 10**7)).alias("a"), html.find_with(["a"])(F.substring("p", 12, 10**7)).alias("w"), html.first_entry()(F.substring("p", 12, 10**7), F.lit("a")).alias("f"))
    assert {r.i: (r.a, r.w, r.f) for r in found.where("i in (1, 4)").collect()} == {1: (None,) * 3, 4: (None,) * 3}
