"""The queries on images and embedded JSON read the pages table they are given."""

import duckdb
import pytest

from textloom.plans import pages


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    sf_dir = tmp_path_factory.mktemp("sf")
    rows = [(10 + i, html) for i, html in pages.SAMPLE_PAGES] + [(20, '<img src="z.png"><meta name="description" content="a &amp; b"><script>window._ROUTER_DATA = {"author":{"nickname":"new"}};</script>')]
    spark.createDataFrame(rows, "page_id bigint, html string").write.parquet(f"{sf_dir}/pages.parquet")
    return str(sf_dir)


def collected(spark, table, name):
    return {r.page_id: r for r in pages.Q[name](spark, table).collect()}


def test_images(spark, table):
    got = collected(spark, table, "html_images")
    assert {i: (r.images, r.description) for i, r in got.items()} == {11: ("a.png|b.png", None), 12: ("", "described"), 13: ("", None), 14: (None, None), 20: ("z.png", "a & b")}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{table}/pages.parquet/*.parquet'")
    same = con.execute(f"SELECT page_id, images, description FROM ({pages.SQL['html_images']})").fetchall()
    assert sorted(same) == sorted((i, r.images, r.description) for i, r in got.items())


def test_embedded_json(spark, table):
    state = collected(spark, table, "html_script_json")
    assert {i for i, r in state.items() if r.state} == {11, 12, 20} and state[20].state == '{"author":{"nickname":"new"}}' and len(state) == 5
    found = collected(spark, table, "json_deep_find")
    assert {i: r.nickname for i, r in found.items()} == {11: '"n"', 12: '"u"', 13: None, 14: None, 20: '"new"'}
    video = collected(spark, table, "json_field_map")
    assert video[11].title == "one } two" and video[11].duration == 61 and video[20].title is None and len(video) == 5
