"""Link propagation reaches its end and does not thin out with the number of linkers."""

import pytest

from textloom.llm import url_filter

RULES = [url_filter.Rule("allow", "com", "/"), url_filter.Rule("block", "net", "/")]


def judged(spark, links, **options):
    """{host: row}; links are (host, hosts it links to)."""
    rows = [(i, f"http://{h}/", "".join(f'<a href="http://{x}/">' for x in to)) for i, (h, to) in enumerate(links)]
    return {r.host: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES, **options).collect()}


def test_chain_longer_than_ten_links(spark):
    chain = ["bad.net"] + [f"h{i}.org" for i in range(1, 16)]
    got = judged(spark, [(h, chain[max(i - 1, 0) : i]) for i, h in enumerate(chain)])
    for i, h in enumerate(chain):
        assert got[h].distrust == pytest.approx(0.15 * 0.85**i, rel=1e-9) and got[h].verdict == "block"


def test_cycle_settles(spark):
    got = judged(spark, [("good.com", ["one.org"]), ("one.org", ["two.org"]), ("two.org", ["one.org"])])
    one = 0.15 * 0.85 / (1 - 0.85**2)
    assert got["one.org"].trust == pytest.approx(one, rel=1e-5) and got["two.org"].trust == pytest.approx(one * 0.85, rel=1e-5)


def test_many_linkers_are_all_blocked(spark):
    got = judged(spark, [("bad.net", [])] + [(f"l{i}.org", ["bad.net"]) for i in range(40)])
    assert {r.verdict for r in got.values()} == {"block"}
