"""The SQL of the link query on pages that do link, and pages of very much markup."""

import random

import duckdb
import pandas as pd

from textloom.llm import queries, url_filter


def linked_pages(seed, n_hosts=60, n_pages=300):
    draw = random.Random(seed)
    hosts = [f"h{i}.{draw.choice(('org', 'org', 'org', 'com', 'net', 'io'))}" for i in range(n_hosts)]
    # Two chains to blocked hosts, a host with many linkers, cycles and random links.
    links = {h: [draw.choice(hosts) for _ in range(draw.choice((0, 0, 1, 2, 5)))] for h in hosts}
    chain = ["bad.net"] + [f"c{i}.org" for i in range(19)]
    links |= {chain[i]: [chain[i - 1]] for i in range(1, len(chain))} | {f"many{i}.org": ["spam.net"] for i in range(30)} | {"bad.net": [], "spam.net": ["c3.org"]}
    rows = []
    for k, (host, to) in enumerate(list(links.items()) + [(draw.choice(hosts), []) for _ in range(n_pages)]):
        path = draw.choice(("/es/x", "/fr/", "/en/1", "/", "")) if host.endswith("net") else draw.choice(("/a", "/en/1", ""))
        rows.append((k, f"http://{host}{path}?q={k}", "".join(f"<a HREF = 'https://{x.upper()}/p'>" for x in to)))
    return [*rows, (9000, None, None), (9001, "no host", "<a href='http://x.org/'>"), (9002, "http://alone.org", None)]


def test_sql_equals_the_query_once_pages_link(spark, tmp_path):
    blocked = 0
    for seed in range(3):
        rows = linked_pages(seed)
        folder = tmp_path / str(seed)
        folder.mkdir()
        pages = pd.DataFrame(rows, columns=["page_id", "url", "html"])
        pages.to_parquet(folder / "pages.parquet")
        got = queries.op5_url_link_propagation(spark, str(folder)).collect()
        base = duckdb.connect()
        base.register("pages", pages)
        want = base.execute(queries.oracles()["op5_url_link_propagation"]).fetchall()
        assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
        blocked += sum(r.verdict == "block" and r.rule is None for r in got)
    assert blocked > 100


def test_more_seeds_of_one_side_do_not_decide(spark):
    rules = [url_filter.Rule("allow", "com", "/"), url_filter.Rule("block", "net", "/")]
    a = lambda *to: "".join(f'<a href="http://{h}/">' for h in to)
    # x.org is linked by one of thirty trusted hosts that link to nothing else, and links to the one blocked host.
    rows = [(0, "http://x.org/", a("bad.net")), (1, "http://bad.net/", ""), *((10 + i, f"http://g{i}.com/", a("x.org") if i == 0 else "") for i in range(30))]
    got = {r.host: r.verdict for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    assert got["x.org"] == "block"


def test_a_page_of_very_much_markup(spark):
    html = "<p class='x'>text</p> href= " * 60_000 + "".join(f'<a href="http://l{i % 700}.org/{i}">' for i in range(20_000))
    rows = spark.createDataFrame([(1, "http://start.com/", html), (2, "http://l5.org/", None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.judge_urls(rows, [url_filter.Rule("allow", "com", "/")]).collect()}
    assert got[2].verdict == "allow" and 0 < got[2].trust < 0.01
