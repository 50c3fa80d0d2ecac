"""Normalised links against the standard library's reading and writing of queries."""

from urllib.parse import parse_qs, urlencode, urlparse, urlunparse

import pytest
from pyspark.sql import functions as F

from textloom.functions import urls

URLS = [
    "https://www.douyin.com/v/1?b=%7e&a=x+y&b=2&ts=5#top", "HTTPS://www.douyin.com/v?a=%41&%61=2&c=&d&=e&f=g=h", "https://v.iesdouyin.com/?k=%E4%B8%AD%e6%96%87&x=中*!'()",
    "https://douyin.com/p;q=1?a=100%&b=%zz&c=%2B%26%3D", "https://douyin.com/?", "https://other.com/?a=%7e&a=#x", "https://other.com/x?#", "https://www.douyin.com/?timestamp=1&time=2", "https://douyin.com/a?x=%20&y=+",
]


def plain(url):
    u = urlparse(url)
    query = u.query
    if "douyin.com" in u.netloc:
        query = urlencode({k: v for k, v in parse_qs(u.query).items() if k not in ("timestamp", "ts", "_t", "time")}, doseq=True)
    return urlunparse((u.scheme, u.netloc, u.path, u.params, query, ""))


@pytest.mark.parametrize("url", URLS)
def test_links(spark, url):
    assert spark.createDataFrame([(url,)], "u string").select(urls.normalised(F.col("u"))).first()[0] == plain(url)


def test_null(spark):
    assert spark.createDataFrame([(None,)], "u string").select(urls.normalised(F.col("u"))).first()[0] is None
