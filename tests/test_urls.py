"""URLs in the standard's form: a table made by hand from the standard's rules."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.urls import href

CASES = {
    "http://example.com": "http://example.com/", "HTTPS://EXAMPLE.com:443/A": "https://example.com/A", "http://a.com:80": "http://a.com/", "http://a.com:443/": "http://a.com:443/", "https://a.com:00080/": "https://a.com:80/", "http://a.com:/x": "http://a.com/x",
    "http:a.com/x": "http://a.com/x", "http:////a.com//x": "http://a.com//x", "http:\\\\a.com\\b\\c?d\\e": "http://a.com/b/c?d\\e", "  http://a.com/\t b\n": "http://a.com/%20b",
    "http://a.com/./b/../c/%2e%2E/d/.": "http://a.com/d/", "http://a.com/../../x/..": "http://a.com/", "http://a.com/a/..b/.c": "http://a.com/a/..b/.c", "http://a.com/a//../b": "http://a.com/a/b",
    "http://a.com/é?é#é": "http://a.com/%C3%A9?%C3%A9#%C3%A9", "http://a.com/a'b\"c<d>{e}`f|g": "http://a.com/a'b%22c%3Cd%3E%7Be%7D%60f|g", "http://a.com/?a'b\"c<d>{e}`f|g": "http://a.com/?a%27b%22c%3Cd%3E{e}`f|g", "http://a.com/#a'b\"c<d>{e}`f|g": "http://a.com/#a'b%22c%3Cd%3E{e}%60f|g",
    "http://a.com/%zz%20+": "http://a.com/%zz%20+", "http://a.com?x#y?z#w": "http://a.com/?x#y?z#w", "http://a.com/?": "http://a.com/?", "http://a.com/x#": "http://a.com/x#", "http://a.com/😀": "http://a.com/%F0%9F%98%80",
    "http://B%C3%BCcher.de/": "http://xn--bcher-kva.de/", "http://BÜCHER.de": "http://xn--bcher-kva.de/", "http://ex%41mple.com/": "http://example.com/", "http://a_b.com/": "http://a_b.com/",
    "http://127.1/": "http://127.0.0.1/", "http://0x7f.0.0.1": "http://127.0.0.1/", "http://017700000001/": "http://127.0.0.1/", "http://256.1.1.1/": None, "http://1.2.3.4.5/": None, "http://1.2.3.08/": None, "http://4294967296/": None, "http://4294967295/": "http://255.255.255.255/", "http://1.2.3.4./": "http://1.2.3.4/", "http://a.1a/": "http://a.1a/",
    "http://[::1]:80/x": "http://[::1]/x", "http://[FE80::A]:8080": "http://[fe80::a]:8080/", "http://[::1": None, "http://@a.com/": "http://a.com/", "http://:@a.com/": "http://a.com/",
    "http://me@a.com/": None, "http://me:pw@a.com/": None, "http://:pw@a.com/": None, "ftp://a.com/": None, "javascript:alert(1)": None, "//a.com": None, "a.com": None, "": None, "http://": None, "http:///": None, "http://a b.com/": None, "http://a.com:65536/": None, "http://a.com:x/": None, "http://a%00b.com/": None, "http://a|b.com": None, "http://a.com:99999999999999/": None,
}


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(u,) for u in CASES] + [(None,)], "u string")
    return {r.u: r.h for r in df.select("u", href(F.col("u")).alias("h")).collect()}


@pytest.mark.parametrize("url", CASES)
def test_href(found, url):
    assert found[url] == CASES[url]


def test_length_and_null(spark, found):
    assert found[None] is None
    long = spark.createDataFrame([("http://a.com/" + "x" * 5000,)], "u string").select(href(F.col("u")).alias("h")).first().h
    assert len(long) == 2048


def test_twice_is_once(spark, found):
    good = [h for h in found.values() if h]
    got = spark.createDataFrame([(h,) for h in good], "u string").select("u", href(F.col("u")).alias("h")).collect()
    assert all(r.u == r.h for r in got)
