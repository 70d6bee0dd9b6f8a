from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.functions.hashing import affinity_shard


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v")).alias("x")).collect()]


CANONICAL = {
    "HTTP://Shop-A/list.html#top": "http://shop-a/list.html",
    "http://x/p?b=2&a=1": "http://x/p?a=1&b=2",
    "http://x/p?a=1&b=2": "http://x/p?a=1&b=2",
    "http://x/p?a=2&a=1&c": "http://x/p?a=1&a=2&c=",
    "http://A.example:80": "http://a.example:80/",
    "http://h/a/./b/../c//d/": "http://h/a/c/d/",
    "http://h/../x": "http://h/x",
    "../x": "../x",
    "http://h/für?q=a b&z=%7e*": "http://h/f%C3%BCr?q=a+b&z=~%2A",
    "http://h/a!b": "http://h/a!b",
    "http://h/a%2Fb": "http://h/a%2Fb",
    "http://h/?": "http://h/?",
    "http://h/p?x;y&c=%&d=1": "http://h/p?d=1",
    "http://u:p@H/%7Ea": "http://u:p@h/%7Ea",
    "mailto:Foo@x": "mailto:Foo@x",
    "http://h/%zz": "http://h/%zz",
    "http://ho st/": "http://ho st/",
    "  http://h/a  ": "http://h/a",
    "": "",
}


def test_canonical(spark):
    assert apply(spark, urls.canonical_url, list(CANONICAL)) == list(CANONICAL.values())


def test_canonical_is_idempotent(spark):
    once = apply(spark, urls.canonical_url, list(CANONICAL))
    assert apply(spark, urls.canonical_url, once) == once


def test_resolve(spark):
    cases = {
        "/products/p-1.html": "http://shop.test/products/p-1.html",
        "x.html": "http://shop.test/d/x.html",
        "../y/.": "http://shop.test/y/",
        "?q=1": "http://shop.test/d/list.html?q=1",
        "//Z/q": "http://z/q",
        "https://o/..": "https://o/",
        "javascript:alert(1)": "",
        "mailto:a@b": "",
        "#a": "",
        "": "",
        "tel:1": "tel:1",
        "%zz": "",
    }
    got = apply(spark, lambda c: urls.resolve_url(F.lit("http://shop.test/d/list.html?z=1"), c), list(cases))
    assert got == list(cases.values())


def test_http_host_shard(spark):
    assert apply(spark, urls.is_http, ["https://x", "ftp://x", "HTTP://x", "/x"]) == [True, False, True, False]
    assert apply(spark, urls.host_of, ["http://A.example/x", "http://a.b:80/", "http://[::1]:80/", "x"]) == [
        "a.example", "a.b", "::1", "",
    ]
    assert apply(spark, urls.domain_key, ["x"]) == ["unknown"]
    assert apply(spark, urls.robots_url, ["https://H:1/x", "x"]) == ["https://H:1/robots.txt", ""]
    assert apply(spark, lambda c: affinity_shard(c, 1), ["a.com"]) == [0]
    assert apply(spark, lambda c: affinity_shard(c, 4), ["a.com"]) == apply(
        spark, lambda c: affinity_shard(c, 4), ["A.com"]
    )
