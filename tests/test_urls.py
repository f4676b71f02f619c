import pytest
from pyspark.sql import functions as F

from cases import ACCEPT, BLOCKED, CANONICAL, CANONICAL_MORE
from hrefloom.functions import policy, urls


def test_canonical_cases(spark):
    cases = CANONICAL + CANONICAL_MORE
    df = spark.createDataFrame(cases, "input string, expected string")
    got = df.select("input", "expected", urls.canonicalise("input").alias("got")).collect()
    assert [r for r in got if r["expected"] != r["got"]] == []


def test_canonicalise_is_idempotent_and_composes(spark):
    df = spark.createDataFrame([(c,) for c, _ in CANONICAL + CANONICAL_MORE + ACCEPT + BLOCKED], "u string")
    once = df.select("u", urls.canonicalise("u").alias("c"))
    assert once.where(F.col("c") != urls.canonicalise("c")).collect() == []
    assert once.where(F.col("c") != urls.url_key("c")).collect() == []
    steps = df.select("u", urls.url_components("u").alias("s"))
    for step in (urls.norm_auth, urls.norm_path, urls.norm_encoding, urls.norm_query, urls.norm_fragment):
        steps = steps.select("u", step("s").alias("s"))
    both = steps.select(urls.render_url("s").alias("a"), urls.canonicalise("u").alias("b"))
    assert both.where(~F.col("a").eqNullSafe(F.col("b"))).collect() == []


def test_components(spark):
    row = (
        spark.range(1)
        .select(urls.url_components(F.lit("HTTP://u:p@Ex.COM:81/A/b?x=1&y&x=%20#f")).alias("c"))
        .first()["c"]
        .asDict(recursive=True)
    )
    assert row == {
        "scheme": "http", "userinfo": "u:p", "host": "ex.com", "port": 81, "path": "/A/b",
        "query": [{"k": "x", "v": "1", "pos": 0}, {"k": "y", "v": None, "pos": 1}, {"k": "x", "v": " ", "pos": 2}],
        "fragment": "f",
    }
    rel = spark.range(1).select(urls.url_components(F.lit("a/b")).alias("c")).first()["c"]
    assert rel["scheme"] is None and rel["host"] is None and rel["path"] == "a/b" and rel["query"] is None


def test_malformed_percent_is_left_alone_in_a_struct(spark):
    s = F.struct(
        F.lit("http").alias("scheme"), F.lit(None).cast("string").alias("userinfo"), F.lit("h").alias("host"),
        F.lit(None).cast("int").alias("port"), F.lit("/%zz%4%41%+a%").alias("path"),
        F.lit(None).cast("array<struct<k:string,v:string,pos:int>>").alias("query"),
        F.lit(None).cast("string").alias("fragment"),
    )
    assert spark.range(1).select(urls.norm_encoding(s)["path"]).first()[0] == "/%zz%4A%+a%"


@pytest.mark.parametrize(
    "url,key",
    [
        ("HTTPS://EX.com/A?B#C", "https://ex.com/A?B#C"),
        ("http://User@EX.com:80/", "http://User@ex.com:80/"),
        ("http://ex.com/?", "http://ex.com/?"),
        ("not A url", "not A url"),
        ("mailto:A@B", "mailto:A@B"),
    ],
)
def test_url_key(spark, url, key):
    assert spark.createDataFrame([(url,)], "u string").select(urls.url_key("u")).first()[0] == key


def test_accept_and_blocked_cases(spark):
    for cases, rule in ((ACCEPT, policy.accept_url), (BLOCKED, policy.is_blocked)):
        df = spark.createDataFrame(cases, "url string, expected boolean")
        wrong = df.select("url", "expected", rule("url").alias("got")).where("got is null or got <> expected")
        assert wrong.collect() == []


def test_long_urls_do_not_overflow_the_stack(spark):
    long = "https://h.example/" + "%41a/" * 60000 + "?" + "k=%20v&" * 30000
    df = spark.createDataFrame([(long,)], "u string")
    got = df.select(F.length(urls.canonicalise("u")).alias("n"), policy.accept_url("u").alias("ok")).first()
    assert got["n"] > 100000 and got["ok"]
