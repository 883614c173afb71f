"""URL filters against plain rules and lists."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from mcqflow.llm import urls

COLUMNS = "page_id bigint, url string, html string, key string, row int, `rank` int"


@pytest.fixture
def pages(spark):
    def build(rows):
        return spark.createDataFrame([(i, u, "<p>", "k", 1, 2) for i, u in rows], COLUMNS)

    return build


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain(url, rules, listed, canonical):
    host, path = split(url)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: (len(r.name), len(r.host)))
        return host, path, best.name, best.verdict
    return host, path, None, "block" if canonical in listed else "allow"


ODD = [
    None, "", "no scheme", "http://", "http://A.ORG", "http://a.org/", "HTTP://É.Org/x?y://b.com/fr/", "https://example.org/es/1",
    "https://sub.EXAMPLE.org/en/17#x", "https://notexample.org/en/1", "ftp://x.com?/fr/", "ftp://x.com/fr/?a", "//x.com/de/", "a://b://c.com/de/",
    "http://u:p@x.com:80/de/", "http://com/de/", "http://org./", "http://casino.net/a/", "https://www.casino.net//a", "http://casino.net/a?ref=1&b=2",
    "http://m.casino.net/a?b=2&a=1#f", "http://m.casino.net/a?a=1&b=2", "http://h.net/\n/x", "http://" + "a." * 500 + "com/fr/" + "x" * 5000,
]


def test_canonical_urls(spark):
    same = [
        ("http://www.A.com:80//b/index.html?utm_source=x&z=1&a=2#t", "a.com/b?a=2&z=1"), ("https://a.com", "a.com"),
        ("https://u@a.com/", "a.com"), ("https://a.com/?", "a.com"), ("https://a.com/B/", "a.com/B"), ("https://a.com?ref=1&q", "a.com?q"),
        ("a.com/b", None), (None, None),
    ]
    got = spark.createDataFrame(same, "url string, want string").select(urls.canonical(F.col("url")).alias("c"), "want").collect()
    assert [r.c for r in got] == [r.want for r in got]


@pytest.mark.parametrize("broadcast, blocks", [(200_000, 1 << 15), (0, 1)])
def test_verdicts(spark, pages, monkeypatch, broadcast, blocks):
    """Through the broadcast and the salted join, with a filter that fits and one that is full."""
    monkeypatch.setattr(urls, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(urls, "MAX_BLOCKS", blocks)
    r = random.Random(1)
    made = [
        f"http://{r.choice(['', 'www.', 'x.'])}{r.choice(['a.net', 'example.org', 'b.com', 'spam-farm.net', 'pills.org'])}/{r.choice(['es', 'en', 'fr', 'de'])}/{r.randint(1, 20)}{r.choice(['', '/', '?ref=2', '#top'])}"
        for _ in range(300)
    ]
    rows = [*enumerate(ODD + made), (1, ODD[5]), (1, ODD[5]), (None, ODD[6]), (None, None)]
    frame = pages(rows).repartition(3)
    canonical = {x.url: x.c for x in frame.select("url", urls.canonical(F.col("url")).alias("c")).collect()}
    listed = {x.url for x in urls.spam_urls(frame).collect()}
    assert listed == {c for u, c in canonical.items() if c and re.search(urls.SPAM_HOST, split(u)[0])}
    for rules in (urls.RULES, (), (*urls.RULES, urls.Rule("block", "net", ""), urls.Rule("allow", "a.net", "/en"))):
        got = [tuple(x) for x in urls.judge(frame, spark.createDataFrame([(u,) for u in listed], "url string"), rules).collect()]
        want = [(i, *plain(u, rules, listed, canonical[u])) for i, u in rows]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_filter_holds_every_key_and_few_others(spark):
    keys = spark.range(5000).select(F.concat(F.lit("u key "), "id").alias("key"))
    blocks = urls.block_count(5000)
    words = urls.bloom_filter(keys, blocks).scalar()
    others = spark.range(20_000).select(F.concat(F.lit("u other "), "id").alias("key"))
    assert keys.where(~urls.may_hold(words, F.col("key"), blocks)).count() == 0
    assert others.where(urls.may_hold(words, F.col("key"), blocks)).count() < 100


def test_empty_tables_and_plan(spark, pages):
    empty = pages([])
    assert urls.judge_pages(empty).count() == 0
    assert urls.judge_pages(pages([(1, "http://a.net/x")])).first().verdict == "allow"
    df = urls.judge_pages(pages([(1, "http://spam.net/x"), (2, "http://www.spam.net/x/?utm_a=1")]))
    assert [r.verdict for r in df.collect()] == ["block", "block"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
