"""URL filters: parts of urls, rules, and the cascade, each against a plain version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gregale.llm import urlfilter as uf

URLS = [
    None, "", "no scheme", "://", "http://", "http://x.net", "http://x.net/", "http://X.NET?q=a/b", "https://a.Example.NET/en/1?x#y", "https://example.net/en", "ftp://notexample.net/en/2",
    "http://evilnet/de/", "http://b.example.com/de/9", "http://b.example.com/fr/9", "http://b.example.com/fr/10", "http://example.com:80/de/9", "http://c.org/fr/", "http://c.org/en/", "http://ÉCOLE.org/x://y", "a://b.example.com#/de/", "http://long.org/" + "x" * 50_000,
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [rest.find(c) for c in "/?#" if c in rest]
    host = rest[: min(ends)] if ends else rest
    path = rest[len(host) :].split("?")[0].split("#")[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute(urls, rules=uf.RULES, share=uf.LISTED_SHARE):
    rows = []
    for url in urls:
        host, path = parts(url)
        fit = [(len(t), t, what) for what, t in rules if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith("/" + t.split("/", 1)[1])]
        rows.append((host, path, *(max(fit)[1:] if fit else (None, None))))
    out = []
    for host, path, rule, said in rows:
        own = [r for r in rows if r[0] == host]
        listed = sum(r[3] == "block" for r in own) >= share * len(own)
        out.append((host, path, rule, said or ("block" if listed else "allow"), listed))
    return out


def test_urls(spark):
    urls = URLS + ["http://b.example.com/de/9"]
    pages = spark.createDataFrame([(i if i % 5 else None, u, "x") for i, u in enumerate(urls)], "page_id long, url string, listed string").repartition(3)
    got = uf.filter_urls(pages).collect()
    want = brute(urls)
    assert got[0].asDict().keys() == {"page_id", "host", "path", "rule", "verdict", "listed"}
    assert sorted(map(str, map(tuple, got))) == sorted(str((i if i % 5 else None, *w)) for i, w in enumerate(want))
    assert {w[3] for w in want if w[2] is None} == {"allow", "block"}


def test_no_urls(spark):
    assert uf.filter_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_ties_of_rules_go_to_the_longer_host(spark):
    rule, verdict = uf.rule_for(F.col("h"), F.col("p"), (("block", "b.c/xy"), ("allow", "a.b.c/")))
    assert tuple(spark.createDataFrame([("a.b.c", "/xyz")], "h string, p string").select(rule, verdict).first()) == ("a.b.c/", "allow")


@pytest.mark.parametrize("listed_part", [0.0, 0.003, 0.1, 0.5, 0.97, 1.0])
def test_levels_are_exact_and_small(listed_part):
    random = np.random.default_rng(3)
    h, g = (random.integers(0, 2**64, 100_000, np.uint64) for _ in range(2))
    listed = random.random(len(h)) < listed_part
    levels = uf.build_levels(h, g, listed)
    got = uf.decide([(b, k, np.frombuffer(w, np.uint8)) for b, k, w in levels], h, g)
    assert (got == listed).all()
    assert sum(b for b, _, _ in levels) < 5.5 * len(h) and (len(levels) > 3) == (0 < listed_part < 1)


def test_equal_hashes_of_a_listed_and_an_unlisted_key_are_an_error():
    same = np.array([7, 7], np.uint64)
    with pytest.raises(ValueError, match="equal hashes"):
        uf.build_levels(same, same, np.array([True, False]))


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_cascade_of_many_shards(spark, broadcast_bytes):
    """Keys in several shards; a third of the rows share one key, and ask in tasks of 400 rows. Sent to all tasks, or dealt."""
    keys = [(None if i == 5 else f"key {i}", i % 7 == 0) for i in range(3000)]
    cascade = uf.fit_cascade(spark.createDataFrame(keys + [("key 1", True), ("key 2", None)], "k string, is_listed boolean").repartition(4), "k", "is_listed", shard_keys=400)
    assert cascade.shards == 8 == cascade.table.count() and 0 < cascade.bytes() < 3000
    rows = [(i, k, "old") for i, (k, _) in enumerate(keys)] + [(i, "key 7", "old") for i in range(3000, 4500)]
    df = spark.createDataFrame(rows, "i long, k string, listed string").repartition(5)
    out = uf.mark_listed(df, "k", cascade, broadcast_bytes=broadcast_bytes, dealt_rows=400)
    assert out.columns == ["i", "k", "listed"]
    want = {i: (i % 7 == 0 or i == 1) if i < 3000 else True for i in range(4500)}
    assert {r.i: r.listed for r in out.collect()} == want and out.count() == 4500
    plan = out._jdf.queryExecution().toString()
    assert ("hashpartitioning(__shard" in plan) == (not broadcast_bytes)


def test_cascade_without_keys(spark):
    cascade = uf.fit_cascade(spark.createDataFrame([], "k string, l boolean"), "k", "l")
    df = spark.createDataFrame([("a",)], "k string")
    assert [r.listed for r in uf.mark_listed(df, "k", cascade).collect()] == [False]
    assert [r.listed for r in uf._mark_dealt(df, "k", cascade, "listed", 10).collect()] == [False]
