"""URL rules against a plain scan of all rules."""

import random

from pyspark.sql import functions as F

from episode_mart.llm import urls

RULES = "host string, path string, verdict string"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[end:]
    cut = min((path.find(c) for c in "?#" if c in path), default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), path[:cut]


def plain(url, rules):
    host, path = split(url)
    fits = [(len(h + (p or "")), len(h), h + (p or ""), v) for h, p, v in rules
            if h and v and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def judged(spark, found, rules, **how):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(found)], "page_id long, url string, rule string, `a.b` string")
    got = urls.judge(df, spark.createDataFrame(rules, RULES), **how)
    assert got.columns == ["page_id", "url", "a.b", "host", "path", "rule", "verdict"]
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()}


def test_rules_equal_plain_scan(spark):
    r = random.Random(1)
    labels, parts = ["a", "b", "com", "co.uk", "x-y"], ["", "/", "/en", "/en/", "/en/x", "/en/x/", "//", "/é"]
    rules = list({(h, p): (h, p, v) for h, p, v in (
        (".".join(r.choices(labels, k=r.randint(1, 3))), r.choice(parts), r.choice(["block", "allow"])) for _ in range(60))}.values())
    found = [f"http://{'.'.join(r.choices(labels, k=r.randint(1, 5))).title() if r.random() < .3 else '.'.join(r.choices(labels, k=r.randint(1, 5)))}"
             f"{r.choice(parts)}{r.choice(['', 'z', '/q/', 'x/y'])}{r.choice(['', '?q=/en/', '#/en/'])}" for _ in range(600)]
    want = {i: plain(u, rules) for i, u in enumerate(found)}
    assert len({w[2] for w in want.values()}) > 20
    assert judged(spark, found, rules) == want
    # of short digests nearly all collide; the whole digests decide
    assert judged(spark, found, rules, prefix=1) == want


def test_odd_urls(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("net", "/", "allow"), (None, "/", "block"),
             ("", "/", "block"), ("void", None, "block"), ("off", "/", None), ("ORG", "/fr/", "allow")]
    found = [None, "", "no scheme", "://", "http://", "http://net", "http://net/", "HTTP://Example.NET/en/x?y#z", "a://b://net/",
             "http://a..net/", "http://net./", "http://xnet/", "http://void", "http://void?x/y", "http://off/", "http://É.org/fr/",
             "http://net/\n/x", "x\ny://net/a\nb?c", "http://net/", "http://net/",
             "http://" + "a." * 50_000 + "net/" + "p/" * 100_000, "http://" + "é" * 200_000 + "/" + "q" * 200_000]
    known = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("void", "", "block"), ("org", "/fr/", "allow")]
    got = judged(spark, found, rules)
    assert got == {i: plain(u, known) for i, u in enumerate(found)}
    assert got[0] == ("", "", None, "allow") and got[6][2:] == ("net/", "block") and got[5][2:] == (None, "allow")
    nothing = urls.judge(spark.createDataFrame([(1, "http://net/")], "page_id long, url string"), spark.createDataFrame([], RULES))
    assert [tuple(r) for r in nothing.collect()] == [(1, "http://net/", "net", "/", None, "allow")]
    assert judged(spark, [], rules) == {}


def test_one_url_in_most_rows(spark):
    df = spark.range(30_000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 > 0, "http://a.net/x").otherwise(
        F.concat(F.lit("http://b.net/en/"), "id")).alias("url"))
    got = urls.judge(df, spark.createDataFrame([("net", "/", "block"), ("b.net", "/en/", "allow")], RULES))
    assert {(r["verdict"], r["rule"]): r["count"] for r in got.groupBy("verdict", "rule").count().collect()} == {
        ("block", "net/"): 20_000, ("allow", "b.net/en/"): 10_000}
