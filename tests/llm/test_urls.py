import random

from gaugeworks.llm import urls

RULES = [*urls.RULES, ("a.b.org", "/", "block"), ("b.org", "/x/", "allow"), ("a.b.org", "/x/y", "allow"), ("a.b.org", "/x/y", "block"), (None, "/", "block"), ("net", "", "block")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = path = ""
    at = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, rest = rest[:at], rest[at:]
    at = next((i for i, c in enumerate(rest) if c in "?#"), len(rest))
    path = rest[:at]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def judged(url, rules):
    host, path = parts(url)
    fits = [r for r in rules if None not in r and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block"), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def addresses():
    rng = random.Random(2)
    hosts = ["org", "b.org", "a.b.org", "x.a.b.org", "xb.org", "example.org", "www.EXAMPLE.org", "example-x.org", "q.com", "com", "net", "a..org", "", ".org", "xn--Ü.com"]
    paths = ["", "/", "/x/", "/x/y", "/x/yz", "/es/1", "/en/1", "/en/12", "/fr/", "/de/a", "?q=/x/", "#/es/", "/x?y#z", "/\nb"]
    found = [rng.choice(["http://", "ftp://", "://"]) + h + p for h in hosts for p in paths]
    return [*found, None, "", "no scheme/x", "http:/one", *found[:20]]


def test_against_brute_force(spark, monkeypatch):
    urls_ = addresses()
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls_)], "page_id long, url string, rule string, depth string")
    for rules in (RULES, [], list(urls.RULES)):
        for size in (4096, 2):
            monkeypatch.setattr(urls, "RULES_PER_RANGE", size)
            frame = spark.createDataFrame(rules, "host string, path string, verdict string")
            found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.match_rules(pages, frame).collect()}
            assert found == {i: judged(u, rules) for i, u in enumerate(urls_)}


def test_no_rows(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    assert urls.match_rules(pages, rules).count() == 0
