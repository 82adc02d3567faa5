import random
import re

from apisurface.llm import url_filter
from apisurface.llm.url_filter import Rule, filter_urls

SCHEMA = "page_id long, url string, host string"
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"))
LOWER = str.maketrans(url_filter.UPPER, url_filter.LOWER)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    return host.translate(LOWER), path


def canonical(url):
    host, path = parts(url)
    host = re.sub(r":\d*$", "", re.sub(r"^(?:www|m)\.", "", host))
    return host + re.sub("/+$", "", re.sub(r"\.html?$", "", path)) if parts(url)[0] else None


def brute(rows, listed):
    keys = {canonical(u) for u in listed} - {None}
    out = []
    for page, url in rows:
        host, path = parts(url)
        fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.name), default=None)
        own = "block" if canonical(url) in keys else "allow"
        out.append((page, host, path, rule and rule.name, rule.verdict if rule else own))
    return sorted(out, key=str)


def check(spark, rows, listed):
    pages = spark.createDataFrame([(p, u, "x") for p, u in rows], SCHEMA)
    names = spark.createDataFrame([(u,) for u in listed], "url string")
    got = filter_urls(pages, names, "page_id", "url", "url", RULES).drop("url", "listed").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, listed)


def test_against_plain_code(spark):
    rng = random.Random(3)
    hosts = ["a.example.com", "WWW.example.com", "example.com", "x.net", "net", "notnet", "m.b.org", "www.b.org", "b.org:80"]
    tails = ["", "/", "/en/1", "/es/2.html", "/es/2", "/p?q=1", "?x", "#y", "/p/#z", "/En/1"]
    urls = [f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(tails)}" for _ in range(400)]
    odd = [None, "", "no scheme", "://", "http://", "a://b://c/d", "http://x.net/es/\nq"]
    rows = list(enumerate(urls + odd)) + [(0, urls[0])]
    check(spark, rows, urls[::7] + [None, "nothing", urls[0]])


def test_empty_tables(spark):
    check(spark, [], [])
    check(spark, [(1, "http://b.org/x")], [])
    check(spark, [], ["http://b.org/x"])


def test_full_filter_stays_right(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", 1)
    rows = [(i, f"http://h{i % 900}.org/p{i}") for i in range(1500)]
    check(spark, rows, [u for _, u in rows[::2]])
