from collections import Counter

import pytest

from depuse.llm import queries, url_filter
from tests.llm.helpers import frame

RULES = queries.URL_RULES
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return rest[:end].translate(LOWER), path[:stop]


def judge(url, rules):
    host, path = parts(url)
    fits = [
        (len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return (host, path, max(fits)[3], max(fits)[4]) if fits else (host, path, None, "allow")


URLS = [
    "https://WWW.Example.com/en/1?q=/x#y", "http://example.com/en/", "http://example.com/en", "http://example.com",
    "ftp://a.b.example.com/fr/2", "http://notexample.com/en/1", "http://x.net/es/1", "http://net/es/", "http://net/de/",
    "http://x.net#/es/", "http://x.net?/fr/", "https://", "://", "no scheme", "", None, "http://ÄB.com/é/x",
    "http://x.net/es/http://example.com/en/", "http://" + "a." * 3000 + "net/fr/" + "b/" * 5000, "http://com:80/",
    "http://u@x.com/en/", "a://b://example.com/en/", "http://example.com//en/", "http://.com/", "http://x.com./en/",
]


@pytest.mark.parametrize("limit", [50_000, 0])
def test_verdicts_agree_with_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", limit)
    rules = RULES + [("x.net", "/es", "allow"), ("com", "/é/x", "block"), ("x.com", "/en/", "allow"), ("X.com", "/en/", "block"),
                     (None, "/", "block"), ("a", None, "block")]
    plain = [(h.lower(), p, v) for h, p, v in rules if h and p]
    rows = [(k if k % 5 else None, u, "old") for k, u in enumerate(URLS + URLS[:4] + ["http://x.net/es/1"] * 40)]
    pages = frame(spark, rows, "page_id long, url string, verdict string")
    got = url_filter.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    found = Counter((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in got.collect())
    assert found == Counter((i, u, *judge(u, plain)) for i, u, _ in rows)


def test_empty_tables(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    row = url_filter.judge_urls(pages, rules.limit(0)).first()
    assert (row.host, row.path, row.rule, row.verdict) == ("a.com", "/", None, "allow")
