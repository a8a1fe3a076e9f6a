from rimeweave.llm.queries import URL_RULES
from rimeweave.llm.urls import filter_urls

RULES = (*URL_RULES, ("allow", "a.org", "/x"), ("block", "a.org", "/x"), ("allow", None, "/"))
URLS = [
    (1, "http://a.example.net/fr/1"), (2, "HTTPS://WWW.Example.NET/en/x?q=/fr/"), (3, "http://example.com/de"),
    (4, "http://x.example.com/de/1#t"), (5, "http://notexample.com/de/1"), (6, None), (7, "no scheme.net/"), (8, ""),
    (9, "http://net"), (10, "http://net/"), (11, "http://a.org/xyz"), (12, "http://b.org/fr/x"), (13, "http://b.org/frx"),
    (14, "x://http://a.net/"), (15, "http://ÄB.net\n/a\nb?c"), (16, "http://example.net/en/" + "y/" * 5000), (1, "http://a.net/"),
]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    ends = [rest.find(c) for c in "/?#" if c in rest]
    host = rest[: min(ends)] if ends else rest
    path = rest[len(host) :]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [
        (h.count("."), len(p), v, h + p) for v, h, p in RULES
        if h is not None and ("." + host).endswith("." + h) and path.startswith(p)
    ]
    best = max(fit, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def check(rows):
    assert sorted((r.page_id, *map(str, (r.host, r.path, r.rule, r.verdict))) for r in rows) == sorted(
        (key, *map(str, brute(url))) for key, url in URLS
    )


def test_trie(spark):
    df = spark.createDataFrame([(*row, "z") for row in URLS], "page_id long, url string, rule string")
    check(filter_urls(df, RULES).collect())
    assert filter_urls(df.limit(0), RULES).count() == 0


def test_rules_as_frame_and_beyond_the_broadcast_bound(spark):
    df = spark.createDataFrame(URLS, "page_id long, url string")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    check(filter_urls(df, rules).collect())
    check(filter_urls(df, rules, most_bytes=0).collect())
