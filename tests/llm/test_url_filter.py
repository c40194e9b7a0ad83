import random

from crowdlens.llm import url_filter

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
         ("block", "com", "/de/"), ("block", "A.Example.Org", ""), (None, "x", "/"), ("block", None, "/"), ("block", "", "/"),
         ("block", "example.org", "/es/"), ("allow", "b.org", None), ("block", "b.org", "")]


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for action, h, p in RULES:
        h = (h or "").lower()
        p = p or ""
        if action and h and (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (-1,), (len(h + p), len(h), action, h + p))
    return host, path, best[3] if best else None, best[2] if best else "allow"


def urls():
    rng = random.Random(3)
    hosts = ["example.org", "a.example.org", "WWW.Example.ORG", "notexample.org", "x.com", "com", "org", "a.b.org", "b.org", "", "h:80",
             "example.org.", ".org", "É.org"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x=/de/", "/en/2", "/fr/a", "/de/#x", "?q=/es/", "#/es/", "/de/" + "y" * 5000]
    made = [f"{rng.choice(['http', 'https', ''])}://{h}{p}" for h in hosts for p in paths]
    return [None, "", "example.org/es/", "://", "a://b://org/", *made, *made[:9]]


def test_verdicts_equal_a_plain_search(spark):
    pages = spark.createDataFrame([(i if i % 9 else None, u, "x", "y") for i, u in enumerate(urls())],
                                  "page_id long, url string, prefix string, digest string")
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    got = url_filter.judge(pages, rules)
    assert sorted(map(repr, [(r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in got.collect()])) == sorted(
        map(repr, [(i if i % 9 else None, u, *brute(u)) for i, u in enumerate(urls())]))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "action string, host string, path string")
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.judge(pages, none).select("rule", "verdict").collect()] == [(None, "allow")]
    assert url_filter.judge(pages.limit(0), spark.createDataFrame(RULES, "action string, host string, path string")).count() == 0
