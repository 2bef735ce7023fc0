from tonarium.llm import urlfilter


def verdict(url, rules, default="allow"):
    url = url or ""
    rest = url.partition("://")[2] if "://" in url else ""
    end = min([len(rest), *(rest.index(c) for c in "/?#" if c in rest)])
    host, path = rest[:end], rest[end:].split("?")[0].split("#")[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[1] if best else default


URLS = [
    "http://example.org/es/1", "https://a.EXAMPLE.org/en/12", "http://example.org/en/2", "x://example.org", "http://example.org?x=/es/", "http://notexample.org/es/", "https://m.b.com/fr/", "http://com/de/#x",
    "http://a.net/de/", "no url", "", None, "://org/", "http://a://b.org/es/", "http://u@org:80/", "http://example.org//es/", "HTTP://É.ORG/ES/", "http://org./", "http://a.org/" + "x" * 5000, "http://ünï.com/fr/ß?q#f",
]


def test_verdicts(spark):
    frame = spark.createDataFrame([(i % 15, u, "h") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, host string")
    for limit in (urlfilter.BROADCAST_ROWS, 0):
        urlfilter.BROADCAST_ROWS, kept = limit, urlfilter.BROADCAST_ROWS
        got = sorted(map(str, map(tuple, urlfilter.filter_urls(frame, urlfilter.rules_frame(spark, urlfilter.RULES)).collect())))
        urlfilter.BROADCAST_ROWS = kept
        assert got == sorted(str((i % 15, *verdict(u, urlfilter.RULES))) for i, u in enumerate(URLS + URLS[:3]))


def test_rules_of_all_kinds(spark):
    frame = spark.createDataFrame([(1, "http://a.b/c"), (None, "http://b/")], "page_id long, url string")
    none = urlfilter.rules_frame(spark, [])
    assert {tuple(r)[3:] for r in urlfilter.filter_urls(frame, none, default="block").collect()} == {(None, "block")}
    rules = urlfilter.rules_frame(spark, [("b", "", "allow"), ("b", "", "block"), (None, "/", "allow"), ("a.b", "/c", "allow")])
    assert {(r.page_id, r.rule, r.verdict) for r in urlfilter.filter_urls(frame, rules).collect()} == {(1, "a.b/c", "allow"), (None, "b", "block")}
    assert urlfilter.filter_urls(frame.limit(0), rules).collect() == []


def test_host_and_path_stay_apart_and_ties(spark):
    rules = urlfilter.rules_frame(spark, [("b", "c", "block"), ("x.y", "/", "allow"), ("y", "/zz", "block"), ("q", "/a", "allow"), ("q", "/a", "block")])
    urls = ["http://bc/", "http://b/c", "http://x.y/zz", "http://q/a", "http://q/b"]
    got = urlfilter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    assert [(r.rule, r.verdict) for r in sorted(got, key=lambda r: r.page_id)] == [(None, "allow"), (None, "allow"), ("x.y/", "allow"), ("q/a", "block"), (None, "allow")]
