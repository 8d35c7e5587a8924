import random

from pyspark.sql import functions as F

from fluxweave.llm import url_filter


def brute(url, listed):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url[url.index("://") + 3 :]
    cut = lambda s, chars: s[: min([s.index(c) for c in chars if c in s] + [len(s)])]
    raw = cut(rest, "/?#")
    path, host = cut(rest[len(raw) :], "?#"), "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if host in listed else "allow"


URLS = [
    None, "", "nothing", "http://", "https://EXAMPLE.com/en/x", "https://www.example.com/en/x?a#b", "http://a.www.example.com/en/", "http://example.com/EN/", "http://example.com", "http://example.com?x=/en/",
    "http://shop.net/es/1", "http://shop.net/es", "http://net/fr/", "http://casino-win.example.org/de/", "https://m.free-bets.example.net/fr/1", "https://m.free-bets.example.net/en/1", "ftp://spam-farm.org#x",
    "http://Ünï.com/a", "x://y://z/q", "http://notcom/en/", "http://a.com\n/b", "http://h/p\nq?r",
]


def test_against_brute_force(spark):
    rows = list(enumerate(URLS))
    hosts = {brute(u, ())[0] for u in URLS}
    listed = {h for h in hosts if set(h.split(".")) & set(url_filter.LISTED_LABELS)}
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"))
    for r in got.collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute(r.url, listed), r.url


def test_the_cascade_is_exact_over_its_universe(spark):
    rng = random.Random(1)
    keys = [(f"h{rng.random()}.org", k % 10 == 0) for k in range(3000)]
    universe = spark.createDataFrame(keys, "key string, listed boolean")
    cascade = url_filter.Cascade(universe, first_fp=0.3)
    assert len(cascade.levels) >= 3
    assert universe.where(cascade.contains(F.col("key")) != F.col("listed")).count() == 0


def test_cascade_corner_cases(spark):
    some = spark.createDataFrame([("a", True), ("b", False), ("", False)], "key string, listed boolean")
    for universe in (some, some.where("listed"), some.where("not listed"), some.where("key = 'zz'")):
        cascade = url_filter.Cascade(universe)
        assert universe.where(cascade.contains(F.col("key")) != F.col("listed")).count() == 0


def test_a_list_from_a_table(spark):
    pages = spark.createDataFrame([(1, "http://bad.org/x"), (2, "http://good.org/x"), (3, "http://bad.org/x")], "page_id long, url string")
    got = url_filter.judge(pages, block_list=spark.createDataFrame([("bad.org",), ("unseen.org",), ("bad.org",)], "host string"))
    assert {r.page_id: r.verdict for r in got.collect()} == {1: "block", 2: "allow", 3: "block"}


def test_odd_inputs(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x", 1, "z")], "page_id long, url string, host int, rule string")
    assert url_filter.judge(pages.where("page_id < 0")).count() == 0
    r = url_filter.judge(pages.unionByName(pages)).collect()
    assert [(x.host, x.rule) for x in r] == [("a.com", "com/")] * 2
