from collections import defaultdict

from spoor.llm import url_filters as U
from spoor.llm.queries import QUERIES, RULES


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]


def rule_of(host, path):
    fits = [(len(r), v == "block", v, r) for v, r in RULES for h, p in [(r.split("/", 1)[0], "/" + r.split("/", 1)[1])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def test_query_rules(spark, sf):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op1_url_filters"](spark, sf).collect()
    assert len(rows) == len(urls)
    for r in rows:
        verdict, rule = rule_of(*split(urls[r.page_id]))
        assert (r.host, r.path, r.rule) == (*split(urls[r.page_id]), rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/x?y#z", "a://É.com?x", "http://h#f/q", "x://://a/b", "http://ncom/", "http://a.net/es/?", "http://a.net/es"]
    pages = spark.createDataFrame([(i, u, None, "k", 1.0) for i, u in enumerate([*urls, urls[3]])], "page_id long, url string, html string, rule string, trust double")
    found = {r.page_id: r for r in U.judge(pages, RULES).collect()}
    for i, u in enumerate(urls):
        assert (found[i].host, found[i].path, found[i].rule) == (*split(u), rule_of(*split(u))[1])
    assert found[0].verdict == "allow" and found[3].verdict == "allow" and found[8].verdict == "block"
    assert U.judge(pages.limit(0), RULES).count() == 0


def test_propagation_is_the_power_method(spark):
    edges = [("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("d", "c", 3.0), ("e", "d", 1.0)]
    seeds = [("a", 1.0, 0.0), ("c", 0.0, 1.0), ("d", 0.5, 0.5)]
    found = {r.host: (r.trust, r.distrust) for r in U.propagate(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame(seeds, "host string, allowed double, blocked double")).collect()}
    for k in (0, 1):
        flow = [(y, x, w) if k else (x, y, w) for x, y, w in edges]
        out, total = defaultdict(float), sum(s[1 + k] for s in seeds)
        for x, _, w in flow:
            out[x] += w
        seed = {s[0]: s[1 + k] / total for s in seeds}
        rank = dict(seed)
        for _ in range(U.ROUNDS):
            new = {h: 0.15 * v for h, v in seed.items()}
            for x, y, w in flow:
                new[y] = new.get(y, 0) + 0.85 * rank.get(x, 0) * w / out[x]
            rank = new
        for h in found:
            assert abs(found[h][k] - rank.get(h, 0)) < 1e-12


def test_links_pass_distrust_back(spark):
    pages = [(1, "http://bad.net/es/1", ""), (2, "http://friend.org/1", '<a href="http://bad.net/es/1">x</a>'), (3, "http://clean.org/1", "<a href='//other.org/'>x</a>")]
    found = {r.host: r.verdict for r in U.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), RULES).collect()}
    assert found == {"bad.net": "block", "friend.org": "block", "clean.org": "allow"}


def test_few_blocked_pages_block_no_host(spark):
    pages = [(i, f"http://{h}.net/{'es/' if i < n else ''}{i}", "") for h, n in (("few", 1), ("many", 60)) for i in range(200)]
    pages += [(500, "http://even.com/1", "<a href='http://bad.net/es/'>"), (501, "http://bad.net/es/", "")]
    found = U.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), RULES).groupBy("host", "verdict").count().collect()
    assert {(r.host, r.verdict): r["count"] for r in found} == {("few.net", "block"): 1, ("few.net", "allow"): 199, ("many.net", "block"): 200, ("even.com", "allow"): 1, ("bad.net", "block"): 1}
