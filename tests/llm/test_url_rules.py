from litvec.llm.queries import URL_RULES
from litvec.llm.url_rules import judge_urls

RULES = "host string, path string, verdict string"


def verdicts(spark, urls, rules=URL_RULES):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    found = judge_urls(pages, spark.createDataFrame(list(rules), RULES)).orderBy("page_id").collect()
    return [(r.host, r.path, r.rule, r.verdict) for r in found]


def by_hand(url, rules=URL_RULES):
    _, mark, rest = (url or "").partition("://")
    host = path = ""
    if mark:
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host, tail = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
    fits = [
        (len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def test_hosts_paths_and_longest_rules(spark):
    urls = [
        None,
        "",
        "no scheme/org/",
        "http://",
        "HTTP://Example.ORG/en/12?q=/es/",
        "https://www.example.org/en/2",
        "https://example.org",
        "https://example.org?x=://a.com/de/",
        "https://badexample.org/es/",
        "http://a.b.com/de/x#y",
        "http://a.b.com/fr/",
        "http://com/de/",
        "http://xcom/de/",
        "http://a..org/",
        "http://a.org./",
        "http://ÄÖ.Example.org/es/é",
        "http://example.org:80/es/",
        "x://y://example.org/es/",
        "http://example.org/en/1",
        "http://a.com/dé/\n/de/",
        "http://" + "a." * 5000 + "com/de/" + "x" * 100_000,
    ]
    assert verdicts(spark, urls) == [by_hand(u) for u in urls]


def test_equal_rules_block_and_other_rules_do_not_matter(spark):
    rules = [("a.com", "/", "allow"), ("A.com", "/", "block"), (None, "/", "block"), ("", "/", "block"), ("b.com", None, "block")]
    assert [v[2:] for v in verdicts(spark, ["http://a.com/x", "http://b.com", "http://c.com/"], rules)] == [
        ("a.com/", "block"),
        ("b.com", "block"),
        (None, "allow"),
    ]


def test_no_rules_no_rows_repeated_rows_and_clashing_names(spark):
    rules = spark.createDataFrame(list(URL_RULES), RULES)
    rows = [(1, "http://x.org/", "kept", "old"), (1, "http://x.org/", "kept", "old"), (None, None, None, None)]
    names = "page_id long, url string, best string, verdict string"
    pages = spark.createDataFrame(rows, names).withColumnsRenamed({}).selectExpr("*", "best as m_host", "best as own", "best as Host")
    found = judge_urls(pages, rules)
    assert found.columns == ["page_id", "url", "best", "m_host", "own", "host", "path", "rule", "verdict"]
    assert sorted(r.verdict for r in found.collect()) == ["allow"] * 3
    assert [r.rule for r in found.where("page_id = 1").collect()] == ["org/"] * 2
    assert judge_urls(pages.limit(0), rules).count() == 0
    none = judge_urls(pages, rules.limit(0), default="block")
    assert [r.verdict for r in none.collect()] == ["block"] * 3


def test_a_url_that_many_rows_share(spark):
    pages = spark.range(5000).selectExpr("id as page_id", "if(id % 3 = 0, 'http://a.com/de/', concat('http://h', id, '.org/')) as url")
    found = judge_urls(pages, spark.createDataFrame(list(URL_RULES), RULES)).groupBy("rule").count().collect()
    assert {r.rule: r["count"] for r in found} == {"com/de/": 1667, "org/": 3333}
