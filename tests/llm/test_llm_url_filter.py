import random

from callweave.llm import queries
from callweave.llm.url_filter import judge_urls, judge_urls_by_join


def slow(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    best = None
    for verdict, rule in rules:
        r_host, _, r_path = rule.partition("/")
        if (host == r_host or host.endswith("." + r_host)) and path.startswith("/" + r_path) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best and best[0], best[1] if best else "allow"


URLS = [None, "", "nothing", "http://", "://com/en/", "HTTP://WWW.Example.COM/en/7#x", "http://com/en/", "http://xcom/en/", "http://example.com/en", "http://example.net/de/8?q=://org/es/", "http://É.org/es/a", "a://b://org/es/", "http://org?/es/", "http://org/es/\nx", "http://a..com/en/x"]


def test_equals_brute_force(spark):
    rng = random.Random(3)
    urls = URLS + [f"http://{rng.choice(['', 'a.', 'b.a.', 'example.'])}{rng.choice(['com', 'net', 'org', 'example.net'])}/{rng.choice(['en', 'de', 'es'])}/{rng.choice(['', '7', '78', '8', '8/x'])}" for _ in range(200)]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id bigint, url string, host string, rule string")
    want = [(i, *slow(u, queries.URL_RULES)) for i, u in enumerate(urls)]
    assert sorted(tuple(r) for r in judge_urls(df, queries.URL_RULES).collect()) == want
    table = spark.createDataFrame(queries.URL_RULES, "verdict string, rule string")
    assert sorted(tuple(r) for r in judge_urls_by_join(df, table).collect()) == want


def test_block_wins_among_equal_rules_and_repeats_stay(spark):
    df = spark.createDataFrame([(1, "http://a.com/x"), (1, "http://a.com/x")], "page_id bigint, url string")
    for rules in ([("allow", "a.com/x"), ("block", "a.com/x")], [("block", "a.com/x"), ("allow", "a.com/x")]):
        assert [r["verdict"] for r in judge_urls(df, rules).collect()] == ["block"] * 2
        assert [r["verdict"] for r in judge_urls_by_join(df, spark.createDataFrame(rules, "verdict string, rule string")).collect()] == ["block"] * 2
    assert judge_urls(df.limit(0), queries.URL_RULES).count() == 0
