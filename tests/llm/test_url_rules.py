"""URL rules against trying every rule on every URL."""

import re

import pytest

from visitloom.llm import queries, url_rules
from visitloom.llm.url_rules import RULES, part_rule, site_rule

URLS = [
    "http://a.example.net/en/1?x#y", "https://EXAMPLE.net/en/", "http://example.net/EN/", "http://example.net/de/",
    "http://net", "http://net/", "http://xnet/", "http://a.net?net/", "http://b.example.com/de/9", "http://b.example.com/en/",
    "http://org/fr/", "http://my.ORG/fr/page.html#/login/", "http://x.org/login/", "ftp://example.info/cart/", "://",
    "no scheme/net/", "", None, "http://h/ads/1/2.gif", "http://h/ads/.png", "http://h/?SessionId=3", "http://h/p?a=1&sessionid=",
    "http://example.net://en/", "http:///path", "http://a.example.net/en/1?x#y", "http://h/\n/login/", "http://é.net/é",
]


def slow(url, rules=RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for r in sorted((r for r in rules if r.site), key=lambda r: (len(r.name), r.name)):
        h, _, p = r.name.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            best = r
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), url or "")
    parts = [r for r in rules if not r.site and re.search(r.pattern, lower)]
    chosen = best or max(parts, key=lambda r: (len(r.name), r.name), default=None)
    return host, path, best and best.name, chosen.verdict if chosen else "allow"


def table(spark, urls):
    rows = [(i, u, "old", "old") for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, verdict string, own_url string")


@pytest.mark.parametrize("rules", [RULES, (part_rule("block", "e"), part_rule("allow", "/en/"), site_rule("block", "org/f"))])
def test_verdicts_equal_brute_force(spark, rules):
    judged = url_rules.judge(table(spark, URLS), rules)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judged.collect()}
    assert got == {i: slow(u, rules) for i, u in enumerate(URLS)}
    assert judged.select("own_url").distinct().collect()[0][0] == "old"


def test_tokens_stand_whole_in_every_match():
    for rule in RULES:
        assert rule.tokens, rule
    assert part_rule("block", "/ads/*.gif").tokens == ("ads",)
    assert part_rule("block", "login").tokens == ()
    assert site_rule("block", "example.net/en").tokens == ("example", "net")


def test_no_pages(spark):
    assert url_rules.judge(table(spark, [])).collect() == []


def test_sql_of_the_query_agrees(spark, tmp_path):
    import duckdb

    (path := tmp_path / "sf").mkdir()
    urls = [u for u in URLS if u is None or u.isascii()]
    table(spark, urls).select("page_id", "url").coalesce(1).write.parquet(str(path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet/*.parquet'")
    wanted = con.execute(queries.oracle_sql()["op2_url_filter"]).fetchall()
    got = [tuple(r) for r in queries.queries()["op2_url_filter"](spark, str(path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, wanted))
