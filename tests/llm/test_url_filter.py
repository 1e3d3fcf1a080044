import re

import pytest

from voltrail.llm import url_filter as U
from voltrail.llm.queries import URL_RULES

URLS = ["https://a.example.org/es/1", "http://EXAMPLE.org/en/123", "http://x.org", "http://x.org/", "https://b.com/fr/1?x=/de/", "ftp://b.com/de/z#f",
        "http://notcom/de/", None, "", "no scheme", "http://", "http://host?q", "http://h.net/a://b", "http://example.org/en/2", "http://com/de/x",
        "HTTP://Ä.COM/de/\n", "a://b.com/fr/de/://c.org/"]


def expected(url):
    url = url or ""
    at = url.find("://")
    host, path = "", ""
    if at >= 0:
        host = re.match(r"[^/?#]*", url[at + 3:])[0]
        path = re.match(r"[^?#]*", url[at + 3 + len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for site, start, verdict in URL_RULES:
        if (host == site or host.endswith("." + site)) and path.startswith(start) and (best is None or len(site + start) > len(best[0])):
            best = (site + start, verdict)
    return host, path, *(best or (None, None))


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, label string")


def test_rules(spark):
    got = {r.page_id: r for r in U.judge(pages(spark, URLS), URL_RULES).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path, rule, verdict = expected(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")


def test_reputation_shrinks_to_domain_and_suffix(spark):
    rows = [("a.bad.net", 1)] * 60 + [("b.bad.net", 1)] * 40 + [("c.bad.net", None)] * 3 + [("d.bad.net", 0)] \
        + [("x.good.net", 0)] * 80 + [("y.good.net", 1)] + [("q.com", 0)] * 100 + [("new.com", None)]
    got = {r.host: r for r in U.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["a.bad.net"].low > 0.9 and got["x.good.net"].high < 0.1
    assert got["c.bad.net"].rate > 0.8 and got["c.bad.net"].rate > got["d.bad.net"].rate  # no label: its domain; one good page pulls down
    assert got["y.good.net"].rate < 0.6 and got["new.com"].rate < 0.1
    assert got["c.bad.net"].high - got["c.bad.net"].low > got["a.bad.net"].high - got["a.bad.net"].low


def test_verdict_by_host(spark):
    urls = [f"http://s{i % 2}.bad.net/block/{i}" for i in range(60)] + ["http://s0.bad.net/x", "http://other.org/"]
    got = U.judge(pages(spark, urls), [("net", "/block/", "block"), ("org", "/", "allow")]).toPandas()
    assert got[got["path"] == "/x"]["verdict"].tolist() == ["block"]


@pytest.mark.parametrize("host,domain", [("a.b.example.com", "example.com"), ("example.com", "example.com"), ("com", "com"), ("a.b.co.uk", "b.co.uk"),
                                         ("co.uk", "co.uk"), ("", "")])
def test_registered_domain(spark, host, domain):
    df = spark.createDataFrame([(host,)], "host string")
    assert df.select(U.domain_of(U.F.col("host"), U.suffix_of(U.F.col("host")))).first()[0] == domain


def test_no_rows_and_no_python(spark):
    assert U.judge(pages(spark, []).limit(0), URL_RULES).isEmpty()
    plan = U.judge(pages(spark, URLS), URL_RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
