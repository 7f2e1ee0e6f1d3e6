"""The URL filter against plain Python over all rules."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from inkweave.llm import common
from inkweave.llm.urls import RULES, filter_urls, op7_url_filter

PAGES = "page_id bigint, url string, html string, host string, path string, rule string, verdict int"


def brute(url, rules, default="allow"):
    """host, path, rule, verdict by trying each rule."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fits = [(h, p, v) for h, p, v in rules if host and None not in (h, p) and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, default
    h, p, v = min(fits, key=lambda r: (-len(r[0] + r[1]), r[2] != "block", r[0] + r[1]))
    return host, path, h + p, v


URLS = [
    None, "", "no scheme", "http://", "://", "http:///de/x", "https://example.com", "https://example.com/", "https://EXAMPLE.com/de/", "https://example.com/de", "https://www.Example.com/de/a?b=/fr/#c", "https://myexample.com/de/x", "http://a.net", "http://a.net/", "http://a.net?x", "http://a.net/x",
    "http://example.net/en/", "http://x.example.net/en/y", "http://example.net/EN/y", "http://example.net/fr/", "http://w.org/fr/x", "http://org/fr/", "http://org./fr/", "http://.org/fr/", "http://w.org/fr?", "http://w..org/fr/a/b//c/", "ftp://u:p@example.com:80/de/x", "http://exämple.net/ü/?q", "a://b://c.net/x", "http://net/x\ny", "http://a.net/" + "d/" * 3000,
]


def test_query(spark, write):
    rows = [(i, u, None, "h", "p", "r", 7) for i, u in enumerate(URLS * 2)] + [(None, URLS[6], None, None, None, None, None)]
    got = sorted((r.page_id if r.page_id is not None else -1, r.host, r.path, r.rule, r.verdict) for r in op7_url_filter(spark, write("pages", rows, PAGES)).collect())
    assert got == sorted((-1 if r[0] is None else r[0], *brute(r[1], RULES)) for r in rows)


def test_empty(spark, write):
    assert op7_url_filter(spark, write("pages", [], PAGES)).count() == 0


PART = st.sampled_from(["a", "b", "net", "ä", "", "example"])
HOST = st.lists(PART, min_size=1, max_size=4).map(".".join)
PATH = st.lists(PART, max_size=4).map(lambda x: "".join("/" + p for p in x))
RULE = st.tuples(st.one_of(HOST, st.none()), st.one_of(PATH, PATH.map(lambda p: p + "/"), st.none()), st.sampled_from(["block", "allow"]))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(RULE, max_size=12), st.lists(st.tuples(HOST, PATH), min_size=60, max_size=120))
def test_any_rules(spark, rules, urls):
    rules = rules + rules[:2]
    frame = spark.createDataFrame([(i, f"x://{h}{p}") for i, (h, p) in enumerate(urls)], "page_id bigint, url string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(frame, table, default="block").collect()}
    assert got == {i: brute(f"x://{h}{p}", rules, "block") for i, (h, p) in enumerate(urls)}


def test_a_cluster_has_to_name_its_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
