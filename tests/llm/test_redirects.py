"""URL verdicts against a plain search along the links."""

import re

from opsight.llm import queries as Q
from opsight.llm.common import table
from opsight.llm.redirects import link_target, url_verdicts

from .conftest import closure

SF = "/root/testdata/sf0.01"
RULES = Q.URL_RULES


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = re.split("[?#]", url[url.index("://") + 3:], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path


def plain_rule(host, path):
    fits = [(len(r), r, v) for v, r in RULES for h, p in [(r[:r.index("/")], r[r.index("/"):])]
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def verdicts(spark, rows, **kw):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["id"]: r for r in url_verdicts(df, RULES, **kw).collect()}


def page(rel=None, refresh=None):
    head = f'<link href="{rel}" rel="canonical">' if rel else ""
    head += f"<META http-equiv='Refresh' content='0; URL={refresh}'>" if refresh else ""
    return f"<html><head>{head}</head></html>"


def test_blocks_reach_aliases_and_allow_comes_first(spark):
    got = verdicts(spark, [
        (1, "http://a.example.net/x", page(rel="https://m.example.com/de/1")),            # to a blocked address without a page
        (2, "http://b.example.net/y?q=1", page(refresh="//a.example.net/x")),             # two steps away
        (3, "https://news.com/fr/z", page(rel="http://b.example.net/y?q=1&")),            # another address: unlinked to 2
        (4, "https://news.com/fr/2", page(rel="http://b.example.net/y?q=1")),             # an alias, but allowed by its own rule
        (5, "http://c.example.net/dir/p", page(refresh="../q#top")),                      # relative, nothing blocked
        (6, "http://c.example.net/q", ""),
        (7, "http://d.example.net/", "<!-- " + page(rel="http://x.com/de/") + " -->"),
        (8, "http://e.example.net/", "<script>var s = '" + page(rel="http://x.com/de/") + "'</script>"),
        (9, None, page(rel="http://x.com/de/9")), (10, "no-address", None), (11, "http://a.example.net/x", None),
        (12, "http://B.Example.NET/y?q=1#part", None), (13, "http://d.example.net", page(rel="http://[bad")),
        (14, "http://f.example.net/?a=1&b=2", ""), (15, "http://g.example.net/", page(refresh="http://f.example.net/?a=1&amp;b=2")),
        (16, "http://f.example.net/?a=1&b=2", page(rel="http://example.org/es/now")),
    ])
    assert {k for k, r in got.items() if r["verdict"] == "block"} == {1, 2, 9, 11, 12, 14, 15, 16}
    assert got[4]["rule"] == "com/fr/" and got[4]["verdict"] == "allow" and got[9]["host"] == ""


def test_long_chains_and_a_hot_target(spark):
    n = 300
    chain = [(i, f"http://h.net/{i}", page(rel=f"/{i + 1}")) for i in range(n)] + [(n, f"http://h.net/{n}", page(rel="http://z.com/de/"))]
    star = [(1000 + i, f"http://s.net/{i}", page(refresh="http://hub.net/")) for i in range(500)]
    got = verdicts(spark, chain + star, redirects=spark.createDataFrame([("http://s.net/77", "http://www.example.org/es/")], "src string, dst string"))
    assert all(r["verdict"] == "block" for r in got.values()) and len(got) == n + 1 + 500


def test_random_links_against_closure(spark):
    import random

    r = random.Random(5)
    urls = [f"http://{h}/{p}" for h in ("a.net", "b.com", "c.example.org") for p in ("de/", "fr/x", "es/y", "en/1", "en/2", "", "z")]
    urls += [f"http://h{i}.net/{i}" for i in range(60)]
    rows = [(i, u, page(rel=r.choice(urls)) if r.random() < 0.35 else "") for i, u in enumerate(urls)]
    at = {u: i for i, u in enumerate(urls)}
    links = [(i, at[m[1]]) for i, u, h in rows for m in re.finditer('href="([^"]*)"', h)]
    root = closure(len(urls), links)
    own = [plain_rule(*plain_parts(u)) for u in urls]
    bad = {root[i] for i in range(len(urls)) if own[i][1] == "block"}
    got = verdicts(spark, rows)
    for i, u in enumerate(urls):
        assert got[i]["verdict"] == (own[i][1] or ("block" if root[i] in bad else "allow")), u


def test_query_on_pages(spark):
    got = Q.QUERIES["op12_redirect_url_filter"](spark, SF)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    want = []
    for r in table(spark, SF, "pages").select("page_id", "url").collect():
        host, path = plain_parts(r["url"])
        rule, verdict = plain_rule(host, path)
        want.append((r["page_id"], host, path, rule, verdict or "allow"))  # these pages have no links
    assert sorted(map(tuple, got.collect())) == sorted(want) and len({w[3] for w in want}) == 6


def test_parts_and_rules_at_their_edges(spark):
    urls = ["http://ORG", "x://a.org/b?c/d#e", "http://a.org?x=/y", "borg/", "http://borg/", "http://example.org/en/12", "http://example.org/EN/1", "://h/p",
            "a://b://c/d", "http://É.org/é\nx#", "http://my.example.org:80/es/", "", "http:///p"]
    got = verdicts(spark, [(i, u, None) for i, u in enumerate(urls)])
    for i, u in enumerate(urls):
        host, path = plain_parts(u)
        rule, verdict = plain_rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict or "allow"), u


def test_tags():
    assert link_target('<link rel="alternate canonical" href=/x>') == "/x"
    assert link_target("<link rel='stylesheet' href='/x'>") is None
    assert link_target('<meta content="5;url=\'/y\'" http-equiv=refresh>') == "/y"
    assert link_target('<meta http-equiv="refresh" content="30">') is None


def test_empty_table(spark):
    assert verdicts(spark, []) == {}
