"""URL filters: rules, links and propagation against SQL and a plain walk."""

import random

import duckdb
import pytest

from sparklog.llm import url_filter

SCHEMA = "page_id long, url string, html string, host string, verdict string"


def anchor(rng, host):
    form = rng.choice(['<a href="{}/x">', "<A class='k' HREF = '{}?q'>", "<a\nrel=nofollow href={}#y>", '<a href=" {}">'])
    return form.format(rng.choice(["http://", "https://", "//", "HTTPS://"]) + rng.choice([host, host.upper()])) + "t</a>"


def pages(n_hosts=40, n_pages=300, seed=3):
    rng = random.Random(seed)
    hosts = [f"h{i}.example.{rng.choice(['net', 'net', 'com', 'org'])}" for i in range(n_hosts)]
    rows = []
    for i in range(n_pages):
        host = hosts[0] if rng.random() < 0.3 else rng.choice(hosts)
        links = "".join(anchor(rng, rng.choice(hosts)) for _ in range(rng.randint(0, 4)))
        rows.append((i, f"https://{host}/{rng.choice(['en', 'es', 'fr', 'de'])}/{i}", f'<p data-href="//no.org"><a href="/own">x</a>{links}', "clash", "clash"))
    return rows


EDGES = [
    (1000, None, None, None, None),
    (1001, "no scheme", '<a href="//h1.example.net">', None, None),
    (1002, "http://ORG", "", None, None),
    (1003, "x://Example.ORG/es/ä?q://other.net/", None, None, None),
    (1004, "x://a.example.org/en/1#f", "<a href=", None, None),
    (1004, "x://a.example.org/en/1#f", "<a href=", None, None),
    (None, "x://myexample.org/es/", "", None, None),
    (1005, "://?a", "", None, None),
    (1006, "x://a.com\n/fr/", "", None, None),
    (1007, "http://u.com:80/de/", "<a " * 20_000, None, None),
]


def check(spark, rows):
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar, html varchar)")
    if rows:
        con.executemany("insert into pages values (?, ?, ?)", [r[:3] for r in rows])
    got = url_filter.judge(spark.createDataFrame(rows, SCHEMA))
    key = lambda r: tuple(map(str, r))
    ours = sorted((tuple(r) for r in got.select("page_id", "host", "path", "rule", "verdict").collect()), key=key)
    theirs = con.sql(f"select page_id, host, path, rule, verdict from ({url_filter.ORACLE_SQL})").fetchall()
    assert ours == sorted(theirs, key=key)
    return ours


def test_rules_and_odd_urls(spark):
    got = check(spark, EDGES)
    by_url = {(r[0], r[1]): r[2:] for r in got}
    assert by_url[1000, ""] == ("", None, "allow")
    assert by_url[1002, "org"] == ("", None, "allow")
    assert by_url[1003, "example.org"] == ("/es/ä", "example.org/es/", "block")
    assert by_url[1004, "a.example.org"] == ("/en/1", "example.org/en/1", "block") and len(got) == len(EDGES)
    assert by_url[None, "myexample.org"] == ("/es/", "org/", "allow")
    assert by_url[1007, "u.com:80"][1] is None


def test_propagation_matches_sql(spark):
    got = check(spark, pages() + EDGES)
    unruled = [r[4] for r in got if r[3] is None]
    assert {"allow", "block"} <= set(unruled)
    assert check(spark, []) == []


def test_scores_against_a_plain_walk(spark, monkeypatch):
    """Trust forwards and distrust backwards, with edges of a hub dealt over parts."""
    monkeypatch.setattr(url_filter, "_FAN", 3)
    rng = random.Random(5)
    links = {(u, v): rng.randint(1, 5) for u in "abcdefgh" for v in "abcdefgh" if u != v and (u == "a" or rng.random() < 0.3)}
    seeds = {"a": (3, 1), "b": (0, 2), "h": (5, 0)}
    got = {(r.node, r.kind): r.score for r in url_filter.propagate(spark.createDataFrame([(u, v, n) for (u, v), n in links.items()], "u string, v string, n long"), spark.createDataFrame([(h, *c) for h, c in seeds.items()], "host string, allowed long, blocked long")).collect()}
    for kind in (0, 1):
        edges = links if kind == 0 else {(v, u): n for (u, v), n in links.items()}
        base = {h: url_filter.UNIT * c[kind] / sum(c) * 0.15 for h, c in seeds.items()}
        score = dict(base)
        for _ in range(url_filter.ROUNDS):
            new = dict(base)
            for (u, v), n in edges.items():
                new[v] = new.get(v, 0) + 0.85 * score.get(u, 0) * n / sum(m for (x, _), m in edges.items() if x == u)
            score = new
        for host, value in score.items():
            assert got.get((host, kind), 0) == pytest.approx(value, abs=2000)


def test_one_link_each_way(spark):
    """A host that a blocked one is linked from stays; one that links to it goes."""
    page = lambda i, host, path, *to: (i, f"http://{host}{path}", "".join(f'<a href="http://{t}/">' for t in to), None, None)
    rows = [page(1, "bad.com", "/de/", "victim.net"), page(2, "friend.net", "/", "bad.com"), page(3, "victim.net", "/"), page(4, "good.org", "/", "fine.net", "friend.net"), page(5, "fine.net", "/")]
    got = {r[1]: r[4] for r in check(spark, rows)}
    assert got == {"bad.com": "block", "friend.net": "block", "victim.net": "allow", "good.org": "allow", "fine.net": "allow"}
