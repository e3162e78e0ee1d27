from __future__ import annotations

import random

import pytest

from tabloom.llm import link_graph
from tabloom.llm.link_graph import Rule
from tests.llm.odd import dicts

SCHEMA = "page_id long, url string, html string, host string, mass double, kind string"
RULES = (Rule("good.org/", "allow"), Rule("bad.org/", "block"), Rule("good.org/x/", "block"))


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1.0, None) for r in rows], SCHEMA)


def test_hosts_paths_and_longest_rule(spark, area):
    urls = [
        "HTTP://A.Good.ORG/x/1?q#f", "https://good.org", "https://good.org/y", "ftp://notgood.org/",
        "no scheme", None, "", "://", "http://bad.org?x/", "http://ÄB.org:8080/p/", "a://b://c/d",
    ]
    found = dicts(link_graph.filter_urls(pages(spark, [(i, u, None) for i, u in enumerate(urls)]), RULES, area))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in found}
    assert got[0] == ("a.good.org", "/x/1", "good.org/x/")
    assert got[1] == ("good.org", "", None)
    assert got[2] == ("good.org", "/y", "good.org/")
    assert got[3] == ("notgood.org", "/", None)
    assert got[4] == got[5] == got[6] == got[7] == ("", "", None)
    assert got[8] == ("bad.org", "", None)
    assert got[9] == ("Äb.org:8080", "/p/", None)
    assert got[10] == ("b:", "//c/d", None)
    assert all(r["verdict"] in ("allow", "block") for r in found)
    assert len(found) == len(urls)


def plain(links, hosts, steps=link_graph.STEPS, damping=link_graph.DAMPING):
    """Trust and distrust by dictionaries; hosts: host -> (allowed, blocked, pages)."""
    scores = []
    for kind in (0, 1):
        ways = {}
        for (a, b), n in links.items():
            ways.setdefault((b, a)[1 - kind], []).append(((a, b)[1 - kind], n))
        start = {h: v[kind] / v[2] for h, v in hosts.items()}
        mass = {h: (1 - damping) * s for h, s in start.items()}
        for _ in range(steps):
            new = {h: (1 - damping) * s for h, s in start.items()}
            for at, to in ways.items():
                out = sum(n for _, n in to)
                for host, n in to:
                    new[host] = new.get(host, 0) + damping * mass.get(at, 0) * n / out
            mass = new
        scores.append(mass)
    return scores


def test_trust_follows_links_and_distrust_goes_back(spark, area):
    pick = random.Random(3)
    names = ["good.org", "bad.org", *(f"h{i}.com" for i in range(12))]
    rows, links, hosts = [], {}, {}
    for i in range(150):
        own = names[0] if i % 3 == 0 else pick.choice(names)
        targets = [pick.choice(names) for _ in range(pick.randrange(4))]
        html = " ".join(f"<a class=x href='https://{t.upper()}/p'>" for t in targets)
        html += '<a href="/local"><a HREF="//h1.com/z"><link href="http://h2.com">'
        rows.append((i, f"http://{own}/p{i}", html))
        for t in [*targets, "h1.com"]:
            if t != own:
                links[own, t] = links.get((own, t), 0) + 1
        allowed, blocked, total = hosts.get(own, (0, 0, 0))
        hosts[own] = (allowed + (own == names[0]), blocked + (own == names[1]), total + 1)
    found = dicts(link_graph.filter_urls(pages(spark, rows), RULES, area))
    trust, distrust = plain(links, hosts)
    for r in found:
        assert r["trust"] == pytest.approx(trust.get(r["host"], 0))
        assert r["distrust"] == pytest.approx(distrust.get(r["host"], 0))
        if r["rule"] is None:
            worse = distrust.get(r["host"], 0) > trust.get(r["host"], 0)
            assert r["verdict"] == ("block" if worse else "allow")
    assert {r["verdict"] for r in found if r["rule"] is None} == {"allow", "block"}


def linked(spark, links):
    rows = [(i, f"http://{a}/", f"<a href='http://{b}/'>") for i, (a, b) in enumerate(links)]
    return pages(spark, [*rows, (len(rows), "http://bad.org/", None)])


def test_distrust_reaches_far_hosts_and_those_behind_hubs(spark, area):
    chain = [f"c{i}.com" for i in range(14)] + ["bad.org"]
    hubs = ["p.com", "q.com", "r.com", "bad.org"]
    far = linked(spark, list(zip(chain, chain[1:])))
    # Distrust goes against the links: a hub is a host that a thousand hosts link to.
    back = [(100 + h, f"http://x{h}-{i}.com/", f"<a href='http://{hubs[h + 1]}/'>") for h in range(3) for i in range(999)]
    last = [(200 + h, f"http://{hubs[h]}/", f"<a href='http://{hubs[h + 1]}/'>") for h in range(3)]
    last.append((300, "http://bad.org/", None))
    for docs, hosts in ((far, chain[:-1]), (pages(spark, back + last), hubs[:-1])):
        found = dicts(link_graph.filter_urls(docs, RULES, area, steps=None))
        verdicts = {r["host"]: r["verdict"] for r in found}
        assert {verdicts[h] for h in hosts} == {"block"}


def test_fixed_point_returns_the_mass_of_hosts_without_links(spark, area):
    links = [("good.org", "a.com"), ("a.com", "b.com"), ("good.org", "c.com"), ("c.com", "good.org"), ("a.com", "bad.org")]
    found = dicts(link_graph.filter_urls(linked(spark, links), RULES, area, steps=None))
    hosts = ["good.org", "bad.org", "a.com", "b.com", "c.com"]
    ways = {"trust": links, "distrust": [(b, a) for a, b in links]}
    for kind, seed in (("trust", {"good.org": 1.0}), ("distrust", {"bad.org": 1.0})):
        mass = dict(seed)
        for _ in range(300):
            new = {h: 0.15 * seed.get(h, 0) for h in hosts}
            for at, m in mass.items():
                to = [b for a, b in ways[kind] if a == at]
                for host in to:
                    new[host] += 0.85 * m / len(to)
                if not to:
                    for host, s in seed.items():
                        new[host] += 0.85 * m * s
            mass = new
        for r in found:
            assert r[kind] == pytest.approx(mass.get(r["host"], 0), rel=1e-4)


def test_repeated_rows_null_ids_and_empty_table(spark, area):
    rows = [(1, "http://good.org/a", "<a href=http://b.com>")] * 3 + [(None, "http://b.com/", None)]
    assert len(dicts(link_graph.filter_urls(pages(spark, rows), RULES, area))) == 4
    assert dicts(link_graph.filter_urls(pages(spark, []), RULES, area)) == []
