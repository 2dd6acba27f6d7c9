"""Hosts, rules and link trust against plain Python."""

import random
from collections import defaultdict

import pytest

import __spark_entry__ as entry
from mercato.llm import urls as op
from mercato.llm.queries import URL_RULES

SCHEMA = "page_id long, url string, html string, host int, Verdict string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [rest.find(c) for c in "/?#" if c in rest]
    host = rest[: min(ends)] if ends else rest
    path = rest[len(host):]
    ends = [path.find(c) for c in "?#" if c in path]
    return "".join(c.lower() if c.isascii() else c for c in host), path[: min(ends)] if ends else path


def rule_for(host, path, rules):
    best = None
    for verdict, rule in rules:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return best


def rank(pages, rules, damping=op.DAMPING):
    n, seeds, links = defaultdict(int), {"trust": defaultdict(int), "distrust": defaultdict(int)}, defaultdict(int)
    for url, targets in pages:
        host, path = parts(url)
        if not host:
            continue
        n[host] += 1
        found = rule_for(host, path, rules)
        if found:
            seeds["trust" if found[0] == "allow" else "distrust"][host] += 1
        for t in set(t.lower() for t in targets) - {host}:
            links[host, t] += 1
    scores = {}
    for kind in seeds:
        ways = links if kind == "trust" else {(b, a): c for (a, b), c in links.items()}
        total = defaultdict(int)
        for (a, _), c in ways.items():
            total[a] += c
        seed = {h: c / n[h] for h, c in seeds[kind].items()}
        score = {h: (1 - damping) * s for h, s in seed.items()}
        for _ in range(200):
            new = defaultdict(float, {h: (1 - damping) * s for h, s in seed.items()})
            for (a, b), c in ways.items():
                new[b] += damping * score.get(a, 0.0) * c / total[a]
            score = new
        scores[kind] = score
    return scores


def corpus():
    rng = random.Random(6)
    hosts = ["a.org", "B.org", "x.example.org", "c.net", "d.net", "e.net", "f.com", "g.com", "spam.net"]
    pages = []
    for i in range(260):
        host = rng.choice(hosts + ["c.net"] * 9)
        path = rng.choice(["/en/1", "/en/2", "/fr/x", "/de/y", "/es/z", "", "/", "/de"])
        targets = rng.sample(["c.net", "D.net", "a.org", "f.com", "spam.net", "only.linked.net"], rng.randint(0, 3))
        pages.append((i, f"{rng.choice(['http', 'HTTPS'])}://{host}{path}{rng.choice(['', '?q=/x', '#t'])}", targets))
    return pages


def test_links_and_verdicts(spark):
    pages = corpus()
    html = lambda ts: "<p>" + "".join(f'<a class=x href="{q}//{t}/p?q=1">t</a>' for q, t in zip(["http:", "", "https:"], ts)) + '<a href="/own">o</a>'
    rows = [(i, u, html(t), 1, "") for i, u, t in pages]
    found = {r["page_id"]: r for r in op.judge_urls(spark.createDataFrame(rows, SCHEMA).repartition(3), URL_RULES).collect()}
    scores = rank([(u, t) for _, u, t in pages], URL_RULES)
    blocked = {h for h in scores["distrust"] if scores["distrust"][h] > scores["trust"].get(h, 0.0)}
    assert blocked and {"c.net"} - blocked | {"x"}
    for i, u, _ in pages:
        host, path = parts(u)
        rule = rule_for(host, path, URL_RULES)
        r = found[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[1])
        assert r["verdict"] == (rule[0] if rule else "block" if host in blocked else "allow")


def test_scores(spark):
    links = spark.createDataFrame([("a", "b", 2), ("b", "c", 1), ("a", "c", 1), ("c", "a", 3)], "src string, dst string, n long")
    seeds = spark.createDataFrame([("trust", "a", 1.0), ("distrust", "c", 0.5)], "kind string, host string, seed double")
    found = {(r["kind"], r["host"]): r["score"] for r in op.spread(seeds, links, steps=80, enough=1e-7).collect()}
    score = {"a": 0.15, "b": 0.0, "c": 0.0}
    for _ in range(300):
        score = {"a": 0.15 + 0.85 * score["c"], "b": 0.85 * score["a"] * 2 / 3, "c": 0.85 * (score["b"] + score["a"] / 3)}
    for h, s in score.items():
        assert found["trust", h] == pytest.approx(s, abs=1e-5)
    assert found["distrust", "b"] > 0


def test_linked_hosts_without_pages_are_seeds(spark):
    links = {"x.net": ["http://Bad.com/de/1?q", "//bad.com/de/2#a"], "y.net": ["https://bad.com/none"], "z.net": ["http://good.com/fr/1"], "w.net": ["http://x.net/"]}
    html = lambda ts: "".join(f"<a href='{t}'>t</a>" for t in ts)
    rows = [(i, f"http://{h}/{i}", html(ts), 0, "") for i, (h, ts) in enumerate(links.items())] + [(9, "http://far.net/", "", 0, "")]
    found = {r["host"]: r["verdict"] for r in op.judge_urls(spark.createDataFrame(rows, SCHEMA), URL_RULES).collect()}
    assert found == {"x.net": "block", "y.net": "block", "z.net": "allow", "w.net": "block", "far.net": "allow"}


def test_distrust_reaches_far(spark):
    n = 60
    links = spark.createDataFrame([(f"h{i}", f"h{i + 1}", 1) for i in range(n)], "src string, dst string, n long")
    found = {r["host"]: r["score"] for r in op.spread(spark.createDataFrame([("distrust", f"h{n}", 1.0)], "kind string, host string, seed double"), links).collect()}
    assert found["h0"] == pytest.approx(0.15 * 0.85**n, rel=1e-6) and found["h0"] > 0


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://H?x/y", "ftp://Ä.Org/en", "a://b://c/d", "http://org/", "http://notorg/", "x://example.org/en/12"]
    rows = [(i, u, None, 0, "") for i, u in enumerate(urls)] + [(0, None, "x", 0, None), (None, "http://z.net/a", "", None, None)]
    found = op.judge_urls(spark.createDataFrame(rows, SCHEMA), URL_RULES).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["page_id"]:
            assert (r["host"], r["path"]) == parts(urls[r["page_id"]])
    by_id = {r["page_id"]: r for r in found}
    assert by_id[9]["rule"] == "example.org/en/1" and by_id[8]["rule"] is None and by_id[None]["verdict"] == "allow"


def test_empty_and_query(spark, sf_dir):
    assert op.judge_urls(spark.createDataFrame([], SCHEMA), URL_RULES).count() == 0
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    found = {r["page_id"]: r for r in entry.queries()["op8_link_trust"](spark, sf_dir).collect()}
    assert len(found) == len(pages)
    for p in pages:
        host, path = parts(p["url"])
        rule = rule_for(host, path, URL_RULES)
        r = found[p["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[1]) and (not rule or r["verdict"] == rule[0])
