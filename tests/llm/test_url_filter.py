import pytest

from gristmill.llm.url_filter import RULES, UNITS, url_verdicts


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    tail = rest[k:]
    j = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k]), tail[:j]


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def rank(edges, seeds, steps=12):
    out = {}
    for (a, _), n in edges.items():
        out[a] = out.get(a, 0) + n
    mass = dict(seeds)
    for _ in range(steps):
        new = {h: s * 15 // 100 for h, s in seeds.items()}
        for (a, b), n in edges.items():
            if a in mass:
                new[b] = new.get(b, 0) + int(mass[a] * 1.0 * 85 * n // (100 * out[a]))
        mass = new
    return mass


def brute(pages):
    edges, seeds = {}, {"allow": {}, "block": {}}
    for _, url, links in pages:
        host, path = split(url)
        for b in links or []:
            if host and b != host:
                edges[host, b] = edges.get((host, b), 0) + 1
        v = rule(host, path)[1]
        if v and host:
            seeds[v][host] = seeds[v].get(host, 0) + 1
    ups = set()
    for host in {split(u)[0] for _, u, _ in pages}:
        parts = host.split(".")
        for k in range(len(parts) - 2):
            ups.add((".".join(parts[k:]), ".".join(parts[k + 1 :])))
    for a, b in ups:
        edges[a, b] = edges.get((a, b), 0) + 1
        edges[b, a] = edges.get((b, a), 0) + 1
    seeds = {v: {h: int(UNITS * n / sum(s.values())) for h, n in s.items()} for v, s in seeds.items()}
    trust = rank(edges, seeds["allow"])
    distrust = rank({(b, a): n for (a, b), n in edges.items()}, seeds["block"])
    out = []
    for i, url, _ in pages:
        host, path = split(url)
        name, v = rule(host, path)
        out.append((str(i), host, path, name, v or ("block" if distrust.get(host, 0) > trust.get(host, 0) else "allow")))
    return sorted(map(str, out))


PAGES = [
    (1, "http://a.example.com/en/1", ["b.example.net", "evil.test"]),
    (2, "https://A.Example.com/en/77?x#y", ["friend.test"]),
    (3, "http://b.example.net/de/8x", []),
    (4, "http://b.example.net/de/1", ["friend.test"]),
    (5, "http://friend.test/p", ["a.example.com", "b.example.net"]),
    (6, "http://evil.test?q=/en/", ["c.example.org"]),
    (7, "http://c.example.org/es/", []),
    (8, "http://c.example.org#frag", ["evil.test", "evil.test"]),
    (9, None, ["friend.test"]),
    (10, "no scheme/en/", []),
    (10, "://com/en/", []),
    (None, "x://y://z/en/?", None),
    (11, "http://hub.test/", ["c.example.org"]),
    (12, "http://com.evil/en/", []),
    (13, "http://notexample.com/de/", []),
]


def html(links):
    return None if links is None else "<a href='/x'>" + "".join(f'<a class=q HREF = "https://{b.upper()}/k?z">t</a>' for b in links)


def test_matches_brute_force(spark):
    df = spark.createDataFrame([(i, u, html(x), "clash") for i, u, x in PAGES], "page_id long, url string, html string, host string").repartition(3)
    got = url_verdicts(df).collect()
    assert sorted(str((str(r.page_id), r.host, r.path, r.rule, r.verdict)) for r in got) == brute(PAGES)
    assert {r.host: r.verdict for r in got}["hub.test"] == "block"
    assert {r.host: r.verdict for r in got}["friend.test"] == "allow"


def test_edges(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_verdicts(empty).count() == 0
    df = spark.createDataFrame([(1, "http://x.test/", "<p>")], "page_id long, url string, html string")
    assert url_verdicts(df, rules=()).first().verdict == "allow"
    with pytest.raises(ValueError):
        url_verdicts(df, rules=[("allow", f"h{i}", "/") for i in range(1001)])
