"""URL filter: contract rules, and propagation against numpy."""
import re

import numpy as np

from transitio.llm import link_trust as L

PAGES = [
    (1, "http://A.Example.COM/en/x?q", ""), (2, "https://www.example.com/en/", ""), (3, "ftp://x.net/es/a#b", None),
    (4, "http://x.net/en/a", '<a href="http://good.com/p">g</a><a HREF=\'//bad.net/es/\'>b</a><a href=https://worse.org/>'), (5, None, "x"), (6, "no scheme", ""),
    (7, "http://com/", ""), (8, "http://notcom/", ""), (9, "http://example.com/en", ""), (10, "http://example.com", ""),
    (11, "http://bad.net/es/1", "<a href='/local'>"), (12, "http://bad.net/es/2", ""), (12, "http://bad.net/es/2", ""),
    (13, "http://farm.org/a", '<a href="http://bad.net/es/1">' * 20), (14, "http://worse.org/", ""),
    (15, "http://bad.net/en/ok", ""), (16, "x://h?a://b", ""), (17, "://host/p", ""), (18, "http://ünï.COM/Ä?z", ""), (None, "http://q.org/", ""),
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in L.filter_urls(df).collect()}
    want = {1: ("a.example.com", "/en/x", "example.com/en/", "block"), 2: ("www.example.com", "/en/", "www.example.com/en/", "allow"),
            3: ("x.net", "/es/a", "net/es/", "block"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("com", "/", "com/", "allow"),
            8: ("notcom", "/", None, "allow"), 9: ("example.com", "/en", "com/", "allow"), 10: ("example.com", "", None, "allow"),
            16: ("h", "", None, "allow"), 17: ("host", "/p", None, "allow"), 18: ("ünï.com", "/Ä", "com/", "allow"), 15: ("bad.net", "/en/ok", None, "block")}
    for k, v in want.items():
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == v, k
    assert got[13].verdict == "block" and got[13].distrust > 0.5  # it only links to blocked pages
    assert got[14].verdict == "allow"  # being linked from x.net, where all pages are blocked, costs nothing
    assert L.filter_urls(df).count() == len(PAGES)


def test_propagation_matches_numpy(spark):
    rng = np.random.default_rng(0)
    n = 12
    w = rng.integers(0, 3, (n, n)) * (rng.random((n, n)) < 0.4) + np.eye(n, dtype=int)
    edges = spark.createDataFrame([("t", f"h{i}", f"h{j}", float(w[i, j] / w[i].sum())) for i in range(n) for j in range(n) if w[i, j]],
                                  "kind string, src string, dst string, w double")
    seed = rng.random(n)
    seeds = spark.createDataFrame([("t", f"h{i}", float(seed[i])) for i in range(n)], "kind string, host string, seed double")
    x = seed.copy()
    for _ in range(7):
        x = 0.15 * seed + 0.85 * (w / w.sum(axis=1, keepdims=True)).T @ x
    got = {r.host: r.x for r in L.propagate(edges, seeds, 0.85, 7).collect()}
    assert np.allclose([got[f"h{i}"] for i in range(n)], x)


def test_plan_is_native_and_empty_tables_work(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    plan = L.filter_urls(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
    assert L.filter_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
