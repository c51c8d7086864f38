"""The walk of link trust against a dense solution, on a chain longer than any fixed number of rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import link_trust
from barloom.llm.queries import RULES


def solved(n, edges, seeds):
    step = np.zeros((n, n))
    for (a, b), w in edges.items():
        step[a, b] = w / sum(x for (s, _), x in edges.items() if s == a)
    rank = np.linalg.solve((np.eye(n) - 0.85 * step).T, 0.15 * seeds)
    return rank / rank.sum()


def test_trust_is_walked_to_convergence(spark):
    # every c links to the next, the last to a blocked host; beside them a slow two-way path with seeds at both ends
    names = [f"c{i}.com" for i in range(100)] + ["end.net", "good.org", *(f"p{i}.com" for i in range(6)), "bad.net"]
    at = {n: i for i, n in enumerate(names)}
    edges = {(i, i + 1): 1.0 for i in range(100)}
    path = [at["good.org"], *(at[f"p{i}.com"] for i in range(6)), at["bad.net"]]
    for a, b in zip(path, path[1:], strict=False):
        edges[a, b] = edges[b, a] = 1.0
    frame = spark.createDataFrame([(names[a], names[b], w) for (a, b), w in edges.items()], "src string, dst string, weight double")
    got = {r["host"]: r for r in link_trust.host_trust(frame, frame.select(F.col("src").alias("host")), RULES).collect()}
    good = np.array([float(n.endswith("org")) for n in names])
    bad = np.array([float(n.endswith("net")) for n in names]) / 2
    trust = solved(len(names), edges, good)
    distrust = solved(len(names), {(b, a): w for (a, b), w in edges.items()}, bad)
    for i, n in enumerate(names):
        assert np.isclose(got[n]["trust"], trust[i], rtol=1e-4, atol=1e-15) and np.isclose(got[n]["distrust"], distrust[i], rtol=1e-4, atol=1e-15)
    assert got["c0.com"]["distrust"] > got["c0.com"]["trust"] == 0.0
    with pytest.raises(ValueError):
        link_trust.host_trust(frame, frame.select(F.col("src").alias("host")), RULES, tolerance=0.0)


def test_a_host_with_a_port_gets_the_links_to_it(spark):
    pages = [(1, "http://a.com/", '<a href="http://b.com:8080/x">'), (2, "http://b.com:8080/x", None), (3, "http://u@b.com/", "x" * 300_000),
             (4, "http://c.org/fr/", '<a href="//b.com/y">' * 5), (5, None, None), (6, "http://z.net/", '<a href="http://a.com">')]
    frame = spark.createDataFrame([(*p, 0.5) for p in pages], "page_id long, url string, html string, bystander double")
    got = {r["page_id"]: r for r in link_trust.judged(frame, RULES).collect()}
    assert got[2]["host"] == "b.com:8080" and got[3]["host"] == "u@b.com"
    assert got[2]["trust"] == got[3]["trust"] > 0
    assert (got[5]["host"], got[5]["verdict"], got[5]["trust"]) == ("", "allow", 0.0)
    with pytest.raises(ValueError):
        link_trust.judged(frame.withColumnRenamed("page_id", "host"), RULES, key="host")
