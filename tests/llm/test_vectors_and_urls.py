"""Embedding near-duplicates and URL verdicts against plain versions; queries against DuckDB."""

import os

import duckdb
import numpy as np
import pytest
from conftest import components
from pyspark.sql import functions as F

from pixelloom.llm import embeddings, queries, urlfilter

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.98):
    v = [np.array(x, float) for _, x, _ in rows]
    good = [label is not None and x is not None and None not in x and np.isfinite(a.astype(float)).all() and a.any() for (_, x, label), a in zip(rows, v, strict=True)]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if good[i] and good[j] and rows[i][2] == rows[j][2] and len(v[i]) == len(v[j]) and v[i] @ v[j] / np.linalg.norm(v[i]) / np.linalg.norm(v[j]) >= threshold]
    parts = components(len(rows), links)
    return {rows[i][0]: (sum(i in x for x in links), rows[parts[i]][0]) for i in range(len(rows))}


def cloud(rng, n, dim, spread, label, first):
    centre = rng.standard_normal(dim)
    return [(first + i, (centre + spread * rng.standard_normal(dim)).astype(np.float32).tolist(), label) for i in range(n)]


@pytest.mark.parametrize("block", [512, 16])
def test_against_brute_force(spark, block):
    """A hot cluster whose blocks are split, chains, copies and strangers."""
    rng = np.random.default_rng(1)
    rows = cloud(rng, 90, 32, 0.05, 1, 0) + cloud(rng, 60, 32, 0.13, 1, 100) + cloud(rng, 40, 32, 2.0, 2, 200)
    rows += [(300 + i, rows[3][1], 1) for i in range(5)] + [(310 + i, rows[3][1], 2) for i in range(2)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA), block=block).collect()}
    want = brute(rows)
    total = sum(n for n, _ in want.values())
    assert all(got[k][0] <= n for k, (n, _) in want.items())  # no link below the threshold
    assert sum(n for n, _ in got.values()) >= 0.995 * total
    assert sum(got[k][1] == p for k, (_, p) in want.items()) >= 0.99 * len(want)


def test_odd_rows(spark):
    one = [1.0, 2.0]
    rows = [(1, one, None), (2, None, 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (7, one, 1), (8, [2.0, 4.0], 1), (9, [1.0, 2.0, 0.0], 1), (None, one, 1), (10, one, 2), (11, one, 1), (11, one, 1), (12, [], 1)]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    alone = [(k, 0, k, True) for k in (1, 2, 3, 4, 5, 6, 9, 10, 12)]
    assert got == sorted([*alone, (7, 3, 7, True), (8, 3, 7, False), (11, 3, 7, False), (11, 3, 7, False), (None, 0, None, True)], key=str)
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hosts_paths_and_rules(spark):
    urls = {
        "http://A.Example.NET/en/x?y#z": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://example.net/de/": ("example.net", "/de/", "net/", "block"),
        "http://net/": ("net", "/", "net/", "block"),
        "http://net": ("net", "", None, "allow"),
        "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
        "http://x.example.com/de/a": ("x.example.com", "/de/a", "example.com/de/", "block"),
        "http://a.org/fr/://b": ("a.org", "/fr/://b", "org/fr/", "allow"),
        "//a.org/fr/": ("", "", None, "allow"),
        "x\n://h?a/b": ("h", "", None, "allow"),
        "http://h#f": ("h", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    rows = [(i, u, "<p>", "extra") for i, u in enumerate(urls)] + [(99, None, None, "extra")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    assert got == {**dict(enumerate(urls.values())), 99: ("", "", None, "allow")}


def test_reputation_blocks_bad_hosts_only(spark):
    bad = [(i, "http://m.bad.com/a", "casino") for i in range(20)] + [(20, "http://m.bad.com/b", "fine")]
    good = [(100 + i, f"http://h{i % 7}.good.com/a", "fine") for i in range(200)]
    few = [(900, "http://new.good.com/", "casino")]
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(spark.createDataFrame(bad + good + few, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(21)} == {"block"} and {got[i] for i in range(100, 300)} == {"allow"} and got[900] == "allow"
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_owners_under_a_shared_suffix(spark):
    """One owner for each registered domain; ports, userinfo and addresses make no suffix of their own."""
    hosts = {
        "a.b.co.uk": ("b.co.uk", "co.uk"),
        "co.uk": ("co.uk", "co.uk"),
        "y.github.io": ("y.github.io", "github.io"),
        "u:p@www.example.com:8080": ("example.com", "com"),
        "example.com.": ("example.com", "com"),
        "10.2.1.1:80": ("10.2.1.1", "10.2.1.1"),
        "[::1]:80": ("[::1]", "[::1]"),
        "localhost": ("localhost", "localhost"),
        "": ("", ""),
    }
    domain, suffix = urlfilter.reputation_levels(F.col("host"))
    got = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", domain.alias("d"), suffix.alias("s")).collect()
    assert {r["host"]: (r["d"], r["s"]) for r in got} == hosts
    pages = [(f"s{i % 3}.spam.com:8080", int(i % 10 > 0)) for i in range(300)] + [("new.spam.com", 0), ("www.fine.com", 0)]
    bound = {r["host"]: r["alpha"] / (r["alpha"] + r["beta"]) for r in urlfilter.host_reputation(spark.createDataFrame(pages, "host string, outcome int")).collect()}
    assert bound["new.spam.com"] == pytest.approx(bound["s0.spam.com:8080"], abs=0.12)  # the port has the owner's prior
    pages = [(f"m{i % 3}.spam.co.uk", int(i % 10 > 0)) for i in range(300)] + [(f"w{i % 50}.net", 0) for i in range(600)] + [("fine.co.uk", 0)]
    post = urlfilter.host_reputation(spark.createDataFrame(pages, "host string, outcome int")).where("host = 'fine.co.uk'")
    assert post.select(urlfilter.lower_bound(F.col("alpha"), F.col("beta"))).first()[0] < urlfilter.LIMIT


def test_strengths_are_estimated(spark):
    """Hosts of one rate share a strong prior, hosts of all or nothing a weak one."""
    schema = "n long, bad long, all_n long, all_bad long, above double"
    strength = lambda rows: spark.createDataFrame(rows, schema).transform(lambda d: d.withColumn("m", urlfilter._strength(d, "n", "bad", "all_n", "all_bad", "above"))).first()["m"]
    under = lambda pairs: [(n, b, sum(x for x, _ in pairs), sum(y for _, y in pairs), 0.5) for n, b in pairs]
    assert strength(under([(100, 50)] * 20)) == urlfilter.STRENGTHS[1]
    assert strength(under([(100, 100 * (i % 2)) for i in range(20)])) < 1.2
    assert strength(under([(1, 1)] * 9)) == urlfilter.STRENGTHS[1]
    rng = np.random.default_rng(3)
    assert strength(under([(n, int(rng.binomial(n, rng.beta(12 * 0.3, 12 * 0.7)))) for n in rng.integers(5, 200, 4000).tolist()])) == pytest.approx(12, rel=0.1)


def test_repeated_and_long_pages(spark):
    long = "http://h.org/fr/" + "a" * 200_000
    rows = [(1, long, "y" * 300_000), (1, long, "y" * 300_000), (None, "http://h.org/", "casino")]
    got = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((str(r["page_id"]), len(r["path"]), r["rule"], r["verdict"]) for r in got) == [("1", 200_004, "org/fr/", "allow")] * 2 + [("None", 1, None, "allow")]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"create view {name[:-8]} as select * from '{sf}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_against_duckdb(spark, sf, duck, name):
    got, want = queries.QUERIES[name](spark, sf).toArrow(), duck.sql(queries.ORACLE_SQL[name]).to_arrow_table()
    names = sorted(got.column_names)
    assert names == sorted(want.column_names)
    rows = lambda t: sorted((tuple(r[n] for n in names) for r in t.select(names).to_pylist()), key=repr)
    assert rows(got) == rows(want)
