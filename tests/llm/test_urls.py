import math

import duckdb
import numpy as np

from tessera.llm import urls


def compare(spark, at):
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"create view {t} as select * from read_parquet(['{at}/{t}.parquet', '{at}/{t}.parquet/*.parquet'][{2 if at.startswith('/tmp') else 1}:{2 if at.startswith('/tmp') else 1}])")
    want = sorted(con.execute(f"select page_id, host, path, rule, verdict from ({urls.OP3_SQL})").fetchall(), key=repr)
    got = sorted((tuple(r) for r in urls.op3_url_reputation(spark, at).select("page_id", "host", "path", "rule", "verdict").collect()), key=repr)
    assert got == want
    return got


def test_whole_query_against_sql(spark):
    assert len(compare(spark, "/root/testdata/sf0.01")) == 250


def test_rules_and_parts(spark, tmp_path):
    rows = [
        (1, "http://A.Example.ORG/es/x?y#z", "a.example.org", "/es/x", "example.org/es/", "block"), (2, "https://org/", "org", "/", "org/", "allow"),
        (3, "x://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"), (4, "x://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"),
        (5, "no scheme", "", "", None, "allow"), (6, None, "", "", None, "allow"), (7, "", "", "", None, "allow"), (8, "http://?q", "", "", None, "allow"),
        (9, "http://h.com#x/de/", "h.com", "", None, "allow"), (10, "http://h.com/de/", "h.com", "/de/", "com/de/", "block"), (11, "a://b://c/d", "b:", "//c/d", None, "allow"),
        (12, "http://É.com/fr/", "É.com", "/fr/", "com/fr/", "allow"), (13, "http://org", "org", "", None, "allow"),
    ]
    rows = [(*r, 1) for r in rows] + [(100 + i, f"http://evil.net/{i}", "evil.net", f"/{i}", None, "block", 1) for i in range(60)]
    rows += [(300 + i, f"http://fine.net/{i}", "fine.net", f"/{i}", None, "allow", 1) for i in range(60)] + [(400, "http://new.net/1", "new.net", "/1", None, "allow", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, h string, p string, r string, v string, bad int")
    df.select("page_id", "url", "bad").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    marks = [(100 + i, 0, 0, "x") for i in range(60)] + [(300 + i, 1, 0, "x") for i in range(60)] + [(400, 0, None, "x"), (100, 1, 0, "x"), (None, 0, 0, "x"), (6, None, None, "x")]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int, host string").write.parquet(f"{tmp_path}/labels.parquet")
    got = compare(spark, str(tmp_path))
    assert got == sorted([(r[0], *r[2:6]) for r in rows], key=repr)
    pages = spark.read.parquet(f"{tmp_path}/pages.parquet")
    none = spark.createDataFrame([], "page_id long, bad int")
    assert urls.judge(pages.limit(0), none).count() == 0 and urls.judge(pages, none).count() == len(rows)


def test_hosts_without_labels_have_the_posterior_of_their_domain(spark):
    hosts = [f"r{k}.bad.net" for k in range(40)] + [f"r{k}.good.net" for k in range(40)]
    rows = [(100 * k + i, f"http://{h}/{i}") for k, h in enumerate(hosts) for i in range(10)]
    marks = [(i, int(".bad." in u)) for i, u in rows]
    fresh = {9001: "http://new.bad.net/x", 9002: "http://new.good.net/x", 9003: "http://bad.net/", 9004: "http://a.b.bad.net:80/", 9005: "http://other.net/", 9006: "http://x.test/", 9007: "http://new.bad.net/de/", 9008: "http://n.com/fr/"}
    pages = spark.createDataFrame(rows + list(fresh.items()), "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge(pages, spark.createDataFrame(marks, "page_id long, bad int")).collect()}
    assert [got[i] for i in fresh] == ["block", "allow", "block", "block", "allow", "allow", "block", "allow"]
    assert all(got[i] == ("block" if b else "allow") for i, b in marks)
    outcomes = spark.createDataFrame([("a.bad.net", 900, 810), ("b.bad.net", 100, 90), ("c.bad.net", 0, 0), ("x.fine.org", 1000, 100)], "host string, n long, bad long")
    r = {r.host: r for r in urls.reputation(outcomes).collect()}
    c = r["c.bad.net"]
    assert (c.n, c.bad) == (0, 0) and abs(c.mean - 0.9) < 0.01 and not r["x.fine.org"].blocked
    # the hosts differ so much that a domain counts as one page: P(rate <= 0.5) is about 0.07, too much to block
    assert (np.random.default_rng(1).beta(c.alpha, c.beta, 400_000) <= 0.5).mean() > 0.05 and not c.blocked
    alike = spark.createDataFrame([(f"h{k}.bad.net", 100, 90) for k in range(9)] + [("c.bad.net", 0, 0)], "host string, n long, bad long")
    assert {x.host: x.blocked for x in urls.reputation(alike).collect()}["c.bad.net"]


def test_fresh_subdomains_of_a_bad_domain_in_operator_and_sql(spark, tmp_path):
    rows = [(k * 50 + i, f"http://s{k}.evil.com.tr/{i}") for k in range(6) for i in range(50)] + [(1000 + k * 50 + i, f"http://s{k}.fine.com.tr/{i}") for k in range(6) for i in range(50)]
    fresh = [(9000, "http://new.evil.com.tr/"), (9001, "http://evil.com.tr:8080/x"), (9002, "http://me@new.evil.com.tr/"), (9003, "http://new.fine.com.tr/"), (9004, "http://other.com.tr/"), (9004, "http://other.com.tr/")]
    spark.createDataFrame(rows + fresh, "page_id long, url string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, int(".fine." in u), 0) for i, u in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = compare(spark, str(tmp_path))
    assert [r[4] for r in got if r[0] >= 9000] == ["block", "block", "block", "allow", "allow", "allow"]


def test_the_bound_is_a_quantile_of_the_beta_distribution(spark):
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b)) for a in (0.6, 1.5, 4.0, 20.0, 300.0) for b in (0.6, 1.5, 4.0, 20.0, 300.0)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "a double, b double")
    for r in df.select("a", "b", urls.below(0.5, F.col("a"), F.col("b")).alias("y")).collect():
        p = (1 + math.erf(r.y / math.sqrt(2))) / 2
        assert abs(p - (rng.beta(r.a, r.b, 400_000) <= 0.5).mean()) < 0.012, r
