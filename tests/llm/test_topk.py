import duckdb
import numpy as np

from tessera.llm import topk


def test_whole_query_against_sql(spark):
    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{at}/embeddings.parquet'")
    want = sorted(con.execute(topk.OP4_SQL).fetchall())
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.op4_top_k(spark, at).collect())
    assert got == want and len(got) == 50


def test_ties_blocks_and_unusual_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6)], 1) for i in range(200)]
    rows += [(1000 + i, [0.5, 0.5, 0.5, 0.5, 0.5, 0.5], 1) for i in range(150)]
    bad = [(2000, None, 1), (2001, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (2002, [float("nan")] * 6, 1), (2003, [float("inf")] * 6, 1), (None, [1.0] * 6, 1), (2004, [], 1), (2005, [9.0], 1)]
    df = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<float>, score int").repartition(5)
    monkeypatch.setattr(topk, "QUERIES", 3)
    v = topk.quantized(df)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(v, v.where("vec_id % 50 = 0"), 5).collect())
    q = {i: np.floor(256 * np.array(x)).astype(int) for i, x, _ in rows}
    want = []
    for i in q:
        if i % 50 == 0:
            best = sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(v, v.limit(0), 5).count() == 0
    few = v.where("vec_id in (0, 1, 2)")
    assert topk.top_k(few, few.where("vec_id = 0"), 5).count() == 2


def test_repeats_and_large_components_against_sql_and_integers(spark, tmp_path, monkeypatch):
    rows = [(i, [float((i * 7 + k) % 11) for k in range(4)]) for i in (0, 1, 2, 3, 3, 50, 50, 51)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.op4_top_k(spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(topk.OP4_SQL).fetchall())
    large = [(0, [1e18, 1.0, -3.0, 0.0]), (1, [1.0, 2.0, 3.0, 4.0]), (2, [3e6, 5e6, 1.0, 0.0]), (3, [-1e18, 0.0, 0.0, 0.0]), (4, [1.0, 2.0, 3.0, 5.0]), (5, [3e38, 0.0, 0.0, 1.0]), (50, [4e6, 6e6, 0.0, 1.0])]
    df = topk.quantized(spark.createDataFrame(large, "vec_id long, embedding array<float>"))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id % 50 = 0"), 4).collect())
    v = {i: [int(np.floor(256 * float(np.float32(x)))) for x in e] for i, e in large}
    end = lambda x: min(2**63 - 1, max(-(2**63), x))
    want = []
    for i in (0, 50):
        best = sorted((-end(sum(a * b for a, b in zip(v[i], v[j]))), j) for j in v if j != i)[:4]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == want
