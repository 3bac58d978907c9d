import hashlib
import random
import re

import duckdb
import numpy as np

from tessera.llm import substring
from tessera.llm.wordhash import Words, get_varints, put_varints


def brute(rows, window=20):
    seen, out = {}, {}
    split = {i: re.findall("[^\\x20\\x09-\\x0D]+", t or "") for i, t in rows}
    for i in sorted(split):
        w = split[i]
        for s in range(len(w) - window + 1):
            seen.setdefault(tuple(w[s : s + window]), (i, s))
    for i, w in split.items():
        drop = [False] * len(w)
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s : s + window])] != (i, s):
                drop[s : s + window] = [True] * window
        kept = " ".join(x for x, d in zip(w, drop) if not d)
        out[i] = (len(w), sum(drop), hashlib.sha256(kept.encode()).hexdigest())
    return out


def check(spark, tmp_path, rows):
    with_more = [(*r, "x") for r in [*rows, (None, "a " * 50)]]  # a row without an id, and a column of a clashing name
    spark.createDataFrame(with_more, "doc_id long, text string, places string").repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.op5_substring(spark, str(tmp_path)).collect()}
    assert got == brute(rows)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert {r[0]: r[1:] for r in con.execute(f"select doc_id, n_words, n_removed, kept_sha256 from ({substring.OP5_SQL})").fetchall()} == got


def test_whole_query_against_brute_force(spark):
    at = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.op5_substring(spark, at).collect()}
    assert got == brute(rows)
    assert sum(x[1] for x in got.values()) > 0


def test_hard_cases(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = [f"w{i}é" for i in range(50)] + ["\x1c", "x" * 400]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "a " * 100), (4, "a " * 19), (5, " ".join(["a"] * 20))]
    for i in range(6, 60):
        filler = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 90))]
        s = rng.randrange(0, 45)
        cut = passage[s : s + rng.randrange(15, 60)]
        k = rng.randrange(0, len(filler) + 1)
        rows.append((i, rng.choice([" ", "\n", "  "]).join(filler[:k] + cut + filler[k:])))
    rows += [(100 + i, rows[10][1]) for i in range(40)]
    check(spark, tmp_path, rows)
    check(spark, tmp_path, [])


def test_small_batches_give_the_same(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 120)))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.op5_substring(spark, str(tmp_path)).collect()}
    assert got == want


def test_varints_and_words():
    x = np.array([0, 1, 127, 128, 16383, 16384, 2**28, 2**34])
    assert (get_varints(put_varints(x)) == x).all()
    assert len(get_varints(b"")) == 0
    w = Words([b"a b  c", b"", b"\x0bd\r\n", "é à".encode()])
    assert w.n.tolist() == [3, 0, 1, 2] and len(set(w.hashes().tolist())) == 6
    assert Words([]).n.tolist() == []


def test_repeated_ids_have_a_row_each(spark, tmp_path):
    a, b, c = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(40)), " ".join(f"c{i}" for i in range(25))
    rows = [(1, a), (1, a), (1, f"{b} x"), (2, f"{b} y"), (3, c), (3, c), (3, c), (None, c), (4, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring.op5_substring(spark, str(tmp_path)).collect())
    assert got == sorted([(1, 30, 0), (1, 30, 30), (1, 41, 0), (2, 41, 40), (3, 25, 0), (3, 25, 25), (3, 25, 25), (4, 0, 0), (4, 0, 0)])
