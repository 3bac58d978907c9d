import hashlib
import random
import re
import string

import duckdb
from pyspark.sql import functions as F

from tessera.llm import secrets

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def check(rows, got):
    assert len(rows) == len(got)
    for r in got:
        want = base(rows[r.doc_id])
        written = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in want) for x in range(3))
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        kept = [x for x in r.spans.split(",") if x and not x.startswith("generic")]
        assert ",".join(kept) == written


def same_as_sql(tmp_path, got):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live"]
    want = sorted(con.execute(f"select {', '.join(names)} from ({secrets.OP7_SQL})").fetchall(), key=repr)
    assert sorted((tuple(r[n] for n in names) for r in got), key=repr) == want


def test_whole_query(spark):
    at = "/root/testdata/sf0.001"
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    check(rows, secrets.op7_secret_scan(spark, at).collect())


def test_hard_cases(spark, tmp_path):
    h = "0123456789abcdef" * 2
    texts = [
        None, "", f"é😀 token = '{h}' x", "secret=token:abcdef", "password: ab token=abcdefgh", "AKIA" + "A" * 16, "AKIAAKIA" + "B" * 15, "AKIA" + "A" * 15,
        f"{h} {h[:23]} x{h}", "PassWord=abc.def-1 api_key: 'zzzzzz' APIKEY=\"12345\"", "paſſword=abcdefg toKen=abcdefg", "token=" * 50, f"key sk-A1b2C3d4E5f6G7h8I9j0K {h} ",
        "\n".join(f"secret = v{i:07d}" for i in range(2000)), "password=\nabcdefg", "token  :  \"a/b+c=d.e_f",
    ]
    rows = [(i, t, f"s{i}", "en", 1) for i, t in enumerate(texts)] + [(100 + i, "copied zZ9" + "Ab3" * 8, f"s{i}", "en", 2) for i in range(5)]
    rows += [(200, "mine qQ9" + "Xy7" * 8, "s1", "en", 1), (201, "mine qQ9" + "Xy7" * 8, None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, kind int").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = secrets.op7_secret_scan(spark, str(tmp_path)).collect()
    check({r[0]: r[1] for r in rows}, got)
    same_as_sql(tmp_path, got)
    spans = {r.doc_id: r.spans for r in got}
    assert all("generic" not in spans[100 + i] for i in range(5))
    assert spans[200] == spans[201] == "generic:5:32"
    assert "generic:4:" in spans[12]
    assert secrets.scan(df.limit(0)).count() == 0
    assert secrets.scan(df.union(df)).count() == 2 * len(rows)


def test_long_keys_and_keys_with_slashes(spark):
    rng = random.Random(3)
    key = lambda n: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))
    own = {
        1: f"{key(30)}7a{key(300)}", 2: f"{key(12)}/{key(9)}3/{key(11)}/q{key(14)}", 3: f"{key(15)}8b--{key(20)}",
        4: f"{key(2000)}x1", 5: "/".join(key(14) + "5d" for _ in range(30)),
    }
    paths = {10: "/usr/local/lib/python3/site-packages/numpy", 11: "docs/2024/05/Report/page-12/index", 12: "-----------BEGIN-2024", 13: "//cdn/STATIC/v2/img_0012/large"}
    rows = [(i, f"see {t} end", f"s{i}") for i, t in (own | paths).items()] + [(100 + k, f"copied {own[5][::-1]} here", f"s{k}") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en"))
    got = {r.doc_id: [secrets.KINDS[s.kind] + f":{s.start}:{s.end}" for s in r.found] for r in secrets.scan(docs).collect()}
    assert {i: got[i] for i in own} == {i: [f"generic:4:{4 + len(t)}"] for i, t in own.items()}
    assert not any(got[i] for i in got if i not in own)
    text = {r.doc_id: r.new_text for r in secrets.masked(docs).collect()}
    assert text == {i: "see [secret] end" for i in own}


def generic(text, held):
    """Spans of GENERIC values by plain rules; held: value -> (owners, repositories)."""
    out = []
    for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])", text or ""):
        v = m[0]
        parts = [p for p in re.split("[+/_-]+", v) if p]
        plain = all(re.fullmatch("[A-Z]?[a-z]*[0-9]{0,4}|[a-z]*([A-Z][a-z]+){0,4}[0-9]{0,4}|[A-Z]+[0-9]{0,4}|[0-9]+", p) for p in parts)
        path = (v.count("/") >= 3 or "--" in v) and plain
        if re.search("[0-9]", v) and re.search("[A-Za-z]", v) and not path and not any(s < m.end() and e > m.start() for s, _, e in base(text)):
            owners, repositories = held(v)
            if owners <= secrets.FEW_OWNERS and repositories <= secrets.FEW_REPOSITORIES:
                out.append(f"generic:{m.start()}:{m.end()}")
    return out


def test_added_spans_against_plain_rules(spark, tmp_path):
    rows = [(r.doc_id, r.text, r.source, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    copied, own = "Zx9" + "Ab3" * 8, "Qy7" + "Cd5" * 8
    rows += [(10_000 + i, f"see {copied} here", "hot", f"l{i}") for i in range(4)]  # one owner, four repositories
    rows += [(10_100 + i, f"see {own} here", "hot", "l1") for i in range(4)]  # one of each
    rows += [(10_200, "a/b1/c2/d3-" + "x" * 12, "s", "en"), (10_201, f"x {copied}/{own}", None, None), (10_202, None, "s", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    where = {}
    for _, t, source, lang in rows:
        for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])", t or ""):
            where.setdefault(m[0], set()).add((source, lang))
    held = lambda v: (len({s for s, _ in where[v]}), len(where[v]))
    rows_got = secrets.op7_secret_scan(spark, str(tmp_path)).collect()
    same_as_sql(tmp_path, rows_got)
    got = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("generic")] for r in rows_got}
    assert got == {i: generic(t, held) for i, t, _, _ in rows}
    assert not got[10_000] and got[10_100]


def test_masked_keeps_rows_of_repeated_ids_apart(spark):
    from tessera.llm.common import keyed

    rows = [(1, "token=abcdefgh1", "s"), (1, "token=abcdefgh1", "s"), (1, "plain", "s"), (None, "token=zzzzzz9", "t")]
    docs = keyed(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en")), "row_key")
    got = secrets.masked(docs, id_col="row_key").collect()
    assert len(got) == 3 and len({r.row_key for r in got}) == 3 and {r.new_text for r in got} == {"[secret]"}
