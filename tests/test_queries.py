"""Every query of the library against DuckDB on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from tessera.plans.queries import ORACLE, QUERIES
from tessera.plans.ship import ship

AT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{AT}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, datetime.datetime):
        v = v.replace(tzinfo=None)
    return 0.0 if isinstance(v, float) and v == 0 else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    ship(spark)
    df = QUERIES[name](spark, AT)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLE:
        assert got
        return
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)


def test_results_do_not_depend_on_partitions(spark, tmp_path):
    for name in ("lineitem", "events"):
        spark.read.parquet(f"{AT}/{name}.parquet").repartition(7).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("curate_regression_dups", "drop_duplicates_first", "outlier_selection", "spearman"):
        a, b = (sorted(map(repr, QUERIES[name](spark, at).collect())) for at in (AT, str(tmp_path)))
        assert a == b
