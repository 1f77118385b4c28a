"""Every query of the catalogue against its SQL, as sorted rows."""

import duckdb
import pytest

from quern.plans import catalogue

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    sql = con.execute(catalogue.ORACLE[name])
    names = [d[0] for d in sql.description]
    assert sorted(df.columns) == sorted(names)
    want = [tuple(sorted(zip(names, r))) for r in sql.fetchall()]
    got = [tuple(sorted(r.asDict().items())) for r in df.collect()]
    assert len(got) > 0
    assert sorted(map(str, got)) == sorted(map(str, want))
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date", "BOOLEAN": "boolean"}
    assert {n: kinds[str(t)] for n, t in con.sql(f"SELECT column_name, column_type FROM (DESCRIBE {catalogue.ORACLE[name]})").fetchall()} == dict(df.dtypes)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE) == {"sample_estimate"}
