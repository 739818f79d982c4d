"""Each registered query against its SQL in DuckDB, on the driver's tables."""

import math

import duckdb
import pytest

from tessera import catalog

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels benchmark conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    value = lambda v: None if isinstance(v, float) and math.isnan(v) else [*v] if isinstance(v, (list, tuple)) else v
    return sorted(([value(r[k]) for k in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert rows, "no rows"
    if name in catalog.oracle_sql():
        wanted = con.sql(catalog.oracle_sql()[name])
        assert sorted(wanted.columns) == sorted(df.columns)
        kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "array<string>": "VARCHAR[]"}
        assert dict(zip(wanted.columns, map(str, wanted.types))) == {c: kinds[t] for c, t in df.dtypes}
        assert plain(rows, df.columns) == plain(wanted.fetchall(), wanted.columns)


def test_label_functions_of_large_ids(spark, tmp_path):
    """Event ids of every band of sizes."""
    rows = spark.read.parquet(f"{SF}/events.parquet").where("event_id < 40")
    shifted = rows.selectExpr("event_id + element_at(array(0, 990, 9990, 99990, 999990), cast(event_id div 8 + 1 as int)) AS event_id", "ts", "user_id", "event_type", "value", "props")
    shifted.write.parquet(str(tmp_path / "events.parquet"))
    df = catalog.queries()["label_functions"](spark, str(tmp_path))
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    c.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    wanted = c.sql(catalog.oracle_sql()["label_functions"])
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(wanted.fetchall(), wanted.columns)
