"""Every registered query against its DuckDB oracle on the smallest tables
(the driver runs the same comparison at sf0.01)."""

import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracle import TABLES, _rows

SMALL = "/root/testdata/sf0.001"
ORACLES = E.oracle_sql()
NAMES = sorted(E.queries())


def _family(t: str) -> str:
    t = t.lower()
    for key, fam in [("decimal", "decimal"), ("double", "float"), ("float", "float"), ("bigint", "int64"),
                     ("int64", "int64"), ("integer", "int32"), ("int32", "int32"), ("int", "int32"), ("bool", "bool"),
                     ("timestamp", "timestamp"), ("date", "date"), ("string", "string"), ("varchar", "string")]:
        if key in t:
            return fam
    return t


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    yield con
    con.close()


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SMALL)
    srows = [r.asDict(recursive=True) for r in sdf.collect()]
    cols = sorted(sdf.columns)
    if name not in ORACLES:
        assert len(srows) > 0
        return
    cur = duck.execute(ORACLES[name])
    dcols = [d[0] for d in cur.description]
    drows = [dict(zip(dcols, r)) for r in cur.fetchall()]
    assert sorted(dcols) == cols
    assert len(srows) == len(drows)
    assert _rows(srows, cols, 9) == _rows(drows, cols, 9)
    # same type family per column (no DECIMAL where Spark has DOUBLE, etc.)
    spark_types = {f.name: _family(f.dataType.simpleString()) for f in sdf.schema.fields}
    duck_types = {f.name: _family(str(f.type)) for f in duck.sql(ORACLES[name]).arrow().schema}
    assert spark_types == duck_types


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["row_id", "reply"]
