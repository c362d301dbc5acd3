"""Each registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from helixmill.plans import catalogue, datasets, files  # noqa: F401  both register their queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def canonical(rows):
    def of(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return round(v, 9) if isinstance(v, float) else v

    return sorted(repr([of(v) for v in r]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query(spark, oracle, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rel = oracle.sql(catalogue.ORACLE[name])
    assert columns == sorted(rel.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert canonical(df.select(*columns).collect()) == canonical(oracle.sql(f"select {quoted} from ({catalogue.ORACLE[name]})").fetchall())
