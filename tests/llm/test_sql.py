"""The SQL twins of these queries give the same rows."""

import math
from pathlib import Path

import duckdb
import pytest

from nearfield.llm import oracle, queries

DATA = Path("/root/testdata/sf0.001")


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    cell = lambda v: "null" if v is None or isinstance(v, float) and math.isnan(v) else repr(v) if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[k]) for k in order) for r in rows)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_same_rows(spark, name):
    db = duckdb.connect()
    for t in "documents embeddings labels pages".split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, str(DATA))
    cur = db.execute(oracle.ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(cur.fetchall(), columns)
