from pathlib import Path

import duckdb
import pytest

from corpusmill.operators.discovery import split_windows
from corpusmill.plans import catalogue

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: "-" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not SF.exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, str(SF))
    want = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert shown([tuple(r) for r in df.collect()], df.columns) == shown(want.fetchall(), names)


def test_windows_tile():
    from datetime import date, timedelta

    start = date(2024, 1, 1)
    daily = [(start + timedelta(i), 7 * i % 50 + (2000 if i == 100 else 0)) for i in range(366)]
    found = split_windows(daily, start, start + timedelta(365))
    assert sum(w[2] for w in found) == sum(n for _, n in daily)
    assert all(a[1] < b[0] for a, b in zip(found, found[1:]))
    assert [w[0] for w in found if w[3]] == [start + timedelta(100)]
