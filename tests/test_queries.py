"""Every registered query against its SQL on small tables."""

import math
from collections import Counter

import duckdb
import pytest

from fernweave.jobs.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    return round(x, 5) + 0.0 if isinstance(x, float) and math.isfinite(x) else x


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = Counter(tuple(map(plain, r)) for r in df.select(*columns).collect())
    if name in SQL:
        con = duckdb.connect()
        con.execute("set timezone = 'UTC'")
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
        cursor = con.execute(SQL[name])
        assert sorted(c[0] for c in cursor.description) == columns
        con.execute(f"create table expected as {SQL[name]}")
        expected = con.execute(f"select {', '.join(columns)} from expected").fetchall()
        assert rows == Counter(tuple(map(plain, r)) for r in expected)
    assert rows or name in ("pause_streaks",)
