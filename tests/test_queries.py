"""Every query of the engine itself against its SQL at the smallest scale."""

import duckdb
import pytest

from setaudit import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame:
        if frame[c].dtype.kind == "f":
            frame[c] = frame[c].round(6)
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).astype(str).values.tolist()))


@pytest.mark.parametrize("name", plans.QUERIES)
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    if name in plans.ORACLES:
        want = duck.sql(plans.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    else:
        assert len(got)
