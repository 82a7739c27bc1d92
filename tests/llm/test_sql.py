"""The registered queries against their DuckDB SQL, on the smallest tables."""

import duckdb
import pytest

from quarryloom.llm import queries

SF = "/root/testdata/sf0.001"


def rows(frame):
    return sorted(map(repr, frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF).toPandas(), db.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert got.dtypes.to_dict() == want[got.columns].dtypes.to_dict()
    assert rows(got) == rows(want)
