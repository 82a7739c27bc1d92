"""Every registered query against its SQL, on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from quarryloom.plans import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(repr([None if pd.isna(v) else float(v) if isinstance(v, (int, float)) else str(v) for v in r]) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", [n for n in core.QUERIES if n in core.SQL])
def test_same_rows(spark, db, name):
    got, want = core.QUERIES[name](spark, SF).toPandas(), db.execute(core.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entropy_of_whole_texts(spark):
    got = {r["doc_id"]: r["bits"] for r in core.QUERIES["entropy_bytes"](spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got.keys() == texts.keys() and any(len(t or "") > 400 for t in texts.values())
    for doc_id, text in texts.items():
        if text is None:
            assert got[doc_id] is None
            continue
        raw = text.encode()
        shares = [raw.count(b) / len(raw) for b in set(raw)]
        assert abs(got[doc_id] + sum(p * math.log2(p) for p in shares)) < 2e-6
