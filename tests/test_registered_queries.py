"""Registered queries against their SQL twins in DuckDB, on the smallest tables.

All of them; PACEGRID_SHARD=k/n takes every n-th from the k-th on, so that n runs cover them all."""

import os

import duckdb
import numpy as np
import pytest

from pacegrid import catalogue

DATA = "/root/testdata/sf0.001"
NAMES = sorted(set(catalogue.queries()) & set(catalogue.oracle_sql()))
FIRST, STEP = map(int, os.environ.get("PACEGRID_SHARD", "0/1").split("/"))
SOME = NAMES[FIRST::STEP]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame:
        if frame[c].dtype == object:
            frame[c] = frame[c].map(lambda x: None if x is None or x != x else x)
        elif frame[c].dtype.kind in "iufb" or str(frame[c].dtype) in ("Int64", "boolean"):
            frame[c] = frame[c].astype(float)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", SOME)
def test_query_matches_its_twin(spark, duck, name):
    ours, theirs = rows(catalogue.queries()[name](spark, DATA).toPandas()), rows(duck.execute(catalogue.oracle_sql()[name]).fetchdf())
    assert list(ours.columns) == list(theirs.columns)
    assert len(ours) == len(theirs)
    for c in ours:
        if ours[c].dtype.kind == "f" and theirs[c].dtype.kind == "f":
            np.testing.assert_allclose(ours[c], theirs[c], rtol=0, atol=2e-6 * max(1.0, np.nanmax(np.abs(ours[c])) if ours[c].notna().any() else 1.0))
        else:
            assert [None if x is None or x != x else x for x in ours[c]] == [None if x is None or x != x else x for x in theirs[c]], c


def test_entry_and_registry():
    import __spark_entry__

    queries, oracle = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracle) <= set(queries)
    assert "w05_wf_features" in queries
