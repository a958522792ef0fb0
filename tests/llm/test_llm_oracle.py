"""The queries of this subpackage that SQL can express, against DuckDB."""

import duckdb
import numpy as np
import pytest

from tidemark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, data, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        duck.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    ours, theirs = queries.queries()[name](spark, data).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    names = sorted(ours.columns)
    ours, theirs = (df[names].sort_values(names).reset_index(drop=True) for df in (ours, theirs))
    assert len(ours) == len(theirs)
    for c in names:
        if ours[c].dtype.kind == "f":
            assert np.allclose(ours[c], theirs[c])
        else:
            assert (ours[c].astype(str) == theirs[c].astype(str)).all()
