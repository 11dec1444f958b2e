"""Every query against its DuckDB oracle, value by value."""

import duckdb
import pandas as pd
import pytest

from leafmill import registry
from leafmill.sources.views import RAW

CALLABLES = registry.callables()
ORACLES = registry.oracle_texts()


@pytest.fixture(scope="module")
def duck(data_dir):
    connection = duckdb.connect()
    for table in RAW:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data_dir}/{table}.parquet'")
    return connection


def _rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    frame = frame[sorted(frame.columns)]

    def text(value):
        if value is None or value is pd.NaT or value is pd.NA or value != value:
            return ""
        return repr(value.item() if hasattr(value, "item") else value)

    return sorted(tuple(text(v) for v in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(name, spark, duck, data_dir):
    got = CALLABLES[name](spark, data_dir).toPandas()
    want = duck.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)
    assert len(got) > 0


def test_every_query_has_an_oracle():
    assert set(CALLABLES) == set(ORACLES)
