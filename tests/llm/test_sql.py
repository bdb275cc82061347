"""The queries of the operators that SQL can say as well, against that SQL."""

import os

import duckdb
import pytest

from pagewatch.llm import queries
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    got = queries.queries()[name](spark, DATA).toPandas()
    want = con.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    # Sums of doubles differ in their last digits with the order of adding.
    text = lambda v: str(round(v, 9) if isinstance(v, float) else v)
    rows = lambda df: sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)
