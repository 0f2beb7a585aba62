"""Every core query runs over the smallest tables, and gives what its SQL gives."""

import os

import pytest

from pagewright.plans import queries

from . import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, oracle.FOLDER)
    cols, rows = oracle.rows_of_spark(df)
    assert cols and len(set(cols)) == len(cols)
    if name in queries.SQL:
        assert rows == oracle.rows_of_sql(oracle.connect(), queries.SQL[name], cols)
    else:
        assert rows


def test_every_sql_has_a_query():
    assert set(queries.SQL) <= set(queries.QUERIES)
