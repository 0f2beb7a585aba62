"""Every query of the subpackage runs over the smallest tables; those with SQL give what it gives."""

import os

import pytest

from pagewright.llm import queries

from .. import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.FOLDER), reason="no test tables")

COLUMNS = {
    "p1_found": ["field_name", "ref_id", "result_id"], "p2_found": ["result_a", "result_b"], "p3_found": ["field_name", "kind", "result_id", "start_pos"],
    "p4_found": ["kind", "pos", "result_id", "unit"], "p5_found": ["sample_a", "sample_b"], "p6_found": ["origin", "row_id"], "p7_found": ["doc_id", "kind_id"],
    "p8_found": ["doc_id", "item_id"], "p9_found": ["band", "doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, oracle.FOLDER)
    cols, rows = oracle.rows_of_spark(df)
    assert rows
    if name in COLUMNS:
        assert cols == COLUMNS[name] and max(rows.values()) == 1
    if name in queries.SQL:
        assert rows == oracle.rows_of_sql(oracle.connect(), queries.SQL[name], cols)
