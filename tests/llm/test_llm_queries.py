"""Queries of the training-data operators: SQL where there is one, unique rows, determinism of columns."""

import importlib

import pytest
import util

E = importlib.import_module("quarto.llm.entries")
COLUMNS = {
    "p1_found": [("id_a", "string"), ("id_b", "string")], "p2_found": [("src", "string"), ("rec_id", "bigint"), ("noise", "string")], "p3_found": [("skeleton_id", "bigint"), ("line_no", "int")], "p5_found": [("ref_field", "string"), ("rec_id", "bigint"), ("ref_id", "bigint")],
    "p6_found": [("chunk_id", "bigint")], "p7_found": [("rec_a", "string"), ("rec_b", "string")], "p8_ids": [("doc_id", "bigint"), ("ids", "array<int>")], "p9_found": [("doc_id", "bigint"), ("item_id", "bigint")], "p10_found": [("doc_id", "bigint")],
}


@pytest.mark.parametrize("name", sorted(E.ORACLE))
def test_sql(spark, small, name):
    util.same_as_sql(E.QUERIES[name](spark, small), util.connect(small), E.ORACLE[name])


@pytest.mark.parametrize("name", sorted(E.QUERIES))
def test_rows(spark, small, name):
    df = E.QUERIES[name](spark, small)
    if name in COLUMNS:
        assert [(c, t) for c, t in df.dtypes] == COLUMNS[name]
    rows = [str(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
