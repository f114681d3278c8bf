"""Queries of the operators that have SQL, beside it."""

import pytest

from tests.oracle import compare, connect
from tidemark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op8_lines", "op11_collocations", "op12_negatives"])
def test_query_equals_its_sql(spark, name):
    assert compare(queries.JOBS[name](spark, SF), connect(SF), queries.ORACLES[name]) is None


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(queries.ORACLES) <= set(queries.JOBS)
    assert {n for n in queries.JOBS if n not in queries.ORACLES} == {"op1_chunks", "op3_quality", "op5_slots", "op9_packing", "op13_wordpieces"}
