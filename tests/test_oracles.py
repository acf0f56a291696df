import pytest
from oracle import same

from quorate import plans

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_same_rows(spark, name):
    same(spark, plans.QUERIES[name], plans.ORACLE_SQL[name], SF)


def test_every_query_has_sql():
    # Two pool labels of blocks of words, one cuts by a tokenizer file; test_core.py compares them with plain Python.
    assert plans.QUERIES.keys() - plans.ORACLE_SQL.keys() == {"classifier_notes", "comparison_file", "token_blocks"}
