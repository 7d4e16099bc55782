import pytest

from murmura.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_agrees_with_sql(agree, name):
    agree(Q.queries()[name], Q.oracle_sql()[name])
