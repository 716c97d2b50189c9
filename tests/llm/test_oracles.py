"""The registered operators against their SQL, and that all of them are registered."""

import pytest

from tidelog.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_its_sql(agrees, name):
    assert agrees(QUERIES[name], ORACLE_SQL[name]) > 0


def test_all_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
