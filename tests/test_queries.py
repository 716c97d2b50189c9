"""Every registered query of the engine against its SQL."""

import sys
from types import SimpleNamespace

import pytest

from tidelog.plans import shipping
from tidelog.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_its_sql(agrees, name):
    agrees(QUERIES[name], ORACLE_SQL[name])


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE_SQL.keys()


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 398


def test_entry_does_without_the_training_data_operators(monkeypatch):
    import __spark_entry__

    for module in ("tidelog.llm.queries", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, module, None)
    assert __spark_entry__.queries() == QUERIES and __spark_entry__.oracle_sql() == ORACLE_SQL


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"])
def test_a_cluster_needs_a_shared_folder(master):
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shipping.shared_dir(session)


def test_columns_of_any_name_reach_python(spark):
    df = spark.range(3).selectExpr("id AS `a.b`", "id * 2 AS `c d`", "id * 3 AS `e``f`")
    out = shipping.map_batches(df, lambda batches: batches, spark.range(1).selectExpr("id AS c0", "id AS c1", "id AS c2").schema)
    assert sorted(map(tuple, out.collect())) == [(0, 0, 0), (1, 2, 3), (2, 4, 6)]
