import importlib.util

import pytest

from outlay.plans.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(name, spark, sf_dir, same):
    same(QUERIES[name](spark, sf_dir), ORACLES[name])


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["authority_id", "suppliers", "contracts", "value_eur", "hhi"]
    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    if importlib.util.find_spec("outlay.llm"):
        assert sum(n.startswith("op") and n[2].isdigit() for n in e.queries()) == 13
