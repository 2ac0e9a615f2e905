import pytest

from kurtosia.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(same_as_sql, name):
    same_as_sql(registry.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, name):
    assert registry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert {"user_id", "event_id", "status"} <= set(out.columns)
    assert {r.status for r in out.select("status").distinct().collect()} == {"confirmed", "normal", "unavailable"}
