"""Every registered query against its SQL, whole tables."""

import pytest

from sfqueries import catalog, oracles
from tests.compare import duck, duck_rows, spark_rows

SF = ("/root/testdata/sf0.001", "/root/testdata/sf0.01")
QUERIES = catalog.queries()
ORACLES = oracles.oracle_sql()


@pytest.fixture(scope="module")
def cons():
    return {sf: duck(sf) for sf in SF}


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("sf", SF)
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, cons, name, sf, capsys):
    df = QUERIES[name](spark, sf)
    df.explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "EvalPython" not in plan or name == "encode_hook"
    names, rows = spark_rows(df)
    duck_names, expected = duck_rows(cons[sf], ORACLES[name])
    assert names == duck_names
    assert sum(rows.values()) == sum(expected.values())
    missing, extra = expected - rows, rows - expected
    assert not missing and not extra, (list(missing)[:2], list(extra)[:2])
    assert rows, "an empty result proves nothing"
