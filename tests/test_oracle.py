"""Every registered query against its DuckDB SQL on the smallest tables
(the driver repeats this at sf0.01); queries without SQL must still run."""

import pytest

from parcelwise.plans import check
from parcelwise.plans.registry import ORACLE, QUERIES, load_all

from conftest import SMALL

load_all()


@pytest.fixture(scope="module")
def duck():
    return check.duck(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    if name not in ORACLE:
        assert df.count() >= 0
        return
    ok, msg = check.compare(df, duck, ORACLE[name])
    assert ok, msg


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(QUERIES) <= set(E.queries())
    assert set(E.oracle_sql()) <= set(E.queries())
