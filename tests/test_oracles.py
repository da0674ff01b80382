"""Every registered query against its SQL twin, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


def test_every_query_has_a_twin_or_a_reason():
    assert set(entry.QUERIES) == set(entry.ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.ORACLES))
def test_query_matches_twin(spark, sf, duck, name):
    got = entry.queries()[name](spark, sf).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert compare(got, want) is None


def test_entry_finds_anomalies(spark):
    rows = entry.entry(spark).collect()
    assert {r.anomaly_type for r in rows} >= {"late_delivery_spike", "fraud_cluster"}
    assert [r.position for r in sorted(rows, key=lambda r: r.position)] == list(range(1, len(rows) + 1))
