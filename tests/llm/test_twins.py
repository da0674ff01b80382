"""Each operator query that SQL can express against its twin."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from oracle_check import compare, connect  # noqa: E402

from riskframe.llm.oracles import ORACLES  # noqa: E402
from riskframe.llm.queries import QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_twin(spark, sf, name):
    want = connect(sf).execute(ORACLES[name]).df()
    assert compare(QUERIES[name](spark, sf).toPandas(), want) is None


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
