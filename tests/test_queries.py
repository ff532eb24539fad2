"""Every registered query runs; those with SQL agree with DuckDB."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from catalog import ORACLES, QUERIES, training
from treeline.plans.model import Model
from tools.compare import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    status, note, _ = compare(spark, con, sf, name, QUERIES[name], ORACLES.get(name))
    assert status in ("OK", "ROWS"), note


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_fit_multiclass_sees_every_dimension(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(training, "fit_boosted_trees", lambda df, params: seen.append(df) or Model(params["objective"], params, 0.0, 64))
    QUERIES["fit_multiclass"](spark, sf)
    assert [r["n"] for r in seen[0].selectExpr("size(features) AS n").distinct().collect()] == [64]
