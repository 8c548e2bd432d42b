import os

import pytest

from quillon.plans import catalogue
from quillon.plans.views import VIEWS, run_all
from quillon.schemas import SCHEMAS
from quillon.sources.warehouse import Warehouse
from tests.oracle import connection, differences

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


def test_names():
    assert set(SQL) <= set(QUERIES) and len(VIEWS) == 36 and all(v.columns and v.title for v in VIEWS.values())


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    assert differences(QUERIES[name], SQL[name], spark, con, FOLDER) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert len(set(df.columns)) == len(df.columns)
    df.count()


def test_views_on_an_empty_warehouse(spark, tmp_path):
    results = run_all(Warehouse(spark, str(tmp_path)))
    assert not [(r.view.name, r.error) for r in results if r.error]
    assert {r.view.name for r in results if r.row_count} <= {"corpus_summary", "amplification_rate"}
    assert len(SCHEMAS) == 21


def test_a_failing_view_does_not_end_the_batch(spark, tmp_path, monkeypatch):
    import dataclasses

    def broken(w):
        raise RuntimeError("broken")

    monkeypatch.setitem(VIEWS, "findings", dataclasses.replace(VIEWS["findings"], build=broken))
    results = {r.view.name: r for r in run_all(Warehouse(spark, str(tmp_path)))}
    assert results["findings"].error == "broken" and results["recommendations"].error is None
