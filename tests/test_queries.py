"""Every registered query runs, and agrees with its DuckDB twin, on the smallest tables."""

import os

import pytest

from starling.plans import analytics, events, inference, services, spatial  # noqa: F401
from starling.plans.registry import QUERIES, SQL
from tests.twins import check, connection

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, duck, name):
    check(spark, duck, name, QUERIES[name], SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).columns


def test_results_rest_on_all_indicators_of_profiles(spark):
    inds, polys = {}, {}
    for name in ("ind_coordinate", "ind_locfield", "ind_gis", "ind_website", "ind_tz", "ind_tzoffset"):
        for r in QUERIES[name](spark, SF).collect():
            inds.setdefault(r.key, set()).add(name)
            polys[r.key] = polys.get(r.key, 0) + 1
    got = {r.key: r for r in QUERIES["mi_result"](spark, SF).collect()}
    assert {k: (r.inds, r.polys) for k, r in got.items()} == {k: (len(inds.get(k, ())), polys.get(k, 0)) for k in got}
    written = [r.weight for k, r in got.items() if "ind_coordinate" in inds.get(k, ())]
    assert written and min(written) >= 0.75 * 2.72 - 1e-6


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
