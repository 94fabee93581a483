"""Every registered query against its DuckDB text on the smallest tables."""

import pytest

from compare import compare, duck
from weftgraph.plans import catalog

SF = "/root/testdata/sf0.001"
RUNS, TEXTS = catalog.load()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(RUNS))
def test_query(spark, con, name):
    assert name in TEXTS or name == "approximate_topk"
    problem = compare(spark, con, RUNS[name], TEXTS.get(name), SF)
    assert problem in (None, "no rows"), problem
