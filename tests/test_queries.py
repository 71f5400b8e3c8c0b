"""Every query: equal to its SQL where it has one, else it runs and keeps its columns."""

import pytest
from oracle import connect, same

from corpusmill.plans import queries_core, queries_more, queries_pipelines  # noqa: F401
from corpusmill.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal_to_sql(spark, con, name):
    same(QUERIES[name](spark, SF), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.collect() is not None


def test_search_and_iteration_take_all_rows(spark, monkeypatch):
    from corpusmill.plans import pipelines
    from corpusmill.plans.views import Views

    names = {r["p_name"] for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    assert len(names) > 50 and {r["theorem"] for r in QUERIES["ext06_search"](spark, SF).select("theorem").distinct().collect()} == names
    given = []
    monkeypatch.setattr(pipelines, "expert_iteration", lambda problems, whole=pipelines.expert_iteration: given.append(problems) or whole(problems))
    assert QUERIES["pip01_expert_iteration"](spark, SF).count() == 1
    assert given[0].count() == Views(spark, SF).problems.count()
