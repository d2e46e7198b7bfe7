"""Physical plans of the registered queries and of the operators over stored tables."""

import re

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import lookup, merges, paging, progress
from tallyloom.plans.catalog import QUERIES
from tallyloom.plans.fixtures import fixture

FOLDER = "/root/testdata/sf0.001"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", [name for name in QUERIES if name != "step_results_stream"])
def test_no_pairs_no_python_no_single_task(spark, no_broadcast, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "Python" not in plan and "Pandas" not in plan
    # Only the scalar subquery of a fixture ends in one partition, and that after a partial minimum.
    for position in [m.start() for m in re.finditer("Exchange SinglePartition", plan)]:
        assert "partial_min(o_orderdate" in plan[position:position + 300]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stored"))
    for name in ("users", "projects", "project_requests", "results"):
        fixture(spark, FOLDER, name).write.parquet(f"{folder}/{name}")
    return lambda name: spark.read.parquet(f"{folder}/{name}")


def test_owner_filter_and_columns_reach_the_scan(stored):
    plan = plan_of(paging.project_page_one_owner(stored("projects"), "u000000000001").select("id", "created_at"))
    assert "EqualTo(user_id,u000000000001)" in plan
    assert "ReadSchema: struct<id:string,user_id:string,created_at:timestamp_ntz>" in plan
    assert "TakeOrderedAndProject" in plan


def test_lookup_reads_only_what_it_returns(stored, no_broadcast):
    plan = plan_of(lookup.project_lookup(stored("project_requests"), stored("projects"), ["status"]))
    assert "ReadSchema: struct<id:string,user_id:string,status:string>" in plan
    # One shuffle folds repeated ids, two bring both sides together so that a hot one can be split.
    assert plan.count("Exchange") == 3


def test_totals_do_not_shuffle_rows(spark, stored, no_broadcast):
    plan = plan_of(paging.project_count_by_owner(stored("users"), stored("projects")))
    assert "partial_count(id" in plan
    # The counts are partitioned by owner already; one more shuffle brings the users.
    assert plan.count("Exchange") == 2


def test_audited_outcomes_leave_the_tables_other_columns_alone(stored, no_broadcast):
    as_of = F.lit("2024-01-01").cast("timestamp_ntz")
    plan = plan_of(merges.run_transition(stored("projects"), stored("project_requests"), as_of)[1])
    assert "ReadSchema: struct<id:string,user_id:string>" in plan
    assert "metadata" not in plan


def test_retention_filters_in_the_scan(stored):
    as_of = F.lit("2024-01-30").cast("timestamp_ntz")
    plan = plan_of(progress.retained_results(stored("results"), as_of))
    assert "GreaterThanOrEqual(ts,2024-01-29T00:00)" in plan


def test_progress_of_all_steps_takes_one_shuffle(stored):
    assert plan_of(progress.step_status_json(stored("results"), ["ts", "event_id"])).count("Exchange") == 1
