"""What grows with the tables: bytes shuffled, rows sorted, rows in one task."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyloom.operators import joins, lookup, merges
from tallyloom.plans import catalog

N = 60_000


@pytest.fixture
def no_broadcast(spark):
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for key in keys:
        spark.conf.set(key, "-1")
    yield
    for key in keys:
        spark.conf.unset(key)


def shuffled(spark, frame):
    """Bytes that the tasks of ``frame`` write for shuffles."""
    context = spark.sparkContext._jsc.sc()

    def so_far():
        context.listenerBus().waitUntilEmpty(30_000)
        return context.statusStore().executorSummary("driver").totalShuffleWrite()

    before = so_far()
    frame.write.format("noop").mode("overwrite").save()
    return so_far() - before


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Users with ten projects of ten files each; keys are hashes, so that wide rows stay wide when compressed."""
    folder = tmp_path_factory.mktemp("scale")
    pad = "concat(sha2(cast(id as string), 512), sha2(cast(-id as string), 512))"
    frames = {
        "users": spark.range(N // 100).selectExpr("'u' || id as id", "'m' || id as email"),
        "projects": spark.range(N // 10).selectExpr("'p' || id as id", "'u' || id div 10 as user_id", "'n' || id as name"),
        "files": spark.range(N).selectExpr("'p' || id div 10 as project_id", f"{pad} as r2_key", "'f' as filename",
                                           "'d' as folder", "id as file_size", "'t' as content_type"),
    }
    for name, frame in frames.items():
        frame.write.parquet(f"{folder}/{name}")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in frames}


# Hexadecimal digits take half a byte when compressed.
WIDE = N * 128


def test_files_of_projects_that_stay_are_not_shuffled(spark, tables, no_broadcast):
    requests = tables["projects"].where("name like 'n%7'").selectExpr("1L as seq", "id as project_id", "user_id")
    left = merges.project_delete(tables["projects"], tables["files"], requests)[1]
    assert shuffled(spark, left) < WIDE / 2
    gone = requests.select("project_id")
    assert rows(left, "file_size") == rows(tables["files"].join(gone, "project_id", "left_anti"), "file_size")


def test_files_of_users_that_stay_are_not_shuffled(spark, tables, no_broadcast):
    requests = tables["users"].where("id like '%7'").selectExpr("id as user_id")
    left = merges.user_cascade_delete(tables["users"], tables["projects"], tables["files"], requests)[2]
    assert shuffled(spark, left) < WIDE / 2
    gone = tables["projects"].join(requests, "user_id").selectExpr("id as project_id")
    assert rows(left, "file_size") == rows(tables["files"].join(gone, "project_id", "left_anti"), "file_size")


def test_objects_nobody_asks_for_are_not_shuffled(spark, tables, no_broadcast):
    listing = tables["files"].selectExpr("concat('u', file_size div 100, '/projects/', project_id, '/d/', r2_key) as key",
                                         "file_size as size", "1 as last_modified")
    requests = tables["projects"].where("name like 'n%7'").selectExpr("user_id", "id as project_id", "'d' as folder")
    found = lookup.object_listing(requests, tables["projects"], listing)
    assert shuffled(spark, found) < WIDE / 2
    asked = requests.select("project_id")
    assert rows(found, "size") == rows(tables["files"].join(asked, "project_id", "left_semi"), "file_size")


def test_files_are_not_sorted_to_meet_their_projects(tables, no_broadcast):
    joined = joins.project_files_join(tables["projects"], tables["files"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2 and "Sort" not in plan


def test_arrivals_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    kept = []
    monkeypatch.setattr(catalog, "remove_folder", lambda _, path: kept.append(path))
    out = catalog.QUERIES["step_results_stream"](spark, str(tmp_path))
    assert rows(out) == rows(catalog.QUERIES["step_results_stream"](spark, "/root/testdata/sf0.001"))
    for number in range(catalog.ARRIVALS):
        assert spark.read.parquet(f"{kept[0]}/in/{number}").select(F.input_file_name()).distinct().count() > 1
