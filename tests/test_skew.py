"""One key holds a third of all rows: joins get split, row numbers need no task per group."""

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.operators import access, joins, lookup, merges, paging
from tallyloom.operators.ranking import split_rank

N = 60_000
NEWEST = {"created_at": True, "id": False}


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """Users, projects, files and requests in which number 7 has a third of everything."""
    folder = tmp_path_factory.mktemp("hot")
    number = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000)
    base = spark.range(0, N, 1, 8).select("id", number.alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))
    frames = {
        "users": spark.range(0, 1000, 1, 4).selectExpr(
            "'u' || id as id", "'m' || id as email", "'name' as full_name", "cast(null as string) as avatar_url",
            "'g' || id as google_id", "id % 5 <> 0 as is_active", "timestamp_ntz'2024-01-01' as created_at",
            "timestamp_ntz'2024-01-01' as updated_at"),
        "projects": base.selectExpr(
            "'p' || id as id", "'u' || n as user_id", "pad as name", "cast(null as string) as description",
            "'fine_tune' as execution_type", "'created' as status", "0 as num_files",
            "'{\"base_model\":1}' as metadata", "'{}' as pipeline_status", "pad as error_message",
            "case when id % 4 <> 0 then timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, cast(id % 50 as int)) end as created_at",
            "timestamp_ntz'2024-01-01' as updated_at"),
        "requests": base.selectExpr(
            "id as seq", "'p' || n as project_id", "case when n = 7 or n % 3 = 0 then 'u7' else 'u' || n end as user_id",
            "'{\"status\":\"' || id || '\"}' as patch", "pad"),
    }
    for name, frame in frames.items():
        frame.write.parquet(f"{folder}/{name}")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in frames}


@pytest.fixture
def small_partitions(spark):
    """Skew thresholds fit for small data, and no broadcast joins."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "8KB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def final_plan(frame):
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def splits(frame):
    return "skew=true" in final_plan(frame)


def test_joins_are_split(spark, hot, small_partitions):
    users, projects, requests = hot["users"], hot["projects"], hot["requests"]
    as_of = F.lit("2024-02-01").cast("timestamp_ntz")
    files = projects.selectExpr("user_id as project_id", "name as r2_key", "'f' as filename", "'d' as folder",
                                "1L as file_size", "'t' as content_type")
    parents = users.selectExpr("id", "email as name")
    assert splits(joins.project_owner(projects, users))
    assert splits(joins.user_projects(users, projects))
    assert splits(joins.project_files_join(parents, files))
    assert splits(lookup.project_lookup(requests, projects, ["name"]))
    assert splits(lookup.user_by_id(requests, users, ["email"]))
    by_email = requests.withColumn("email", F.concat(F.lit("m"), F.substring("user_id", 2, 9)))
    assert splits(lookup.user_by_email(by_email, users, ["full_name"]))
    assert splits(lookup.download_key_audit(requests.withColumn("r2_key", F.col("pad")), projects))
    assert splits(merges.project_patch(projects, requests, as_of)[1])
    assert splits(merges.project_delete(projects, files, requests)[2])
    assert splits(merges.user_cascade_delete(users, projects, files, requests)[1])
    assert splits(merges.run_transition(projects, requests, as_of)[1])
    listing = requests.selectExpr("concat(user_id, '/projects/', project_id, '/Data/', pad) as key", "1L as size",
                                  "timestamp'2024-01-01' as last_modified")
    folders = requests.selectExpr("user_id", "project_id", "'Data' as folder")
    owned = requests.selectExpr("user_id", "project_id as id").distinct()
    assert splits(lookup.object_listing(folders, owned, listing))
    claims = requests.selectExpr("seq as event_id", "user_id as sub", "'access' as token_type", "false as expired", "pad")
    assert splits(access.access_outcomes(claims, users))


def test_upsert_with_one_busy_account(spark, hot, small_partitions):
    profiles = hot["requests"].selectExpr(
        "seq", "replace(user_id, 'u', 'g') as sub", "replace(user_id, 'u', 'm') as email",
        "'name ' || seq as name", "pad as picture", "cast(null as string) as new_id")
    table, outcomes = merges.user_upsert(hot["users"], profiles, F.lit("2024-02-01").cast("timestamp_ntz"))
    assert splits(outcomes)
    counts = dict(rows(outcomes.groupBy("outcome").count()))
    accounts = profiles.select("sub").distinct().count()
    assert counts == {"updated": accounts, "superseded": N - accounts}
    last = profiles.where("sub = 'g7'").agg(F.max("seq")).first()[0]
    assert table.where("id = 'u7'").first().full_name == f"name {last}"


def test_split_rank_equals_window(spark, hot, small_partitions):
    projects = hot["projects"].select("user_id", "id", "created_at")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(*paging.newest_first()))
    expected = projects.withColumn("rn", place.cast("bigint"))
    ranked = split_rank(projects, ["user_id"], NEWEST)
    assert ranked.count() == N
    assert ranked.exceptAll(expected).isEmpty()


def test_split_rank_cuts_the_hot_group(spark, hot, small_partitions):
    from tallyloom.operators.ranking import cut_points
    cuts = {row.user_id: row._cuts for row in cut_points(hot["projects"], ["user_id"], NEWEST)[0].collect()}
    assert len(cuts["u7"]) > 3
    assert sum(map(len, cuts.values())) <= 2 * 16


def test_split_rank_shuffles_rows_once(spark, hot, small_partitions):
    plan = split_rank(hot["projects"], ["user_id"], NEWEST)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(user_id") - plan.count("partial_count") * 2 <= 1
    assert "Exchange rangepartitioning" not in plan


@pytest.mark.parametrize("seed, n", [(1, 0), (2, 1), (3, 5), (4, 40), (5, 400), (6, 3000)])
def test_split_rank_over_many_pieces(spark, seed, n):
    """Groups from single rows to ones that cover several pieces, and pieces without rows."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        frame = spark.range(n).select(
            "id", F.expr(f"nullif(int(sqrt(abs(hash(id, {seed})) % 64)), 3)").alias("k"),
            F.expr(f"abs(hash(id, {seed}, 1)) % 100").alias("v"))
        order = [F.col("v").desc_nulls_first(), F.col("id").asc_nulls_first()]
        expected = frame.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(*order)).cast("bigint"))
        assert rows(split_rank(frame, ["k"], {"v": True, "id": False})) == rows(expected)
        assert rows(split_rank(frame, ["k", "v"], {"id": False})) == rows(
            frame.withColumn("rn", F.row_number().over(Window.partitionBy("k", "v").orderBy("id")).cast("bigint")))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_split_rank_keeps_null_keys_and_ties(spark):
    frame = spark.createDataFrame([(None, 1), (None, 2), ("a", 1), ("a", 1), ("b", 5)], "k string, v int")
    ranked = split_rank(frame, ["k"], {"v": False})
    assert rows(ranked) == sorted([(None, 1, 1), (None, 2, 2), ("a", 1, 1), ("a", 1, 2), ("b", 5, 1)], key=repr)


@pytest.mark.parametrize("skip, limit", [(0, 10), (40, 50), (95, 30), (15000, 5000)])
def test_pages_of_a_hot_owner(spark, hot, skip, limit):
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(*paging.newest_first()))
    expected = (hot["projects"].withColumn("rn", place.cast("bigint"))
                .where((F.col("rn") > skip) & (F.col("rn") <= skip + limit)).select("user_id", "rn", "id"))
    page = paging.project_page_all_owners(hot["projects"], skip, limit).select("user_id", "rn", "id")
    assert rows(page) == rows(expected)


@pytest.mark.parametrize("skip", [10, 12_345])
def test_page_of_one_hot_owner(hot, skip):
    own = hot["projects"].where("user_id = 'u7'")
    expected = own.orderBy(*paging.newest_first()).offset(skip).limit(20).select("id").collect()
    assert paging.project_page_one_owner(hot["projects"], "u7", skip, 20).select("id").collect() == expected


def test_shallow_page_limits_before_the_shuffle(spark, hot):
    plan = paging.project_page_all_owners(hot["projects"], 5, 10)._jdf.queryExecution().executedPlan().toString()
    below_shuffle = plan[plan.index("Exchange"):]
    assert "WindowGroupLimit" in below_shuffle


def test_deletes_start_no_job_while_they_are_built(spark, hot):
    spark.sparkContext.setJobGroup("building", "building")
    try:
        files = hot["projects"].selectExpr("id as project_id", "name as r2_key")
        requests = hot["requests"].select("seq", "project_id", "user_id")
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("building"))
        merges.project_delete(hot["projects"], files, requests)
        merges.user_cascade_delete(hot["users"], hot["projects"], files, requests)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("building")) == before
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_hot_owner_sends_few_rows_to_one_task(spark, hot):
    """With many map tasks, what meets in the numbering task is bounded by buckets and page."""
    leading = paging._leading(hot["projects"].repartition(64), 15)
    assert leading.where("user_id = 'u7'").count() <= 15 * paging.BUCKETS


@pytest.mark.parametrize("limit", [99, 100, 101, 5000])
def test_all_depths_agree_on_repeated_and_missing_ids(spark, limit):
    projects = spark.createDataFrame(
        [("p1", "u1", 1), ("p1", "u1", 1), ("p2", "u1", 2), (None, "u1", 3)], "id string, user_id string, d int").selectExpr(
        "id", "user_id", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, d) as created_at")
    expected = [("p1", 3), ("p1", 4), ("p2", 2), (None, 1)]
    assert rows(paging.project_page_all_owners(projects, 0, limit), "id", "rn") == sorted(expected, key=repr)
    assert [r.id for r in paging.project_page_one_owner(projects, "u1", 0, limit).collect()] == [None, "p2", "p1", "p1"]
