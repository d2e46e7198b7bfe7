"""Lookups, keys, joins, pages, rules and access on hand-written rows."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyloom.functions import keys as K
from tallyloom.functions import rules as R
from tallyloom.operators import access, audits, joins, lookup, paging, progress


def day(n):
    return dt.datetime(2024, 1, n)


@pytest.fixture(scope="module")
def projects(spark):
    return spark.createDataFrame(
        [("p1", "u1", "a", day(1)), ("p2", "u1", "b", None), ("p3", "u1", "c", day(2)), ("p4", "u1", "d", day(2)),
         ("p5", "u2", "e", day(3))],
        "id string, user_id string, name string, created_at timestamp")


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame(
        [("u1", "a@x.org", True), ("u2", "b@x.org", False), ("u3", "b@x.org", None)],
        "id string, email string, is_active boolean")


def test_foreign_and_missing_projects_look_alike(spark, projects):
    asked = spark.createDataFrame([(1, "p1", "u1"), (2, "p1", "u2"), (3, "p9", "u1"), (4, None, "u1")],
                                  "seq int, project_id string, user_id string")
    found = lookup.project_lookup(asked, projects, ["name"])
    assert rows(found, "seq", "name", "result") == [
        (1, "a", "found"), (2, None, "missing"), (3, None, "missing"), (4, None, "missing")]


def test_email_lookup_is_exact_and_at_most_one(spark, users):
    asked = spark.createDataFrame([(1, "a@x.org"), (2, "A@x.org"), (3, "b@x.org")], "seq int, email string")
    found = lookup.user_by_email(asked, users.withColumnRenamed("id", "user_id"), ["user_id"])
    assert rows(found, "seq", "user_id", "result") == [(1, "u1", "found"), (2, None, "missing"), (3, None, "ambiguous")]
    assert rows(lookup.lookup_ambiguity(users, "email")) == [("a@x.org", 1, False), ("b@x.org", 2, True)]


def test_key_check_is_containment_and_404_comes_first(spark, projects):
    asked = spark.createDataFrame([
        (1, "p1", "u1", "u1/projects/p1/Data/f"), (2, "p1", "u1", "somewhere-p1-and-u1"), (3, "p1", "u1", "u1/projects/p2/f"),
        (4, "p1", "u2", "u2/projects/p1/f"), (5, "p9", "u1", "u1/projects/p9/f")],
        "seq int, project_id string, user_id string, r2_key string")
    assert rows(lookup.download_key_audit(asked, projects), "seq", "code") == [
        (1, 200), (2, 200), (3, 403), (4, 404), (5, 404)]


def test_keys_build_and_parse(spark):
    parts = spark.createDataFrame(
        [("u", "p", "Data", "a/b.txt"), ("u", "p", None, "a"), ("u", "p", "Data", "")],
        "u string, p string, folder string, filename string")
    built = parts.select(K.object_key(F.col("u"), F.col("p"), F.col("folder"), F.col("filename")).alias("key"))
    assert rows(built) == sorted([("u/projects/p/Data/a/b.txt",), (None,), ("u/projects/p/Data/",)], key=repr)
    more = spark.createDataFrame([("x",), ("u/project/p/Data/f",), ("u/projects/p/f",), ("line\n/projects/p/Data/f\ng",)], "key string")
    assert rows(lookup.object_key_parts(built.union(more))) == sorted([
        ("u/projects/p/Data/a/b.txt", "u", "p", "Data", "a/b.txt", True),
        ("u/projects/p/Data/", "u", "p", "Data", "", True),
        (None, None, None, None, None, None),
        ("x", None, None, None, None, False),
        ("u/project/p/Data/f", None, None, None, None, False),
        ("u/projects/p/f", None, None, None, None, False),
        ("line\n/projects/p/Data/f\ng", "line\n", "p", "Data", "f\ng", True)], key=repr)


def test_listing_keeps_subfolders_skips_marker_strips_every_prefix(spark):
    prefix = "u/projects/p/Data/"
    listing = spark.createDataFrame(
        [(prefix, 0), (prefix + "a", 1), (prefix + "sub/b", 2), (prefix + prefix + "c", 3),
         ("u/projects/p/Database/d", 4), ("u/projects/p/Output/e", 5), ("v/projects/p/Data/f", 6), ("top", 7)],
        "key string, size int").withColumn("last_modified", F.lit(day(1)))
    asked = spark.createDataFrame(
        [("u", "p", "Data"), ("u", "p", None), ("u", "p", "Data/sub"), ("v", "p", "Data"), ("u", "q", "Data")],
        "user_id string, project_id string, folder string")
    owned = spark.createDataFrame([("p", "u")], "id string, user_id string")
    assert rows(lookup.object_listing(asked, owned, listing), "folder", "filename", "size") == [
        ("Data", "a", 1), ("Data", "c", 3), ("Data", "sub/b", 2), ("Data/sub", "b", 2)]


def test_uploads_need_an_owned_project(spark, projects):
    asked = spark.createDataFrame([(1, "p1", "u1", "Data", "f"), (2, "p1", "u2", "Data", "f"), (3, "p9", "u1", "Data", "f")],
                                  "seq int, project_id string, user_id string, folder string, filename string")
    assert rows(lookup.upload_keys(asked, projects), "seq", "r2_key", "expires_in", "code") == [
        (1, "u1/projects/p1/Data/f", 3600, 200), (2, None, None, 404), (3, None, None, 404)]


def test_project_view_splits_incomplete_rows(spark):
    frame = spark.createDataFrame(
        [("p1", 0, day(1)), ("p2", None, None)], "id string, num_files int, created_at timestamp").selectExpr(
        "id", "'u' as user_id", "'n' as name", "null as description", "'fine_tune' as execution_type",
        "'created' as status", "num_files", "'{}' as metadata", "'{}' as pipeline_status", "null as error_message",
        "created_at", "created_at as updated_at")
    view, rejects = lookup.project_view(frame)
    assert rows(view, "id", "metadata_") == [("p1", "{}")]
    assert rows(rejects) == [("p2", "created_at"), ("p2", "num_files"), ("p2", "updated_at")]


def test_outer_joins_keep_parents(spark, projects, users):
    files = spark.createDataFrame([("p1", "k1"), ("p1", "k2"), ("p9", "k3")], "project_id string, r2_key string").selectExpr(
        "*", "'f' as filename", "'d' as folder", "1L as file_size", "'t' as content_type")
    assert rows(joins.user_projects(users, projects.withColumn("status", F.lit("s"))), "user_id", "project_id") == sorted([
        ("u1", "p1"), ("u1", "p2"), ("u1", "p3"), ("u1", "p4"), ("u2", "p5"), ("u3", None)], key=repr)
    assert rows(joins.project_files_join(projects, files), "project_id", "r2_key") == sorted([
        ("p1", "k1"), ("p1", "k2"), ("p2", None), ("p3", None), ("p4", None), ("p5", None)], key=repr)
    assert rows(paging.project_num_files(projects, files)) == [("p1", 2), ("p2", 0), ("p3", 0), ("p4", 0), ("p5", 0)]
    assert rows(paging.project_count_by_owner(users, projects)) == [("u1", 4), ("u2", 1), ("u3", 0)]


def test_pages_put_undated_first_and_break_ties_by_id(projects):
    order = [row.id for row in paging.project_page_one_owner(projects, "u1").collect()]
    assert order == ["p2", "p3", "p4", "p1"]
    assert [row.id for row in paging.project_page_one_owner(projects, "u1", 1, 2).collect()] == ["p3", "p4"]


@pytest.mark.parametrize("limit", [1, 2, 3])
def test_pages_add_up_to_the_whole_list(projects, limit):
    seen = []
    for skip in range(0, 5, limit):
        seen += rows(paging.project_page_all_owners(projects, skip, limit).where("user_id = 'u1'"), "rn", "id")
    assert seen == [(1, "p2"), (2, "p3"), (3, "p4"), (4, "p1")]


def test_envelope_keeps_users_whose_page_is_empty(users, projects):
    page = paging.project_page_envelope(users, projects.withColumn("status", F.lit("s")), 2, 2)
    assert rows(page, "user_id", "total", "page", "size", "project_id") == sorted([
        ("u1", 4, 2, 2, "p4"), ("u1", 4, 2, 2, "p1"), ("u2", 1, 2, 2, None), ("u3", 0, 2, 2, None)], key=repr)


@pytest.mark.parametrize("skip, limit", [(0, 0), (-1, 10), (0, -5)])
def test_bad_pages_are_refused(users, projects, skip, limit):
    for page in (lambda: paging.project_page_all_owners(projects, skip, limit),
                 lambda: paging.project_page_one_owner(projects, "u1", skip, limit),
                 lambda: paging.project_page_envelope(users, projects, skip, limit)):
        with pytest.raises(ValueError, match="limit"):
            page()


def test_first_failing_rule_wins_and_null_values_count_as_present(spark):
    frame = spark.createDataFrame([
        ("1", "other", "{}"), ("2", None, "{}"), ("3", "dataset_generation", '{"gen_model":null,"min_samples":null}'),
        ("4", "dataset_generation", "{}"), ("5", "dataset_generation", '{"gen_model":1}'), ("6", "fine_tune", None),
        ("7", "fine_tune", '{"base_model":{}}'), ("8", "dataset_and_fine_tune", '{"gen_model":1,"min_samples":2}'),
        ("9", "full_pipeline", '{"base_model":3,"min_samples":2,"gen_model":1}'), ("a", "fine_tune", '["base_model"]'),
        ("b", "fine_tune", "bad json"),
        ("c", "full_pipeline", '{"base_model":3,"min_samples":2,"gen_model":1,"deploy_instance_type":""}')],
        "id string, execution_type string, metadata string")
    checked = audits.metadata_validation(frame)
    assert rows(checked, "project_id", "error_code") == [
        ("1", "invalid_execution_type"), ("2", "invalid_execution_type"), ("3", None), ("4", "missing_gen_model"),
        ("5", "missing_min_samples"), ("6", "missing_base_model"), ("7", None), ("8", "missing_base_model"),
        ("9", "missing_deploy_instance_type"), ("a", "missing_base_model"), ("b", "missing_base_model"), ("c", None)]
    messages = dict(rows(checked, "project_id", "message"))
    assert messages["1"] == ("Invalid execution type. Must be one of: "
                             "['dataset_generation', 'fine_tune', 'dataset_and_fine_tune', 'full_pipeline']")
    assert messages["9"] == "Missing 'deploy_instance_type' in metadata for deployment"
    assert messages["3"] is None
    assert dict(rows(audits.metadata_error_counts(frame)))["ok"] == 3


def test_constraint_audits(spark):
    users = spark.createDataFrame(
        [("u1", "e", "n", "g1"), ("u1", "e" * 256, "n", "g2"), ("u2", None, "n" * 255, "g2"), ("u3", None, None, None)],
        "id string, email string, full_name string, google_id string")
    projects = spark.createDataFrame([("p1", "u1"), ("p2", "u9"), ("p3", None)], "id string, user_id string")
    files = spark.createDataFrame([("p1", "k", "f1"), ("p9", "k", "f2"), ("p9", "l", "f3")],
                                  "project_id string, r2_key string, id string")
    tables = {"users": users, "projects": projects, "project_files": files}
    assert rows(audits.fk_orphans(tables)) == [
        ("project_files", "project_id", "p9"), ("project_files", "project_id", "p9"), ("projects", "user_id", "u9")]
    assert rows(audits.unique_violations(tables)) == [
        ("project_files", "r2_key", "k", 2), ("users", "google_id", "g2", 2), ("users", "id", "u1", 2)]
    assert rows(audits.column_rule_violations(users, "users"), "row_id", "rule") == [
        ("u1", "email:max_255"), ("u2", "email:not_null"), ("u3", "email:not_null"),
        ("u3", "full_name:not_null"), ("u3", "google_id:not_null")]


def test_email_format(spark):
    mails = ["a@b.c", "a.b+c@d.e.f", "a@b", "@b.c", "a@@b.c", "a b@c.d", "a@b.", "", None]
    frame = spark.createDataFrame([(str(i), m) for i, m in enumerate(mails)], "id string, email string")
    assert [valid for _, valid in rows(audits.email_format(frame), "id", "valid")] == [True, True] + [False] * 7


def test_access_and_refresh_treat_inactive_users_differently(spark, users):
    claims = spark.createDataFrame([
        (1, "u1", "access", False), (2, "u1", "access", True), (3, None, "access", False), (4, "u1", "refresh", False),
        (5, "u9", "access", False), (6, "u2", "access", False), (7, "u3", "access", False), (8, "u1", None, False),
        (9, "u2", "refresh", False), (10, "u9", "refresh", False), (11, None, "refresh", False), (12, "u1", "refresh", True)],
        "event_id int, sub string, token_type string, expired boolean")
    assert rows(access.access_outcomes(claims, users).orderBy("event_id"), "event_id", "code") == sorted([
        (1, 200), (2, 401), (3, 401), (4, 401), (5, 401), (6, 400), (7, 400), (8, 401), (9, 401), (10, 401),
        (11, 401), (12, 401)], key=repr)
    assert rows(access.refresh_outcomes(claims, users), "event_id", "code") == sorted([
        (1, 400), (2, 401), (3, 400), (4, 200), (5, 400), (6, 400), (7, 400), (8, 400), (9, 401), (10, 401),
        (11, 401), (12, 401)], key=repr)


def test_token_expiry(spark):
    noon = dt.datetime(2024, 1, 8, 12, 0, 0)
    tokens = spark.createDataFrame([
        (1, "access", noon - dt.timedelta(minutes=60)), (2, "access", noon - dt.timedelta(minutes=60, seconds=1)),
        (3, "refresh", noon - dt.timedelta(days=7)), (4, "refresh", noon - dt.timedelta(days=7, microseconds=1)),
        (5, "other", noon)], "event_id int, token_type string, issued_at timestamp")
    checked = access.token_expiry(tokens, F.lit(noon + dt.timedelta(milliseconds=900)))
    assert rows(checked, "event_id", "expired") == [(1, False), (2, True), (3, False), (4, True), (5, None)]


def test_stage_plan(spark):
    frame = spark.createDataFrame([("1", "full_pipeline"), ("2", "fine_tune"), ("3", "dataset_generation"), ("4", "?"), ("5", None)],
                                  "id string, execution_type string")
    plan = {}
    for project, _, step in rows(progress.stage_plan(frame), "project_id", "pos", "step"):
        plan.setdefault(project, []).append(step)
    first = ["validate_data", "ocr_extraction", "chunk_data"]
    assert plan == {"1": first + ["generate_dataset", "fine_tune", "deploy_model"], "2": first + ["fine_tune"],
                    "3": first + ["generate_dataset"], "4": first, "5": first}


def test_progress(spark):
    results = spark.createDataFrame([
        ("1", "validate_data", "failure", day(1), 1), ("1", "validate_data", "success", day(2), 2),
        ("1", "ocr_extraction", "success", day(1), 3), ("1", "chunk_data", "failure", day(3), 4),
        ("1", "chunk_data", "success", day(3), 5), ("2", "validate_data", "failure", day(1), 6),
        ("3", "deploy_model", "failure", day(1), 7)],
        "project_id string, step string, status string, ts timestamp, event_id int")
    order = ["ts", "event_id"]
    assert rows(progress.latest_step_result(results, order), "project_id", "step", "status") == [
        ("1", "chunk_data", "success"), ("1", "ocr_extraction", "success"), ("1", "validate_data", "success"),
        ("2", "validate_data", "failure"), ("3", "deploy_model", "failure")]
    assert dict(rows(progress.step_status_json(results, order)))["1"] == (
        '{"validate_data":"success","ocr_extraction":"success","chunk_data":"success"}')
    # A step outside the plan does not count, and a project without results is under way.
    projects = spark.createDataFrame([("1", "none"), ("2", "none"), ("3", "none"), ("4", "none")], "id string, execution_type string")
    assert rows(progress.project_outcome(projects, results, order)) == [
        ("1", "completed"), ("2", "failed"), ("3", "processing"), ("4", "processing")]
    assert rows(progress.retained_results(results, F.lit(day(3))), "event_id") == [(2,), (4,), (5,)]


def test_blank_means_null_or_empty(spark):
    frame = spark.createDataFrame([(None,), ("",), (" ",)], "t string")
    assert rows(frame.select(R.is_blank(F.col("t")))) == [(False,), (True,), (True,)]
