"""Merges on hand-written rows."""

import datetime as dt
from random import Random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyloom.operators import access, audits, lookup, merges
from tallyloom.schemas import PROJECT_FILES, PROJECTS, USERS

OLD, NEW = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)


def as_of():
    return F.lit(NEW)


def project(number, owner="u1", kind="fine_tune", metadata='{"base_model":1}', status="created"):
    return (f"p{number}", owner, f"name{number}", "about", kind, status, 0, metadata, "{}", None, OLD, OLD)


def user(number, email=None, active=True, avatar="a"):
    return (f"u{number}", email or f"m{number}", f"name{number}", avatar, f"g{number}", active, OLD, OLD)


@pytest.fixture(scope="module")
def projects(spark):
    return spark.createDataFrame([project(1), project(2), project(3, "u2"), project(4, metadata=None)], PROJECTS)


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([user(1), user(2, active=False), user(3)], USERS)


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(
        [(f"f{i}", p, "n", f"k{i}", "Data", 1, None, OLD, OLD) for i, p in enumerate(["p1", "p1", "p2", "p3"])],
        PROJECT_FILES)


def test_create(spark, projects):
    asked = spark.createDataFrame([
        (1, "n1", "u1", "a", None, "fine_tune", '{"base_model":null}'), (2, "n2", "u1", "b", None, "fine_tune", None),
        (3, "n3", "u1", "c", None, "other", '{"base_model":1}'), (4, "n4", "u1", None, None, "fine_tune", '{"base_model":1}'),
        (5, "n5", "u1", "e", None, "fine_tune", "[1]"), (6, "n6", "u1", "f", None, None, "{}"),
        (7, "n7", "u1", "x" * 256, None, "fine_tune", '{"base_model":1}')],
        "seq int, id string, user_id string, name string, description string, execution_type string, metadata string")
    table, outcomes = merges.project_create(projects, asked, as_of())
    assert rows(outcomes, "seq", "outcome", "code") == [
        (1, "created", 201), (2, "invalid:missing_base_model", 400), (3, "invalid:invalid_execution_type", 400),
        (4, "unprocessable", 422), (5, "unprocessable", 422), (6, "unprocessable", 422), (7, "error_too_long", 500)]
    assert table.columns == projects.columns and table.count() == 5
    new = table.where("id = 'n1'").first()
    assert (new.status, new.num_files, new.metadata, new.pipeline_status, new.created_at) == (
        "created", 0, '{"base_model":null}', "{}", NEW)


PROFILE = "seq int, sub string, email string, name string, picture string, new_id string"


def upsert(spark, users, profiles):
    table, outcomes = merges.user_upsert(users, spark.createDataFrame(profiles, PROFILE), as_of())
    return table, [outcome for _, outcome in sorted(rows(outcomes, "seq", "outcome"))]


def test_upsert_outcomes(spark, users):
    table, outcomes = upsert(spark, users, [
        (1, None, "m9", "n", None, None), (2, "", "m9", "n", None, None), (3, "g1", "", "n", None, None),
        (4, "g1", "m1", "name1", "a", None),                      # nothing new
        (5, "g2", "m2", "name2", None, None),                     # avatar goes, still inactive
        (6, "g9", "m9", "nine", "pic", "u9"),                     # new
        (7, "g8", "m8", None, "pic", "u8"),                       # no name
        (8, "g" * 256, "m7", "n", "pic", "u7"),
    ])
    assert outcomes == ["incomplete"] * 3 + ["noop", "updated", "inserted", "error_not_null", "error_too_long"]
    assert table.columns == ["id", "email", "full_name", "avatar_url", "google_id", "is_active", "created_at", "updated_at"]
    got = {row.id: row for row in table.collect()}
    assert set(got) == {"u1", "u2", "u3", "u9"}
    assert got["u1"].updated_at == OLD and got["u3"].updated_at == OLD
    assert (got["u2"].avatar_url, got["u2"].is_active, got["u2"].updated_at, got["u2"].created_at) == (None, False, NEW, OLD)
    assert (got["u9"].email, got["u9"].is_active, got["u9"].created_at) == ("m9", True, NEW)


def test_upsert_takes_the_last_profile_and_guards_emails(spark, users):
    table, outcomes = upsert(spark, users, [
        (1, "g1", "m1", "first", "a", None), (2, "g1", "m1", "second", "a", None),
        (3, "g2", "m3", "name2", "a", None),                      # held by u3
        (4, "g3", "fresh", "name3", "a", None),
        (5, "g7", "fresh", "n", "a", "u7"),                       # g3 was first
        (6, "g8", "m2", "n", "a", "u8"),                          # held by u2
    ])
    assert outcomes == ["superseded", "updated", "email_conflict", "updated", "email_conflict", "email_conflict"]
    assert rows(table, "id", "email", "full_name") == [
        ("u1", "m1", "second"), ("u2", "m2", "name2"), ("u3", "fresh", "name3")]
    assert table.groupBy("email").count().where("count > 1").isEmpty()


def test_upsert_twice_changes_nothing_the_second_time(spark, users):
    profiles = [(1, "g1", "m1", "x", None, None), (2, "g5", "m5", "y", "p", "u5"), (3, "g3", "m33", "z", "p", None)]
    table, _ = upsert(spark, users, profiles)
    again, outcomes = upsert(spark, table, profiles)
    assert outcomes == ["noop"] * 3
    assert rows(again, *sorted(table.columns)) == rows(table, *sorted(table.columns))


def test_shared_email_that_does_not_change_is_no_conflict(spark):
    shared = spark.createDataFrame([user(1, "same"), user(2, "same")], USERS)
    _, outcomes = upsert(spark, shared, [(1, "g1", "same", "x", "a", None), (2, "g3", "same", "n", "a", "u3")])
    assert outcomes == ["updated", "email_conflict"]


def patch(spark, projects, patches):
    frame = spark.createDataFrame(patches, "seq int, project_id string, user_id string, patch string")
    table, outcomes = merges.project_patch(projects, frame, as_of())
    return ({row.id: row for row in table.collect()},
            [outcome for _, outcome in sorted(rows(outcomes, "seq", "outcome"))])


@pytest.mark.parametrize("body, outcome", [
    ('{"name":"x"}', "ok"),
    ('{"name":"name1"}', "noop"),
    ("{}", "noop"),
    ('{"unknown":1}', "noop"),
    ('{"name":null}', "error_not_null"),
    ('{"description":null}', "ok"),
    ('{"status":null}', "ok"),
    ('{"status":"free text"}', "ok"),
    ('{"metadata_":null}', "error_null_metadata"),
    ('{"execution_type":"other","metadata_":null}', "invalid:invalid_execution_type"),
    ('{"execution_type":null}', "invalid:invalid_execution_type"),
    ('{"execution_type":"full_pipeline"}', "invalid:missing_gen_model"),
    ('{"metadata_":{}}', "invalid:missing_base_model"),
    ('{"metadata_":{"base_model":null}}', "ok"),
    ('{"metadata_":{"base_model":1}}', "noop"),
    ('{"name":null,"metadata_":{}}', "invalid:missing_base_model"),
    ('{"name":"%s"}' % ("x" * 255), "ok"),
    ('{"name":"%s"}' % ("x" * 256), "error_too_long"),
    ('{"status":"%s"}' % ("x" * 51), "error_too_long"),
    ('{"description":"%s"}' % ("x" * 9999), "ok"),
    ('{"metadata_":[1]}', "unprocessable"),
    ("[1]", "unprocessable"),
    ("not json", "unprocessable"),
    (None, "unprocessable"),
])
def test_patch_one(spark, projects, body, outcome):
    table, outcomes = patch(spark, projects, [(1, "p1", "u1", body)])
    assert outcomes == [outcome]
    assert table["p1"].updated_at == (NEW if outcome == "ok" else OLD)
    if outcome != "ok":
        assert tuple(table["p1"]) == project(1)


def test_patch_changes_only_what_is_set(spark, projects):
    table, _ = patch(spark, projects, [(1, "p1", "u1", '{"description":null,"metadata_":{"base_model":{"a":[1,2]}},"status":"s"}')])
    got = table["p1"].asDict()
    assert (got["name"], got["description"], got["status"], got["metadata"]) == (
        "name1", None, "s", '{"base_model":{"a":[1,2]}}')
    assert tuple(table["p2"]) == project(2)


def test_patch_against_stored_null_metadata(spark, projects):
    _, outcomes = patch(spark, projects, [(1, "p4", "u1", '{"execution_type":"fine_tune"}')])
    assert outcomes == ["error_null_metadata"]
    _, outcomes = patch(spark, projects, [(1, "p4", "u1", '{"name":"x"}')])
    assert outcomes == ["ok"]


def test_one_patch_per_project_and_batch(spark, projects):
    table, outcomes = patch(spark, projects, [
        (1, "p1", "u2", '{"name":"foreign"}'), (2, "p1", "u1", '{"name":"one"}'), (3, "p1", "u1", '{"name":"two"}'),
        (4, "p9", "u1", '{"name":"x"}'), (5, "p1", "u2", '{"name":"foreign again"}')])
    assert outcomes == ["not_found", "ok", "deferred", "not_found", "not_found"]
    assert table["p1"].name == "one"


def test_user_patch(spark, users):
    patches = spark.createDataFrame([
        (1, "u1", '{"full_name":"new"}'), (2, "u1", '{"full_name":"newer"}'), (3, "u2", '{"full_name":null}'),
        (4, "u3", '{"email":"ignored"}'), (5, "u9", '{"full_name":"x"}'),
        (6, "u4", '{"full_name":"%s"}' % ("x" * 256))], "seq int, user_id string, patch string")
    table, outcomes = merges.user_patch(users.union(spark.createDataFrame([user(4)], USERS)), patches, as_of())
    assert rows(outcomes, "seq", "outcome", "code") == [
        (1, "ok", 200), (2, "deferred", None), (3, "error_not_null", 500), (4, "noop", 200), (5, "not_found", 404),
        (6, "error_too_long", 500)]
    assert rows(table, "id", "full_name", "updated_at") == [
        ("u1", "new", NEW), ("u2", "name2", OLD), ("u3", "name3", OLD), ("u4", "name4", OLD)]


def test_delete_takes_files_along_and_happens_once(spark, projects, files, users):
    asked = spark.createDataFrame(
        [(1, "p1", "u2"), (2, "p1", "u1"), (3, "p1", "u1"), (4, "p3", "u1"), (5, "p9", "u1")],
        "seq int, project_id string, user_id string")
    left, files_left, outcomes = merges.project_delete(projects, files, asked)
    assert rows(outcomes, "seq", "outcome", "code") == [
        (1, "not_found", 404), (2, "deleted", 204), (3, "not_found", 404), (4, "not_found", 404), (5, "not_found", 404)]
    assert rows(left, "id") == [("p2",), ("p3",), ("p4",)]
    assert rows(files_left, "id", "project_id") == [("f2", "p2"), ("f3", "p3")]
    tables = {"users": users, "projects": left, "project_files": files_left}
    assert audits.fk_orphans(tables).isEmpty()


def test_deactivate(spark, users):
    asked = spark.createDataFrame([(1, "u1"), (2, "u1"), (3, "u2"), (4, "u9")], "seq int, user_id string")
    table, outcomes = merges.user_deactivate(users, asked, as_of())
    assert rows(outcomes, "seq", "code") == [(1, 204), (2, 204), (3, 204), (4, 400)]
    assert rows(table, "id", "is_active", "updated_at") == [("u1", False, NEW), ("u2", False, OLD), ("u3", True, OLD)]


def test_cascade(spark, users, projects, files):
    asked = spark.createDataFrame([("u1",), ("u1",), ("u9",)], "user_id string")
    users_left, projects_left, files_left = merges.user_cascade_delete(users, projects, files, asked)
    assert rows(users_left, "id") == [("u2",), ("u3",)]
    assert rows(projects_left, "id") == [("p3",)]
    assert rows(files_left, "id") == [("f3",)]


def test_run(spark, projects):
    asked = spark.createDataFrame([(1, "p1", "u1"), (2, "p1", "u1"), (3, "p3", "u1"), (4, "p9", "u1")],
                                  "seq int, project_id string, user_id string")
    table, outcomes = merges.run_transition(projects, asked, as_of())
    assert rows(outcomes, "seq", "code") == [(1, 200), (2, 200), (3, 404), (4, 404)]
    assert rows(table, "id", "status", "updated_at") == [
        ("p1", "processing", NEW), ("p2", "created", OLD), ("p3", "created", OLD), ("p4", "created", OLD)]
    again, _ = merges.run_transition(table, asked, F.lit(dt.datetime(2024, 3, 1)))
    assert again.where("id = 'p1'").first().updated_at == NEW


def test_delete_manifest(spark):
    listing = spark.range(2500).selectExpr("'u1/projects/p1/Data/' || lpad(id, 5, '0') as key").union(
        spark.createDataFrame([("u1/projects/p1/loose",), ("u1/projects/p12/Data/x",), ("u2/projects/p1/Data/x",),
                               ("u1/projects/p1",), ("u1/other/p1/x",), ("u2/projects/p2/Data/sub/y",)], "key string"))
    asked = spark.createDataFrame([("u1", "p1"), ("u1", "p1"), ("u2", "p2"), ("u3", "p3")], "user_id string, project_id string")
    manifest = merges.delete_manifest(listing, asked)
    assert rows(manifest.groupBy("project_id", "batch").count()) == [
        ("p1", 0, 1000), ("p1", 1, 1000), ("p1", 2, 501), ("p2", 0, 1)]
    assert rows(manifest.where("batch = 2"), "key")[-1] == ("u1/projects/p1/loose",)
    assert manifest.where("batch = 1").agg(F.min("key")).first()[0].endswith("/01000")
    with pytest.raises(ValueError):
        merges.delete_manifest(listing, asked, 0)


def in_turn(users, profiles):
    """Emails and refused profiles if profiles are taken one after the other."""
    held, refused = dict(users), set()
    for seq, sub, email in sorted(profiles):
        if any(other != sub and own == email for other, own in held.items()):
            refused.add(seq)
        else:
            held[sub] = email
    return held, refused


@pytest.mark.parametrize("seed, many", [(0, 4), (1, 9), (2, 25), (3, 40)])
def test_emails_change_hands_as_in_turn(spark, seed, many):
    random = Random(seed)
    known = [(f"g{i}", f"e{i}") for i in range(4)]
    profiles = [(k, f"g{random.randrange(7)}", f"e{random.randrange(6)}") for k in range(many)]
    if seed == 0:  # a chain of releases
        profiles = [(0, "g0", "new"), (1, "g1", "e0"), (2, "g2", "e1"), (3, "g3", "e2"), (4, "g9", "e3"), (5, "g0", "e3"), (6, "g8", "new")]
    users = spark.createDataFrame([(f"u{g}", e, "n", None, g, True, None, None) for g, e in known], USERS)
    frame = spark.createDataFrame([(k, g, e, "n", None, f"n{g}") for k, g, e in profiles],
                                  "seq long, sub string, email string, name string, picture string, new_id string")
    table, outcomes = merges.user_upsert(users, frame, F.lit("2024-02-01").cast("timestamp_ntz"))
    held, refused = in_turn(known, profiles)
    assert {r.google_id: r.email for r in table.collect()} == held
    assert {r.seq for r in outcomes.where("outcome = 'email_conflict'").collect()} == refused


def test_an_email_that_was_shared_before_goes_to_nobody(spark):
    users = spark.createDataFrame([("u1", "e", "n", None, "g1", True, None, None), ("u2", "e", "n", None, "g2", True, None, None)], USERS)
    frame = spark.createDataFrame([(1, "g1", "e", "x", None, None), (2, "g3", "e", "x", None, "u3"), (3, "g2", "f", "x", None, None)],
                                  "seq long, sub string, email string, name string, picture string, new_id string")
    table, outcomes = merges.user_upsert(users, frame, F.lit("2024-02-01").cast("timestamp_ntz"))
    assert rows(outcomes, "seq", "outcome") == [(1, "updated"), (2, "email_conflict"), (3, "updated")]
    assert rows(table, "google_id", "email") == [("g1", "e"), ("g2", "f")]


def test_repeated_ids_are_ambiguous_once(spark):
    """Requests that name several rows get one outcome each and change nothing."""
    users = spark.createDataFrame([user(1), user(1), user(2), user(3, active=False)], USERS)
    twice = spark.createDataFrame([project(1), project(1), project(2)], PROJECTS)
    requests = spark.createDataFrame([(1, "p1", "u1"), (2, "p2", "u1"), (3, "p1", "u9"), (4, "p1", "u1")], "seq long, project_id string, user_id string")
    table, outcomes = merges.run_transition(twice, requests, as_of())
    assert rows(outcomes, "seq", "code") == [(1, 500), (2, 200), (3, 404), (4, 500)]
    assert rows(table, "id", "status") == [("p1", "created"), ("p1", "created"), ("p2", "processing")]
    gone = spark.createDataFrame([(1, "u1"), (2, "u2"), (3, "u9")], "seq long, user_id string")
    table, outcomes = merges.user_deactivate(users, gone, as_of())
    assert rows(outcomes, "seq", "code") == [(1, 500), (2, 204), (3, 400)]
    assert rows(table, "id", "is_active") == [("u1", True), ("u1", True), ("u2", False), ("u3", False)]
    files = requests.selectExpr("project_id", "user_id", "'Data' as folder", "'f' as filename", "concat(user_id, '/', project_id) as r2_key")
    uploads = lookup.upload_keys(files.drop("r2_key"), twice)
    assert [r.code for r in uploads.orderBy("project_id", "user_id").collect()] == [500, 500, 404, 200]
    assert uploads.where("code <> 200 and r2_key is not null").isEmpty()
    assert [r.code for r in lookup.download_key_audit(files, twice).orderBy("project_id", "user_id").collect()] == [500, 500, 404, 200]
    claims = spark.createDataFrame([(1, "u1", "access", False), (2, "u2", "access", False), (3, "u3", "access", False), (4, "u4", "access", False)],
                                   "event_id long, sub string, token_type string, expired boolean")
    assert rows(access.access_outcomes(claims, users), "event_id", "code") == [(1, 500), (2, 200), (3, 400), (4, 401)]
    refresh = claims.withColumn("token_type", F.lit("refresh"))
    assert rows(access.refresh_outcomes(refresh, users), "event_id", "code") == [(1, 500), (2, 200), (3, 401), (4, 401)]
    profiles = spark.createDataFrame([(1, "g1", "new", "n", None, None), (2, "g2", "m2", "n", None, None)],
                                     "seq long, sub string, email string, name string, picture string, new_id string")
    table, outcomes = merges.user_upsert(users, profiles, as_of())
    assert rows(outcomes, "seq", "outcome", "code") == [(1, "ambiguous", 500), (2, "updated", 200)]
    assert table.count() == 4
