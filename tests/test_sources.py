"""Tables, JSON results, databases, object stores, and the session."""

import datetime as dt

import pytest
from conftest import rows

from tallyloom import schemas, session
from tallyloom.sources import listing, objects, tables


def test_create_and_drop_tables(spark, tmp_path):
    spark.sql("create database if not exists made")
    schemas.create_tables(spark, "made", str(tmp_path))
    schemas.create_tables(spark, "made", str(tmp_path))
    for name, schema in schemas.TABLES.items():
        table = spark.table(f"made.{name}")
        assert [(f.name, f.dataType) for f in table.schema] == [(f.name, f.dataType) for f in schema]
    spark.sql("insert into made.projects (id, user_id, name, execution_type) values ('p', 'u', 'n', 'fine_tune')")
    assert tables.read_table(spark, str(tmp_path), "projects").count() == 1
    schemas.drop_tables(spark, "made")
    assert spark.sql("show tables in made").isEmpty()
    schemas.drop_tables(spark, "made")


def test_required_columns():
    assert schemas.required_columns("project_files") == ["id", "project_id", "filename", "r2_key", "folder"]


def test_write_table_never_replaces_its_own_input(spark, tmp_path):
    frame = spark.range(3).selectExpr("id", "id % 2 as half")
    tables.write_table(frame, f"{tmp_path}/t", ["half"])
    assert spark.read.parquet(f"{tmp_path}/t").where("half = 0").count() == 2
    with pytest.raises(Exception, match="(?i)exists"):
        tables.write_table(frame, f"{tmp_path}/t")


def test_step_results_as_json(spark, tmp_path):
    results = spark.createDataFrame(
        [("p1", "chunk_data", "success", dt.datetime(2024, 1, 1, 10)), ("p2", "fine_tune", None, None)], schemas.STEP_RESULTS)
    tables.write_step_results(results, f"{tmp_path}/r")
    tables.write_step_results(results, f"{tmp_path}/r")
    back, rejects = tables.read_step_results(spark, f"{tmp_path}/r")
    assert rejects.isEmpty()
    assert back.schema.fieldNames() == schemas.STEP_RESULTS.fieldNames()
    assert rows(back.distinct()) == rows(results)
    assert back.count() == 4


def test_every_line_is_a_result_or_a_reject(spark, tmp_path):
    good = ['{"project_id":"p1","step":"s","status":"success","ts":"2024-01-01T10:00:00Z"}', '{"step":null,"extra":[1]}', "{}", ' {"step":"a\\nb"} ']
    bad = ["", "  ", "null", "5", '"x"', "[]", '[{"step":"s"}]', '{"step":"s"', '{"step":"s"} tail', '{"ts":"no time"}', '{"ts":{"a":1}}', "no json", '{}] x', '{}} x', "{}, {}", '{},"w":{}']
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.json").write_text("\n".join(good + bad) + "\n")
    (tmp_path / "lines" / "b.json").write_text("\n".join(good[:1] + bad[-1:]))
    results, rejects = tables.read_step_results(spark, f"{tmp_path}/lines")
    assert sorted(r.value for r in rejects.collect()) == sorted(bad + bad[-1:])
    assert {r.file.rsplit("/", 1)[1] for r in rejects.collect()} == {"a.json", "b.json"}
    assert sorted(map(repr, (tuple(r)[:3] for r in results.collect()))) == sorted(map(repr, [
        ("p1", "s", "success"), ("p1", "s", "success"), (None, None, None), (None, None, None), (None, "a\nb", None)]))


def test_dataset_in_both_formats(spark, tmp_path):
    records = spark.range(0, 5000, 1, 16).selectExpr(
        "concat(id, '-0') as record_id", "id as doc_id", "id % 3 as chunk", "if(id % 10 = 0, 'val', 'train') as split",
        "if(id % 7 = 0, null, 'é ' || id) as text")
    tables.write_dataset(records, f"{tmp_path}/set", records_per_file=1000)
    for kind in tables.FORMATS:
        back = tables.read_dataset(spark, f"{tmp_path}/set", kind=kind, schema=records.schema)
        assert rows(back, *records.columns) == rows(records)
        assert tables.read_dataset(spark, f"{tmp_path}/set", "val", kind, records.schema).count() == 500
        files = {split: len(list((tmp_path / "set" / kind / f"split={split}").glob("part-*"))) for split in ("train", "val")}
        assert files == {"train": 5, "val": 1}
    lines = "".join(p.read_text() for p in (tmp_path / "set" / "json").rglob("part-*")).splitlines()
    assert len(lines) == 5000 and all('"text":' in line for line in lines)
    with pytest.raises(ValueError, match="formats"):
        tables.write_dataset(records, f"{tmp_path}/other", formats=["csv"])


def made_tree(folder):
    for name, text in [("u1/projects/p1/Data/a b.txt", "12345"), ("u1/projects/p1/Data/_hidden", "1"), ("u1/projects/p1/Data/.dot/x", "12"),
                       ("u1/projects/p1/Data/empty", ""), ("u1/projects/p10/Data/é", "ü"), ("u2/projects/p2/Data/sub/deep/d", "1"), ("top", "")]:
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return sorted((str(p.relative_to(folder)), p.stat().st_size) for p in folder.rglob("*") if p.is_file())


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_listing_by_tasks_equals_a_walk(spark, tmp_path, scheme):
    every = made_tree(tmp_path)
    root = f"{scheme}{tmp_path}"
    whole = listing.list_prefixes(spark, root)
    assert rows(whole, "key", "size") == every
    assert whole.where("last_modified is null or last_modified > current_timestamp()").isEmpty()
    prefixes = ["u1/projects/p1", "u1/projects/p1/Data/", "u2/", "none/", "to"]
    some = listing.list_prefixes(spark, root, prefixes)
    assert rows(some, "key", "size") == [x for x in every if x[0].startswith(tuple(prefixes))]
    assert some.rdd.getNumPartitions() == 4  # the inner prefix is listed with the outer one
    requests = spark.createDataFrame([("u1", "p1", None), ("u1", "p1", "Data"), ("u2", "p2", "Data"), ("u2", None, "x"), ("u3", "p", "q")],
                                     "user_id string, project_id string, folder string")
    found = listing.list_requested(requests, root)
    assert rows(found, "key", "size") == [x for x in every if x[0].startswith(("u1/projects/p1/Data/", "u2/"))]


def test_the_driver_lists_nothing(spark, tmp_path):
    """A root that does not exist yet: planning does not look at it, reading does."""
    listed = listing.list_prefixes(spark, f"{tmp_path}/later")
    assert listed.schema.simpleString() == "struct<key:string,size:bigint,last_modified:timestamp>"
    (tmp_path / "later").mkdir()
    every = made_tree(tmp_path / "later")
    assert rows(listed, "key", "size") == every


@pytest.mark.parametrize("parts", [1, 2, 7, 16])
def test_uuid_ranges_cover_every_row_once(spark, parts):
    ids = spark.range(500).selectExpr("lower(concat(left(md5(cast(id as string)), 8), '-aaaa-4aaa-8aaa-', left(md5(cast(id as string)), 12))) as id")
    ids = ids.union(spark.sql("select cast(null as string)"))
    hits = [ids.where(condition).count() for condition in tables.uuid_ranges("id", parts)]
    assert len(hits) == parts and sum(hits) == 501
    assert parts == 1 or min(hits) > 0
    with pytest.raises(ValueError):
        tables.uuid_ranges("id", 0)


def test_read_jdbc_pushes_filter_and_columns(spark):
    url = "jdbc:derby:memory:made;create=true"
    spark.createDataFrame(
        [(f"{i:x}0000000-0000-4000-8000-000000000000", f"n{i}", i) for i in range(16)], "ID string, NAME string, N int"
    ).write.jdbc(url, "projects", properties={"createTableColumnTypes": "ID varchar(36), NAME varchar(255)"})
    table = tables.read_jdbc(spark, url, "projects", parts=4)
    assert table.rdd.getNumPartitions() == 4
    assert table.count() == 16
    chosen = table.where("n > 3").select("id")
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(N), *GreaterThan(N,3)]" in plan
    assert "ReadSchema: struct<ID:string>" in plan
    assert chosen.count() == 12


def test_store_settings():
    assert objects.store_endpoint("acct") == "https://acct.r2.cloudflarestorage.com"
    assert objects.store_endpoint("acct", "http://localhost:9000") == "http://localhost:9000"
    assert objects.store_endpoint("") is None
    assert objects.store_settings(endpoint="http://h", access_key="a", secret_key="b") == {
        "spark.hadoop.fs.s3a.endpoint": "http://h", "spark.hadoop.fs.s3a.endpoint.region": "auto",
        "spark.hadoop.fs.s3a.access.key": "a", "spark.hadoop.fs.s3a.secret.key": "b"}


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_list_folder_reads_no_contents(spark, tmp_path, scheme):
    for name, text in [("u1/projects/p1/Data/a b.txt", "12345"), ("u1/projects/p1/Data/sub/c", "12"), ("u2/projects/p2/Data/d", "1")]:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    listing = objects.list_folder(spark, f"{scheme}{tmp_path}", "u1/projects/p1")
    assert rows(listing, "key", "size") == [("u1/projects/p1/Data/a b.txt", 5), ("u1/projects/p1/Data/sub/c", 2)]
    assert listing.where("last_modified is null").isEmpty()
    scan = listing._jdf.queryExecution().executedPlan().toString()
    assert "content" not in scan.split("ReadSchema:")[1]
    listing.write.parquet(f"{tmp_path}/inventory")
    assert rows(objects.read_inventory(spark, f"{tmp_path}/inventory"), "key", "size") == rows(listing, "key", "size")


def test_shared_folder_is_the_one_the_session_names(spark):
    assert session.shared_folder(spark) == spark.sparkContext.getCheckpointDir()
    assert spark.conf.get("spark.checkpoint.dir").rstrip("/") in session.shared_folder(spark)


def test_cut_lineage_writes_to_the_shared_folder(spark):
    frame = session.cut_lineage(spark.range(10).selectExpr("id * 2 as n"))
    assert "RDD" in frame._jdf.queryExecution().executedPlan().toString()
    assert rows(frame.where("n > 15")) == [(16,), (18,)]


def test_no_folder_of_one_machine_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())
