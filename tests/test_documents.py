"""The work of the run steps on hand-written rows, and its invariants on a test table."""

import json

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.functions.html import decode_references
from tallyloom.operators import documents as D
from tallyloom.operators import joins, merges
from tallyloom.plans.catalog import MIN_SAMPLES
from tallyloom.schemas import PROJECTS
from tallyloom.sources.tables import read_dataset, write_dataset

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def docs(spark, rows_):
    return spark.createDataFrame([(i, t, "en", "s", n) for i, t, n in rows_], SCHEMA)


def test_the_first_verdict_that_applies_counts(spark):
    long = "x" * 60
    frame = docs(spark, [(1, None, 0), (2, " \n\t", 3), (3, long, 59), (4, "short", 5), (5, "short", 5), (6, long + "y", 61),
                         (7, long + "y", 61), (8, long, None), (9, long, 60), (None, long + "z", 61)])
    assert dict(rows(D.document_verdicts(frame), "doc_id", "verdict")) == {
        1: "empty", 2: "empty", 3: "length_mismatch", 4: "too_short", 5: "too_short", 6: "ok", 7: "duplicate",
        8: "length_mismatch", 9: "duplicate", None: "ok"}
    report = D.validation_report(frame).first()
    assert (report.n_documents, report.n_ok, report.n_duplicate, report.pass_rate) == (10, 2, 2, 0.2)


def test_page_text(spark):
    html = ("<html><head><title> A &amp; <b>B</b></title><style>p > a {x}</style></head><body><!-- <p>no</p> -->"
            "<SCRIPT type='x'>var s = '</p>';</SCRIPT ><p>one&nbsp;two</p>three &amp;lt; &lt;4&gt; &quot;&middot;&copy;</body></html>")
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "plain")], "page_id long, html string")
    assert rows(D.page_text(pages)) == [(1, 'A & B one two three &lt; <4> "·©'), (2, ""), (3, ""), (4, "plain")]
    assert rows(D.page_titles(pages)) == [(1, "A & B"), (2, ""), (3, ""), (4, "")]


@pytest.mark.parametrize("length, sizes", [(1, [1]), (10, [10]), (11, [10, 3]), (18, [10, 10]), (19, [10, 10, 3])])
def test_chunks_of_any_length(spark, length, sizes):
    frame = docs(spark, [(1, "abcdefghijklmnopqrstuvwxyz"[:length], length), (2, "  ", 2), (3, None, 0)])
    chunks = sorted(D.document_chunks(frame, 10, 2).collect())
    assert [len(c.text) for c in chunks] == sizes
    stats = D.chunk_stats(frame, 10, 2).collect()
    assert [(s.n_chunks, s.total_chars, s.mean_chars) for s in stats] == [(len(sizes), sum(sizes), sum(sizes) / len(sizes))]


@pytest.mark.parametrize("size, overlap", [(10, 10), (0, 0), (5, -1)])
def test_bad_chunking_is_refused(spark, size, overlap):
    with pytest.raises(ValueError, match="overlap"):
        D.document_chunks(docs(spark, []), size, overlap)


def test_chunks_without_overlap_rebuild_the_text(table):
    parts = D.document_chunks(table).withColumn("own", F.expr(f"if(chunk = 0, text, substring(text, {D.OVERLAP + 1}))"))
    rebuilt = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "own"))).alias("parts")).select(
        "doc_id", F.array_join(F.col("parts.own"), "").alias("rebuilt"))
    assert table.join(rebuilt, "doc_id").where("text <> rebuilt").isEmpty()
    assert rebuilt.count() == table.count()


def test_splits_share_no_document(spark, table, tmp_path):
    records = D.dataset_records(table)
    assert records.groupBy("doc_id").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()
    assert records.select("record_id").distinct().count() == records.count()
    write_dataset(records, f"{tmp_path}/set")
    assert sorted(p.name for p in (tmp_path / "set" / "parquet").iterdir() if p.is_dir()) == ["split=train", "split=val"]
    val = read_dataset(spark, f"{tmp_path}/set", "val")
    assert val.count() == records.where("split = 'val'").count() > 0
    assert read_dataset(spark, f"{tmp_path}/set").count() == records.count()
    gate = D.min_samples_gate(table, MIN_SAMPLES)
    assert gate.agg(F.sum("n_records")).first()[0] == records.count()


def test_verdicts_belong_to_rows(spark):
    good, other = "x" * 60, "y" * 60
    frame = docs(spark, [(1, good, 60), (1, "short", 5), (None, other, 60), (2, good, 60), (3, "z" * 60, 59), (1, good, 60), (None, good, 60)])
    records = rows(D.dataset_records(frame), "record_id", "doc_id", "split", "text")
    assert records == sorted([("1-0", 1, "train", good), ("1-0", 1, "train", good), (None, None, "train", other), (None, None, "train", good)], key=repr)
    assert rows(D.min_samples_gate(frame, 4)) == [("s", 4, "ok")]
    assert rows(D.document_verdicts(frame), "doc_id", "verdict") == sorted([
        (1, "ok"), (1, "too_short"), (None, "ok"), (2, "duplicate"), (3, "length_mismatch"), (1, "ok"), (None, "ok")], key=repr)


def test_listed_rows_go_as_in_an_anti_join(spark, monkeypatch):
    frame = spark.range(3000).selectExpr("nullif(id % 700, 3) as k", "'t' || id % 5 as t", "id", "id as _spot", "1 as _row")
    listed = spark.range(0, 500, 3).selectExpr("id as k", "'t' || id % 5 as t").unionByName(spark.createDataFrame([(None, "t3")], "k long, t string"))
    for bits in (joins.BITS, 1 << 15, 8):  # few bits: many rows are doubtful
        monkeypatch.setattr(joins, "BITS", bits)
        left = joins.without_listed(frame, listed, ["k", "t"])
        assert rows(left) == rows(frame.join(listed, ["k", "t"], "left_anti").select(*frame.columns))
        assert joins.may_be_listed(frame, listed, ["k", "t"]).join(listed, ["k", "t"], "left_semi").count() == frame.count() - left.count()


def test_texts_of_good_rows_are_not_shuffled(spark, table):
    """Of the two branches over the texts, the one whose rows pass has no exchange but the bitmap's."""
    plan = D._good(table)._jdf.queryExecution().sparkPlan().toString().split("\n")
    at = next(i for i, line in enumerate(plan) if line.startswith(":- "))
    passing = [line for line in plan[at:] if line.startswith(":")]
    narrow = next(i for i, line in enumerate(passing) if "bitmap_construct_agg" in line)
    assert any("FileScan" in line and "text" in line for line in passing[:narrow])
    assert not any("Exchange" in line or "SortMergeJoin" in line for line in passing[:narrow])


@pytest.mark.parametrize("size, overlap", [(10, 2), (10, 0), (7, 6), (9, 5), (1, 0)])
def test_chunks_equal_substrings(spark, size, overlap):
    texts = ["é\U0001f642b\n" * 13, "a" * 50, "ab\u0301" * 9 + "\r\n", "xy", "z" * size, "z" * (size + 1)]
    got = {(r.doc_id, r.chunk): (r.start, r.text) for r in D.document_chunks(docs(spark, [(i, t, 0) for i, t in enumerate(texts)]), size, overlap).collect()}
    step = size - overlap
    assert got == {(i, k): (k * step, t[k * step:k * step + size]) for i, t in enumerate(texts)
                   for k in range(-(-max(len(t) - overlap, 1) // step))}


@given(st.lists(st.sampled_from(["a", " ", "&", ";", "&amp;", "&lt", "&eacute;", "&Eacute;", "&NotEqualTilde;", "&bogus;", "&#233;", "&#x41;", "&#X1F642;",
                                 "&#150;", "&#0;", "&#xD800;", "&#1114112;", "&#;", "&;", "é"]), max_size=12).map("".join))
@settings(max_examples=25, deadline=None)
def test_references_equal_the_library(spark, text):
    import html
    import re
    want = re.sub(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);",
                  lambda m: m[0] if m[0][1] != "#" and m[0][1:] not in html.entities.html5 else html.unescape(m[0]), text)
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(decode_references(F.col("t"))).first()[0] == want


def test_chat_samples_of_odd_turns(spark):
    turns = [(1, None, "u", f"n{k}") for k in range(20)] + [(1, k, "u", f"t{k}") for k in range(-7, 5)] + [(1, 2, "u", "t2")] * 9 + [(None, 1, None, None)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    samples = sorted((r for r in D.chat_samples(frame).collect() if r.conv_id), key=lambda r: r.part)
    assert [r.n_turns for r in samples] == [8, 8, 8, 8, 8, 1] and [r.part for r in samples] == list(range(6))
    said = [(x["turn"], x["text"]) for r in samples for x in json.loads(r.sample)]
    assert [t for t, _ in said] == [None] * 20 + sorted(t for _, t, _, _ in turns[20:-1])
    assert sorted(map(repr, said)) == sorted(repr((t, x)) for _, t, _, x in turns[:-1])


def test_chat_samples_keep_every_turn(spark):
    turns = [(1, t, "user" if t % 2 == 0 else "bot", f"say {t}") for t in range(19)] + [(2, 0, "user", None), (2, 0, "user", 'q"')]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    samples = {(r.conv_id, r.part): r for r in D.chat_samples(frame).collect()}
    assert {k: r.n_turns for k, r in samples.items()} == {(1, 0): 8, (1, 1): 8, (1, 2): 3, (2, 0): 2}
    assert [x["turn"] for p in range(3) for x in json.loads(samples[1, p].sample)] == list(range(19))
    assert [x["text"] for x in json.loads(samples[2, 0].sample)] == [None, 'q"']


def test_patches_of_wrong_types_are_unprocessable(spark):
    stamp = None
    projects = spark.createDataFrame([(f"p{i}", "u1", "n", "d", "fine_tune", "created", 0, '{"base_model": 1, "a": [1, 2]}', "{}", None, stamp, stamp)
                                      for i in range(9)], PROJECTS)
    patches = ['{"name":5}', '{"name":{"a":1}}', '{"status":true}', '{"description":[1,2]}', '{"metadata_":"{}"}', '{"metadata_":[1]}',
               '{"metadata_": {"a":[1,2],"base_model":1}}', '{"description":null}', 'no json']
    frame = spark.createDataFrame([(i, f"p{i}", "u1", p) for i, p in enumerate(patches)], "seq long, project_id string, user_id string, patch string")
    table, outcomes = merges.project_patch(projects, frame, F.lit("2024-01-01").cast("timestamp_ntz"))
    assert [o for _, o in rows(outcomes, "seq", "outcome")] == ["unprocessable"] * 6 + ["noop", "ok", "unprocessable"]
    assert table.where("updated_at is not null").select("id").collect() == [("p7",)]


def test_an_accepted_profile_outlives_a_clash(spark):
    from tallyloom.schemas import USERS
    users = spark.createDataFrame([], USERS)
    profiles = spark.createDataFrame([(1, "gX", "x@e.com", "x", None, "uX"), (3, "gY", "y@e.com", "y", None, "uY"),
                                      (5, "gX", "y@e.com", "x", None, "uX")],
                                     "seq long, sub string, email string, name string, picture string, new_id string")
    table, outcomes = merges.user_upsert(users, profiles, F.lit("2024-01-01").cast("timestamp_ntz"))
    assert rows(outcomes, "seq", "outcome") == [(1, "inserted"), (3, "inserted"), (5, "email_conflict")]
    assert rows(table, "id", "email") == [("uX", "x@e.com"), ("uY", "y@e.com")]
