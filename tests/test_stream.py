"""The stream of step results: windows, order, late rows."""

import datetime as dt
import os

from conftest import rows
from pyspark.sql import functions as F

from tallyloom.operators import progress
from tallyloom.plans.catalog import LATEST, QUERIES
from tallyloom.plans.fixtures import fixture
from tallyloom.streaming import progress as stream

SCHEMA = "event_id long, project_id string, step string, status string, ts timestamp"
FOLDER = "/root/testdata/sf0.001"


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def play(spark, tmp_path, batches, schema=SCHEMA):
    """One micro-batch per list of rows; gives the rows written in the end."""
    folder = tmp_path / "in"
    for number, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{folder}/{number:03}")
        # The file source takes files by modification time.
        for entry in (folder / f"{number:03}").iterdir():
            os.utime(entry, (1_700_000_000 + number, 1_700_000_000 + number))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    latest = stream.latest_step_results(source, LATEST)
    stream.write_stream(latest, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    return spark.read.schema(latest.schema).parquet(f"{tmp_path}/out")


def test_latest_result_wins_whatever_the_arrival_order(spark, tmp_path):
    out = play(spark, tmp_path, [
        [(2, "p1", "chunk_data", "success", at(1, 9)), (3, "p1", "fine_tune", "failure", at(1, 1))],
        [(1, "p1", "chunk_data", "failure", at(1, 8)), (4, "p1", "chunk_data", "failure", at(2, 1))],
        [(5, "p2", "chunk_data", "success", at(4))],
    ])
    assert rows(out, "window_start", "project_id", "step", "status") == [
        (at(1), "p1", "chunk_data", "success"), (at(1), "p1", "fine_tune", "failure"), (at(2), "p1", "chunk_data", "failure")]


def test_results_later_than_the_retention_are_dropped(spark, tmp_path):
    # The watermark lags by a batch, so a batch lies between the one that moves it and the late row.
    out = play(spark, tmp_path, [
        [(1, "p1", "chunk_data", "success", at(1, 9))],
        [(2, "p1", "fine_tune", "success", at(5))],
        [(3, "p1", "fine_tune", "success", at(5, 1))],
        [(4, "p1", "chunk_data", "failure", at(1, 10)), (5, "p1", "deploy_model", "success", at(4, 2))],
        [(6, "p1", "fine_tune", "success", at(9))],
    ])
    assert rows(out, "window_start", "step", "status") == [
        (at(1), "chunk_data", "success"), (at(4), "deploy_model", "success"), (at(5), "fine_tune", "success")]


def test_open_windows_wait(spark, tmp_path):
    out = play(spark, tmp_path, [[(1, "p1", "chunk_data", "success", at(1, 9)), (2, "p1", "chunk_data", "success", at(2, 9))]])
    assert out.isEmpty()


def test_stream_equals_batch(spark):
    results = fixture(spark, FOLDER, "results").withColumn("ts", F.col("ts").cast("timestamp"))
    end = results.agg(F.max("ts")).first()[0] - dt.timedelta(hours=24)
    batch = stream.latest_step_results(results, LATEST).where(F.col("window_end") <= F.lit(end))
    streamed = QUERIES["step_results_stream"](spark, FOLDER)
    columns = ["project_id", "step", "status", "ts"]
    assert streamed.count() > 0
    assert rows(streamed, *columns) == rows(batch.withColumn("ts", F.col("ts").cast("timestamp_ntz")), *columns)


def test_one_window_equals_the_batch_fold(spark):
    results = fixture(spark, FOLDER, "results").withColumn("ts", F.col("ts").cast("timestamp"))
    one_day = results.where("ts >= timestamp'2024-01-10' and ts < timestamp'2024-01-11'")
    columns = ["project_id", "step", "status"]
    assert rows(stream.latest_step_results(one_day, LATEST), *columns) == rows(
        progress.latest_step_result(one_day, LATEST), *columns)
