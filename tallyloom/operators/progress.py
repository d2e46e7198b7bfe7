"""Run plans of projects and what became of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.steps import RETENTION, RUN_STATUS, STEP_STATUS, STEPS, is_planned, planned_steps


def stage_plan(projects: DataFrame) -> DataFrame:
    """(project_id, pos, step) in run order."""
    return projects.select(
        F.col("id").alias("project_id"),
        F.posexplode(planned_steps(F.col("execution_type"))).alias("pos", "step"),
    ).withColumn("pos", F.col("pos").cast("bigint"))


def _latest(order: list[str]) -> Column:
    return F.max_by("status", F.struct(*order))


def latest_step_result(results: DataFrame, order: list[str]) -> DataFrame:
    """Status of the latest result per project and step; ``order`` must tell results apart."""
    return results.groupBy("project_id", "step").agg(
        _latest(order).alias("status"), F.max(order[0]).alias(order[0]))


def step_status_wide(results: DataFrame, order: list[str]) -> DataFrame:
    """One row per project and a column with the latest status per step, in one aggregation."""
    return results.groupBy("project_id").agg(*[
        F.max_by(F.when(F.col("step") == step, F.col("status")),
                 F.when(F.col("step") == step, F.struct(*order))).alias(step)
        for step, _ in STEPS])


def step_status_json(results: DataFrame, order: list[str]) -> DataFrame:
    """The latest statuses of each project as a JSON object in run order; steps without one are left out."""
    wide = step_status_wide(results, order)
    return wide.select("project_id", F.to_json(F.struct(*[step for step, _ in STEPS])).alias("pipeline_status"))


def project_outcome(projects: DataFrame, results: DataFrame, order: list[str]) -> DataFrame:
    """``failed`` if a planned step failed, ``completed`` if all succeeded, else ``processing``."""
    joined = projects.select(F.col("id").alias("project_id"), "execution_type").join(
        step_status_wide(results, order), "project_id", "left")
    planned = {step: is_planned(step, F.col("execution_type")) for step, _ in STEPS}
    failed = reduce(Column.__or__, [on & F.col(step).eqNullSafe(F.lit("failure")) for step, on in planned.items()])
    done = reduce(Column.__and__, [~on | F.col(step).eqNullSafe(F.lit(STEP_STATUS)) for step, on in planned.items()])
    return joined.select(
        "project_id", F.when(failed, "failed").when(done, RUN_STATUS).otherwise("processing").alias("outcome"))


def retained_results(results: DataFrame, as_of: Column) -> DataFrame:
    return results.where(F.col("ts") >= as_of - F.expr(f"INTERVAL {RETENTION}"))
