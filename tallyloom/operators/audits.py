"""Metadata rules and table constraints, as audits over whole tables."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import rules as R
from tallyloom.schemas import FOREIGN_KEYS, MAX_LENGTH, UNIQUE, required_columns


def metadata_validation(projects: DataFrame) -> DataFrame:
    """First failing rule of each project, NULL if all hold; NULL metadata counts as ``{}``."""
    parsed = projects.select(
        F.col("id").alias("project_id"), "execution_type", R.json_keys(F.col("metadata")).alias("_keys"))
    checked = parsed.select(
        "project_id", "execution_type",
        R.first_metadata_error(F.col("execution_type"), F.col("_keys")).alias("error_code"))
    return checked.withColumn("message", R.error_message(F.col("error_code")))


def metadata_error_counts(projects: DataFrame) -> DataFrame:
    return (metadata_validation(projects)
            .groupBy(F.coalesce("error_code", F.lit("ok")).alias("error_code"))
            .agg(F.count(F.lit(1)).alias("n")))


def fk_orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per child row whose parent is missing. A NULL reference is no orphan."""
    orphans = []
    for child, column, parent, key in FOREIGN_KEYS:
        values = tables[child].select(F.col(column).alias("value")).where("value is not null")
        parents = tables[parent].select(F.col(key).alias("value"))
        orphans.append(values.join(parents, "value", "left_anti").select(
            F.lit(child).alias("table_name"), F.lit(column).alias("column_name"), "value"))
    return reduce(DataFrame.unionByName, orphans)


def _demand(table: DataFrame, name: str, columns: Iterable[str]) -> None:
    """A rule about a column that the frame lacks cannot be checked, and must not pass for fulfilled."""
    lacking = [column for column in columns if column not in table.columns]
    if lacking:
        raise ValueError(f"{name} lacks columns that rules are about: {', '.join(lacking)}")


def column_rule_violations(table: DataFrame, name: str, identity: str = "id") -> DataFrame:
    """(identity, rule) for each value that is NULL against the rule or too long, in one scan."""
    _demand(table, name, [*required_columns(name), *MAX_LENGTH[name]])
    broken = [
        F.when(F.col(column).isNull(), F.lit(f"{column}:not_null"))
        for column in required_columns(name)
    ] + [
        F.when(F.length(column) > limit, F.lit(f"{column}:max_{limit}"))
        for column, limit in MAX_LENGTH[name].items()
    ]
    return table.select(
        F.lit(name).alias("table_name"), F.col(identity).alias("row_id"),
        F.explode(F.array_compact(F.array(*broken))).alias("rule"))


def unique_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Values of unique columns that more than one row holds; NULLs never clash.

    Each column is scanned and counted by itself: columnar files make that as little to read as
    one pass would, and the shuffled keys stay bare values.
    """
    repeated = []
    for name, columns in UNIQUE.items():
        _demand(tables[name], name, columns)
        for column in columns:
            counts = (tables[name].select(F.col(column).alias("value")).where("value is not null")
                      .groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
            repeated.append(counts.select(
                F.lit(name).alias("table_name"), F.lit(column).alias("column_name"), "value", "n"))
    return reduce(DataFrame.unionByName, repeated)


def email_format(users: DataFrame) -> DataFrame:
    return users.select("id", "email", R.is_email(F.col("email")).alias("valid"))
