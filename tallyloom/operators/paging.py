"""Counts and newest-first pages of projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# An owner's rows are limited in so many buckets first.
BUCKETS = 32


def newest_first() -> list[Column]:
    """Undated projects come first; the id settles ties, so that pages are repeatable."""
    return [F.col("created_at").desc_nulls_first(), F.col("id").asc()]


def check_page(skip: int, limit: int) -> None:
    if skip < 0 or limit <= 0:
        raise ValueError(f"skip must be at least 0 and limit at least 1, got skip={skip}, limit={limit}")


def project_count_by_owner(users: DataFrame, projects: DataFrame) -> DataFrame:
    counts = projects.groupBy("user_id").agg(F.count("id").alias("total"))
    return (users.select(F.col("id").alias("user_id")).join(counts, "user_id", "left")
            .select("user_id", F.coalesce("total", F.lit(0)).alias("total")))


def project_num_files(projects: DataFrame, files: DataFrame) -> DataFrame:
    counts = files.groupBy("project_id").agg(F.count(F.lit(1)).alias("num_files"))
    return (projects.select(F.col("id").alias("project_id")).join(counts, "project_id", "left")
            .select("project_id", F.coalesce("num_files", F.lit(0)).alias("num_files")))


def _leading(projects: DataFrame, last: int) -> DataFrame:
    """Rows that may be among the ``last`` first of their owner.

    An owner's rows are dealt into buckets and each bucket keeps its first ``last`` rows, of which Spark's window
    group limit already drops most where they are read. So at most ``BUCKETS * last`` rows of an owner meet in
    the task that numbers them, however many rows and tasks there are.
    """
    bucket = F.pmod(F.xxhash64("id", "created_at"), F.lit(BUCKETS))
    place = F.row_number().over(Window.partitionBy("user_id", "_bucket").orderBy(*newest_first()))
    return projects.withColumn("_bucket", bucket).withColumn("_place", place).where(F.col("_place") <= last).drop("_bucket", "_place")


def project_page_one_owner(projects: DataFrame, owner: str, skip: int = 0, limit: int = 10) -> DataFrame:
    """One owner's page in order."""
    check_page(skip, limit)
    own = _leading(projects.where(F.col("user_id") == owner), skip + limit)
    return own.orderBy(*newest_first()).offset(skip).limit(limit)


def project_page_all_owners(projects: DataFrame, skip: int = 0, limit: int = 10) -> DataFrame:
    """The same page of every owner; ``rn`` is the place in the owner's whole list.

    The rows themselves are numbered, so rows that repeat an id, or have none, are rows of the page like any other.
    """
    check_page(skip, limit)
    last = skip + limit
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(*newest_first()))
    ranked = _leading(projects, last).withColumn("rn", place.cast("bigint"))
    return ranked.where((F.col("rn") > skip) & (F.col("rn") <= last))


def project_page_envelope(users: DataFrame, projects: DataFrame, skip: int = 0, limit: int = 10) -> DataFrame:
    """Every user's page with ``total``, ``page`` and ``size``.

    One row per item; a user whose page is empty has one row without an item. The total comes
    from a pre-aggregated count, so the rows outside the page are never shuffled.
    """
    items = project_page_all_owners(projects, skip, limit).select(
        "user_id", "rn", F.col("id").alias("project_id"), "name", "status", "created_at")
    return project_count_by_owner(users, projects).join(items, "user_id", "left").select(
        "user_id", "total",
        F.lit(skip // limit + 1).cast("bigint").alias("page"), F.lit(limit).cast("bigint").alias("size"),
        "rn", "project_id", "name", "status", "created_at")
