"""Tables of the data model, their constraints, and creating and dropping them."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import (
    BooleanType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

STRING, TIME = StringType(), TimestampType()

USERS = StructType([
    StructField("id", STRING, False),
    StructField("email", STRING, False),
    StructField("full_name", STRING, False),
    StructField("avatar_url", STRING),
    StructField("google_id", STRING, False),
    StructField("is_active", BooleanType()),
    StructField("created_at", TIME),
    StructField("updated_at", TIME),
])

PROJECTS = StructType([
    StructField("id", STRING, False),
    StructField("user_id", STRING, False),
    StructField("name", STRING, False),
    StructField("description", STRING),
    StructField("execution_type", STRING, False),
    StructField("status", STRING),
    StructField("num_files", IntegerType()),
    StructField("metadata", STRING),
    StructField("pipeline_status", STRING),
    StructField("error_message", STRING),
    StructField("created_at", TIME),
    StructField("updated_at", TIME),
])

PROJECT_FILES = StructType([
    StructField("id", STRING, False),
    StructField("project_id", STRING, False),
    StructField("filename", STRING, False),
    StructField("r2_key", STRING, False),
    StructField("folder", STRING, False),
    StructField("file_size", LongType()),
    StructField("content_type", STRING),
    StructField("created_at", TIME),
    StructField("updated_at", TIME),
])

OBJECT_LISTING = StructType([
    StructField("key", STRING, False),
    StructField("size", LongType()),
    StructField("last_modified", TIME),
])

STEP_RESULTS = StructType([
    StructField("project_id", STRING, False),
    StructField("step", STRING, False),
    StructField("status", STRING),
    StructField("ts", TIME),
])

# Parents first; dropping goes the other way round.
TABLES = {"users": USERS, "projects": PROJECTS, "project_files": PROJECT_FILES}

# The longest text each column may hold, in characters.
MAX_LENGTH = {
    "users": {"email": 255, "full_name": 255, "google_id": 255},
    "projects": {"name": 255, "execution_type": 50, "status": 50},
    "project_files": {"filename": 500, "folder": 50, "content_type": 255},
}

# Columns that identify a row.
UNIQUE = {
    "users": ["id", "email", "google_id"],
    "projects": ["id"],
    "project_files": ["id", "r2_key"],
}

# Child table, child column, parent table, parent column.
FOREIGN_KEYS = [
    ("projects", "user_id", "users", "id"),
    ("project_files", "project_id", "projects", "id"),
]


def required_columns(table: str) -> list[str]:
    return [field.name for field in TABLES[table].fields if not field.nullable]


def create_tables(spark: SparkSession, database: str = "default", location: str | None = None) -> None:
    """Create the tables, parents first; with ``location`` they live under that folder.

    Spark records NOT NULL but does not enforce it for parquet, hence the audits. The tables are
    left unbucketed on purpose: one project may own a third of all files, and a bucket cannot be
    split at run time, while a shuffled join can.
    """
    for name, schema in TABLES.items():
        columns = ", ".join(
            f"{field.name} {field.dataType.simpleString()}{'' if field.nullable else ' NOT NULL'}"
            for field in schema.fields
        )
        place = f" LOCATION '{location}/{name}'" if location else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet{place}")


def drop_tables(spark: SparkSession, database: str = "default") -> None:
    """Drop the tables, children first."""
    for name in reversed(list(TABLES)):
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
