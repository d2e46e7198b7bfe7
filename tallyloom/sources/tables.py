"""Parquet tables, JSON step results and relational databases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallyloom.schemas import STEP_RESULTS, TABLES

# Connections the service keeps per process, and the extra ones it may open.
POOL_SIZE = 5
MAX_OVERFLOW = 10


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table; the declared schema saves Spark from reading footers to infer one."""
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}")


def write_table(frame: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write to a folder that does not exist yet: a merge reads the table it replaces, so its
    result goes to a new folder and the caller switches over."""
    writer = frame.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


# Records per file of a dataset.
RECORDS = 1_000_000
FORMATS = ("parquet", "json")


def write_dataset(records: DataFrame, path: str, formats: Sequence[str] = FORMATS, records_per_file: int = RECORDS) -> None:
    """Generated records as Parquet and JSON lines, in ``<path>/<format>/split=<split>``.

    Adaptive execution deals the rows so that a task holds rows of one split, as many as make a good file, and cuts a
    split that is larger; so files follow the number of records, not that of the tasks that made them. The records are
    computed once: further formats are written from the first.
    """
    unknown = [f for f in formats if f not in FORMATS]
    if unknown or not formats or records_per_file < 1:
        raise ValueError(f"formats must be of {FORMATS} and records_per_file at least 1, got {list(formats)}, {records_per_file}")
    for number, kind in enumerate(formats):
        own = records if number == 0 else read_dataset(records.sparkSession, path, schema=records.schema, kind=formats[0])
        writer = own.hint("rebalance", F.col("split")).write.mode("errorifexists").partitionBy("split").option(
            "maxRecordsPerFile", records_per_file)
        if kind == "json":
            # NULL fields stay, so that every line has every field.
            writer = writer.option("ignoreNullFields", "false")
        writer.format(kind).save(f"{path}/{kind}")


def read_dataset(spark: SparkSession, path: str, split: str | None = None, kind: str = "parquet",
                 schema: StructType | None = None) -> DataFrame:
    """All records, or those of one split, whose folder alone is read."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    records = reader.format(kind).load(f"{path}/{kind}")
    return records if split is None else records.where(F.col("split") == split)


def parse_step_results(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Step results and rejects from ``value``, one JSON text per row; other columns go along with the rejects.

    Each row is in exactly one of both. Rejected are texts that are no JSON object, or whose fields have no value of their
    type: nothing becomes a NULL result without a word. A field that is absent or null is NULL.
    """
    wanted = StructType([*STEP_RESULTS.fields, StructField("_rejected", StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_rejected"}
    parsed = lines.withColumn("_parsed", F.from_json("value", wanted, options))
    # The parser ignores what follows a value. It cannot be both in an array and in an object if more than a value is there.
    listed, named = (F.try_parse_json(F.concat(F.lit(a), "value", F.lit(b))) for a, b in ("[]", ('{"v":', "}")))
    whole = (F.schema_of_variant(F.try_variant_get(listed, "$[0]", "variant")).startswith("OBJECT")
             & F.try_variant_get(listed, "$[1]", "variant").isNull() & named.isNotNull())
    good = F.coalesce(whole & F.col("_parsed").isNotNull() & F.col("_parsed._rejected").isNull(), F.lit(False))
    return (parsed.where(good).select(*(F.col(f"_parsed.{f.name}").alias(f.name) for f in STEP_RESULTS.fields)),
            parsed.where(~good).select(*lines.columns))


def read_step_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Step results and rejects (``value``, and the ``file`` it is from) of JSON lines."""
    return parse_step_results(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")))


def write_step_results(results: DataFrame, path: str) -> None:
    results.write.mode("append").json(path)


def uuid_ranges(column: str, parts: int) -> list[str]:
    """Conditions that cut a UUID column into ``parts`` ranges, each of which an index can serve.

    Version 4 ids are uniform in their leading digits. The first range has no lower and the last
    no upper bound, and the first takes the NULLs, so together they cover every row once.
    """
    if parts < 1:
        raise ValueError(f"parts must be at least 1, got {parts}")
    cuts = [f"{i * 16**8 // parts:08x}-0000-0000-0000-000000000000" for i in range(1, parts)]
    if not cuts:
        return ["1 = 1"]
    return (
        [f"{column} < '{cuts[0]}' or {column} is null"]
        + [f"{column} >= '{low}' and {column} < '{high}'" for low, high in zip(cuts, cuts[1:])]
        + [f"{column} >= '{cuts[-1]}'"])


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None,
              key: str = "id", parts: int = POOL_SIZE + MAX_OVERFLOW) -> DataFrame:
    """A database table read over ``parts`` connections; filters and columns are pushed down."""
    options = {"fetchsize": "10000", "pushDownPredicate": "true", **(properties or {})}
    return spark.read.jdbc(url, table, predicates=uuid_ranges(key, parts), properties=options)
