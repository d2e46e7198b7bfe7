"""Listing object stores by tasks: a data source with one input partition per prefix, and listings of requested folders.

Unlike Spark's file sources, it gives empty objects and names that begin with ``_`` or ``.`` as well, and the driver lists
nothing. Stores are reached through ``pyarrow.fs``, so a root is a local folder or an address like ``s3://bucket``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallyloom.functions import keys as K

FORMAT = "object_listing"
COLUMNS = "key string, size long, last_modified timestamp"


def _walker() -> Callable:
    """The function that tasks run. It is made here, so that it goes to them by value: executors need not have this package."""

    def walk(root: str, prefix: str, settings: dict[str, str]) -> Iterator[tuple]:
        """``(key, size, last_modified)`` of all objects whose key begins with the prefix, a folder at a time."""
        import datetime

        from pyarrow import fs

        if root.startswith(("s3://", "s3a://")):
            store, base = fs.S3FileSystem(**settings), root.split("://", 1)[1]
        elif "://" in root and not root.startswith("file://"):
            store, base = fs.FileSystem.from_uri(root)
        else:
            store, base = fs.LocalFileSystem(), root.removeprefix("file://")
        base = base.rstrip("/") + "/"
        folder, _, start = prefix.rpartition("/")
        waiting, first = [base + folder], True
        while waiting:
            here = waiting.pop()
            for found in store.get_file_info(fs.FileSelector(here, allow_not_found=True)):
                if first and not found.base_name.startswith(start):
                    continue
                if found.type == fs.FileType.Directory:
                    waiting.append(found.path)
                elif found.type == fs.FileType.File:
                    seconds = None if found.mtime_ns is None else datetime.datetime.fromtimestamp(
                        found.mtime_ns // 10**9, datetime.timezone.utc) + datetime.timedelta(microseconds=found.mtime_ns // 1000 % 10**6)
                    yield found.path[len(base):], found.size, seconds
            first = False

    return walk


def register(spark: SparkSession) -> None:
    """Makes ``spark.read.format("object_listing")`` known. Options: ``root``, ``prefixes`` (a JSON list; none: the whole
    store as one partition) and ``settings`` (a JSON object for the store's client)."""
    walk = _walker()

    class Prefix(InputPartition):
        pass

    class Reader(DataSourceReader):
        def __init__(self, options: Mapping[str, str]):
            self.root = options["root"]
            self.prefixes = json.loads(options.get("prefixes", '[""]'))
            self.settings = json.loads(options.get("settings", "{}"))

        def partitions(self) -> list[InputPartition]:
            # One prefix inside another would give its objects twice.
            outer = [p for p in set(self.prefixes) if not any(p != o and p.startswith(o) for o in self.prefixes)]
            return [Prefix(p) for p in sorted(outer)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            yield from walk(self.root, partition.value, self.settings)

    class ObjectListing(DataSource):
        @classmethod
        def name(cls) -> str:
            return "object_listing"

        def schema(self) -> str:
            return "key string, size long, last_modified timestamp"

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    spark.dataSource.register(ObjectListing)


def list_prefixes(spark: SparkSession, root: str, prefixes: Sequence[str] = ("",), settings: Mapping[str, str] | None = None) -> DataFrame:
    """``key, size, last_modified`` of all objects below any of the prefixes, each prefix listed by a task of its own."""
    register(spark)
    return spark.read.format(FORMAT).options(root=root, prefixes=json.dumps(list(prefixes)), settings=json.dumps(dict(settings or {}))).load()


def list_requested(requests: DataFrame, root: str, settings: Mapping[str, str] | None = None, default_folder: str = "Data") -> DataFrame:
    """Listings of the folders (user_id, project_id, folder) that a table of requests names: the request's columns and
    ``key, size, last_modified``. Each distinct folder is listed once, by the task that holds it."""
    walk, own = _walker(), dict(settings or {})
    keys = ["user_id", "project_id", "folder"]
    asked = requests.select("user_id", "project_id", F.coalesce("folder", F.lit(default_folder)).alias("folder")).distinct()
    asked = asked.withColumn("prefix", K.folder_prefix(F.col("user_id"), F.col("project_id"), F.col("folder"))).where("prefix is not null")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["prefix", "key", "size", "last_modified"]
        types = [pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC")]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 4, types)], names=names)

        rows: list[tuple] = []
        for batch in batches:
            for prefix in batch.column(0).to_pylist():
                for found in walk(root, prefix, own):
                    rows.append((prefix, *found))
                    if len(rows) >= 10_000:
                        yield made(rows)
                        rows = []
        yield made(rows)

    found = asked.select("prefix").mapInArrow(listed, f"prefix string, {COLUMNS}")
    return asked.join(found, "prefix").select(*keys, "key", "size", "last_modified")
