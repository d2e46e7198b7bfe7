"""Object stores: connection settings and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.schemas import OBJECT_LISTING


def store_endpoint(account: str, endpoint: str | None = None) -> str | None:
    """An endpoint that was set wins; otherwise it follows from the account, if there is one."""
    if endpoint:
        return endpoint
    # Fixed value: address format of the store.
    return f"https://{account}.r2.cloudflarestorage.com" if account else None


def store_settings(account: str = "", endpoint: str | None = None,
                   access_key: str = "", secret_key: str = "") -> dict[str, str]:
    """Session settings with which ``s3a://`` paths reach the store."""
    settings = {
        "spark.hadoop.fs.s3a.endpoint": store_endpoint(account, endpoint),
        "spark.hadoop.fs.s3a.endpoint.region": "auto",
        "spark.hadoop.fs.s3a.access.key": access_key,
        "spark.hadoop.fs.s3a.secret.key": secret_key,
    }
    return {name: value for name, value in settings.items() if value}


def list_folder(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """Listing (key, size, last_modified) of the files below ``root/prefix``.

    Contents are not read. The driver plans the listing, and Spark's file sources pass over empty
    files and names that start with ``_`` or ``.``, so this is for a look at one prefix; ``listing.list_prefixes`` is
    complete and done by tasks, and ``read_inventory`` reads what a store lists itself.
    """
    root = root.removeprefix("file://").rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root + prefix)
    base = F.lit(root)
    # Paths come back as URIs; the key is what follows the root.
    key = F.substring("path", F.instr(F.col("path"), base) + F.length(base), F.length("path"))
    return files.select(key.alias("key"), F.col("length").alias("size"),
                        F.col("modificationTime").alias("last_modified"))


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """A listing stored as parquet, as object stores publish for whole buckets."""
    return spark.read.schema(OBJECT_LISTING).parquet(path)
