"""Batched lookups, views and key checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import keys as K
from tallyloom.operators.joins import MANY_BITS, attach, may_be_listed


def _answers(joined: DataFrame, requests: DataFrame, fields: Sequence[str]) -> DataFrame:
    once = F.col("_n") == 1
    return joined.select(
        *requests.columns,
        *[F.when(once, F.col(field)).alias(field) for field in fields],
        F.when(F.col("_n").isNull(), "missing").when(once, "found").otherwise("ambiguous").alias("result"),
    )


def lookup_at_most_one(requests: DataFrame, table: DataFrame, on: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Every request with the fields of the row it names, and a ``result``: ``found``, ``missing`` or, where columns
    that ought to be unique (ids too) are not, ``ambiguous``.

    The table is folded to one row per key before the join (combined on the map side), so a key
    that many rows share neither multiplies the requests nor fills one task; its fields stay
    NULL, since no single row is meant.
    """
    hits = table.groupBy(*on).agg(
        F.count(F.lit(1)).alias("_n"), *[F.first(field).alias(field) for field in fields])
    return _answers(attach(requests, hits, list(on), "left"), requests, fields)


def counted(table: DataFrame, on: Sequence[str], fields: Mapping[str, str] | None = None) -> DataFrame:
    """One row per key with ``_n``, how many rows of the table have it, and some of their fields under other names."""
    return table.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), *(F.first(c).alias(name) for c, name in (fields or {}).items()))


# Fixed value: the code of a request that names several rows where one is meant.
AMBIGUOUS = 500


def guarded(missing: int, found: Column) -> Column:
    """Status code of a request attached to ``counted``: what names no row, several, or one."""
    return F.when(F.col("_n").isNull(), missing).when(F.col("_n") > 1, AMBIGUOUS).otherwise(found).cast("bigint")


def project_lookup(requests: DataFrame, projects: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Projects by id and owner. A foreign project looks the same as a missing one."""
    return lookup_at_most_one(requests, projects.withColumnRenamed("id", "project_id"), ["project_id", "user_id"], fields)


def user_by_id(requests: DataFrame, users: DataFrame, fields: Sequence[str]) -> DataFrame:
    return lookup_at_most_one(requests, users.withColumnRenamed("id", "user_id"), ["user_id"], fields)


def user_by_email(requests: DataFrame, users: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Exact and case-sensitive."""
    return lookup_at_most_one(requests, users, ["email"], fields)


def lookup_ambiguity(table: DataFrame, key: str) -> DataFrame:
    """Per key the number of rows and whether a lookup by it is ambiguous."""
    return table.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn("ambiguous", F.col("n") > 1)


def user_view(users: DataFrame) -> DataFrame:
    return users.select("id", "email", "full_name", "avatar_url", "is_active", "created_at")


def file_view(files: DataFrame) -> DataFrame:
    return files.select("id", "filename", "folder", "file_size", "content_type", "created_at")


# Columns of a project view that must hold a value although the table allows NULL.
VIEW_REQUIRED = ["num_files", "status", "pipeline_status", "created_at", "updated_at"]


def project_view(projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Views of the projects that can be served, and (id, column) for each value that is lacking."""
    lacking = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in VIEW_REQUIRED]))
    complete = projects.where(" and ".join(f"{c} is not null" for c in VIEW_REQUIRED))
    view = complete.select(
        "id", "user_id", "name", "description", "execution_type", F.col("metadata").alias("metadata_"),
        "num_files", "status", "pipeline_status", "error_message", "created_at", "updated_at")
    return view, projects.select("id", F.explode(lacking).alias("column_name"))


def object_keys(files: DataFrame, projects: DataFrame) -> DataFrame:
    """The key each file should be stored under, from its project's owner."""
    owners = projects.select(F.col("id").alias("project_id"), "user_id")
    return files.join(owners, "project_id").select(
        "project_id", "user_id", "folder", "filename",
        K.object_key(F.col("user_id"), F.col("project_id"), F.col("folder"), F.col("filename")).alias("r2_key"))


# Fixed value: how long an upload address is good for, in seconds.
UPLOAD_SECONDS = 3600


def upload_keys(requests: DataFrame, projects: DataFrame) -> DataFrame:
    """Key and status code per upload request (project_id, user_id, folder, filename).

    404 unless the user owns the project, 500 if several rows have its id; signing the address is left to the caller.
    """
    pair = ["project_id", "user_id"]
    hit = F.col("_n") == 1
    key = K.object_key(F.col("user_id"), F.col("project_id"), F.col("folder"), F.col("filename"))
    return attach(requests, counted(projects.withColumnRenamed("id", "project_id"), pair), pair, "left").select(
        *requests.columns, F.when(hit, key).alias("r2_key"),
        F.when(hit, F.lit(UPLOAD_SECONDS)).cast("bigint").alias("expires_in"), guarded(404, F.lit(200)).alias("code"))


def object_key_parts(listing: DataFrame, key: str = "key") -> DataFrame:
    """Parts of each key, NULL where the key does not follow the layout."""
    column = F.col(key)
    parts = {"user_id": K.key_user, "project_id": K.key_project, "folder": K.key_folder, "filename": K.key_filename}
    conforms = listing.select(column.alias("key"), K.has_key_layout(column).alias("conforms"))
    return conforms.select(
        "key", *[F.when(F.col("conforms"), part(F.col("key"))).alias(name) for name, part in parts.items()],
        "conforms")


def download_key_audit(requests: DataFrame, projects: DataFrame) -> DataFrame:
    """Status code per download request (project_id, user_id, r2_key): 404 before 500 (several rows) before 403 before 200.

    The ids must occur somewhere in the key; a prefix is not asked for.
    """
    pair = ["project_id", "user_id"]
    inside = F.col("r2_key").contains(F.col("user_id")) & F.col("r2_key").contains(F.col("project_id"))
    return attach(requests, counted(projects.withColumnRenamed("id", "project_id"), pair), pair, "left").select(
        *requests.columns, guarded(404, F.when(~inside, 403).otherwise(200)).alias("code"))


def object_listing_outcomes(requests: DataFrame, projects: DataFrame) -> DataFrame:
    """Each listing request with its status code: 404 unless the user owns the project, else 200, also for an empty folder."""
    owned = (projects.select(F.col("id").alias("project_id"), "user_id").distinct().withColumn("_owned", F.lit(True)))
    code = F.when(F.col("_owned").isNotNull(), 200).otherwise(404)
    return attach(requests, owned, ["project_id", "user_id"], "left").select(*requests.columns, code.cast("bigint").alias("code"))


# Fixed value: the folder that is listed if a request names none.
DEFAULT_FOLDER = "Data"


def object_listing(requests: DataFrame, projects: DataFrame, listing: DataFrame) -> DataFrame:
    """Objects below each requested folder (project_id, user_id, folder), sub-folders included.

    Requests for projects the user does not own list nothing; ``object_listing_outcomes`` says which
    those are. Each object is taken once per folder it is in (one, unless folders are nested), so that the prefix becomes
    an equality and no request is held against objects outside its folder. Those that nobody asks for drop
    out by a bitmap of what is asked, before the one shuffle that the objects take. The marker object of the folder is left out, and the
    prefix is removed from the file name wherever it occurs.
    """
    pair, keys = ["user_id", "project_id"], ["user_id", "project_id", "folder"]
    folder = F.coalesce("folder", F.lit(DEFAULT_FOLDER)).alias("folder")
    owned = projects.select("user_id", F.col("id").alias("project_id"))
    asked = requests.select("user_id", "project_id", folder).join(owned, pair, "left_semi").distinct()
    parted = listing.where(K.in_project(F.col("key"))).select(
        K.key_user(F.col("key")).alias("user_id"), K.key_project(F.col("key")).alias("project_id"),
        F.col("key").alias("r2_key"), "size", "last_modified")
    placed = parted.withColumn("folder", F.explode(K.key_folders(F.col("r2_key"))))
    found = attach(may_be_listed(placed, asked, keys, MANY_BITS), asked.hint("shuffle_hash"), keys, "inner")
    prefix = K.folder_prefix(F.col("user_id"), F.col("project_id"), F.col("folder"))
    return found.where(F.col("r2_key") != prefix).select(
        *keys, F.replace("r2_key", prefix, F.lit("")).alias("filename"), "r2_key", "size", "last_modified")
