"""Joins that stand up to skew, and the declared relationships between the tables.

Adaptive execution splits an oversized partition of a join only if both sides were shuffled for
that join, and only on a side whose rows need not all be seen together: either side of an inner
join, the kept side of an outer join, the left of a semi- or anti-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(many: DataFrame, one: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join rows that may repeat a key to an aggregated or joined side with at most one row per key.

    Such a side is already partitioned by the keys, and Spark would join it as it is, which rules
    out splitting ``many``. A hash of the keys as one more key does not change what matches, but
    has both sides shuffled for this join; ``one`` is the narrow side.
    """
    spread = F.xxhash64(*keys)
    joined = many.withColumn("_spread", spread).join(one.withColumn("_spread", spread), [*keys, "_spread"], how)
    return joined.drop("_spread")


# Bits of the bitmap by which ``without_listed`` tells rows apart, and bits in one row of it: 2048 rows of 4 kB,
# whatever the data.
BITS, ROW_BITS = 1 << 26, 1 << 15

# Bits for lists that grow with tables of narrow rows, where tens of millions of keys are listed: at most 32 MB.
MANY_BITS = 1 << 28


def _doubtful(rows: DataFrame, listed: DataFrame, keys: list[str], bits_in_all: int | None) -> tuple[DataFrame, str]:
    """``rows`` with one more column, and its name: whether their keys hash to a bit that a listed key sets."""
    apart = "_" * (1 + max(map(len, rows.columns)))  # no column of the rows
    spot, row, bits, maybe = (f"{name}{apart}" for name in ("spot", "row", "bits", "maybe"))
    hashed = F.pmod(F.xxhash64(*keys), F.lit(bits_in_all or BITS)).cast("int").alias(spot)
    above, at = F.call_function("div", F.col(spot), F.lit(ROW_BITS)), F.col(spot) % ROW_BITS
    bitmap = listed.select(hashed).groupBy(above.alias(row)).agg(F.bitmap_construct_agg(at).alias(bits))
    byte = F.conv(F.hex(F.substr(F.col(bits), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.bit_get(byte, (at % 8).cast("int"))
    marked = rows.select("*", hashed).withColumn(row, above).join(F.broadcast(bitmap), row, "left")
    return marked.withColumn(maybe, F.coalesce(bit == 1, F.lit(False))), maybe


def without_listed(rows: DataFrame, listed: DataFrame, keys: list[str], bits: int | None = None) -> DataFrame:
    """Anti-join that leaves wide rows where they are: only those that may be listed are shuffled.

    The listed keys are hashed into a bitmap of fixed size, which is broadcast. Rows whose bit is not set are
    not listed and pass; the others are the listed ones and a share of accidental hits (listed keys over ``bits``, which
    are ``BITS`` by default), and settled by a join that keeps the listed keys, not the rows, in memory. As in any
    anti-join, a row with a NULL key is not listed.
    """
    marked, maybe = _doubtful(rows, listed, keys, bits)
    passed = marked.where(~F.col(maybe)).select(*rows.columns)
    doubtful = marked.where(F.col(maybe)).select(*rows.columns)
    return passed.unionByName(attach(doubtful, listed.select(*keys).distinct().hint("shuffle_hash"), keys, "left_anti"))


def may_be_listed(rows: DataFrame, listed: DataFrame, keys: list[str], bits: int | None = None) -> DataFrame:
    """Rows whose keys are listed and, rarely, others: what a semi-join need not shuffle is gone. See ``without_listed``."""
    marked, maybe = _doubtful(rows, listed, keys, bits)
    return marked.where(F.col(maybe)).select(*rows.columns)


def keep_parents(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Left join of parents with unique ``key`` to any number of children per key.

    An outer join could not split the children, so this is the inner join plus the parents
    without children, found with an anti-join on pre-aggregated child keys. Both hold a partition's unique keys in
    memory and sort nothing.
    """
    matched = parents.hint("shuffle_hash").join(children, key)
    lonely = parents.join(children.select(key).distinct().hint("shuffle_hash"), key, "left_anti")
    return matched.unionByName(lonely, allowMissingColumns=True)


def project_owner(projects: DataFrame, users: DataFrame) -> DataFrame:
    owners = users.select(F.col("id").alias("user_id"), F.col("email").alias("owner_email"),
                          F.col("full_name").alias("owner_name"))
    return projects.join(owners, "user_id").select(
        F.col("id").alias("project_id"), "name", "status", "user_id", "owner_email", "owner_name")


def user_projects(users: DataFrame, projects: DataFrame) -> DataFrame:
    """Users without projects are kept, with NULL for the project."""
    parents = users.select(F.col("id").alias("user_id"), "email")
    children = projects.select("user_id", F.col("id").alias("project_id"),
                               F.col("name").alias("project_name"), "status")
    return keep_parents(parents, children, "user_id")


def project_files_join(projects: DataFrame, files: DataFrame) -> DataFrame:
    """Projects without files are kept, with NULL for the file."""
    parents = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    children = files.select("project_id", "r2_key", "filename", "folder", "file_size", "content_type")
    return keep_parents(parents, children, "project_id")
