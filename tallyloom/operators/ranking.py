"""Row numbers within groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import cut_lineage

# Rows drawn per shuffle partition, and drawn rows per piece of a group: with them, a piece holds about as many
# rows as a shuffle partition does, and there are at most as many cut points as shuffle partitions.
DRAWN = 100


def sort_columns(order: Mapping[str, bool]) -> list[Column]:
    """``order`` maps columns to whether they descend; NULLs come first either way."""
    return [F.col(c).desc_nulls_first() if down else F.col(c).asc_nulls_first() for c, down in order.items()]


def cut_points(rows: DataFrame, keys: Sequence[str], order: Mapping[str, bool]) -> tuple[DataFrame, int]:
    """``keys`` of large groups with ``_cuts``, values of the sort columns at which to cut them, in order, and the
    largest number of cuts of a group.

    They come from a sample, are collected (at most one per shuffle partition) and come back as values,
    so that every use sees the same ones.
    """
    spark = rows.sparkSession
    wanted = DRAWN * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bare = rows.select(*keys, *(c for c in order if c not in keys))
    total = bare.count()
    drawn = bare.sample(min(1.0, wanted / total), 7) if total else bare
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*sort_columns(order)))
    at = drawn.withColumn("_at", place).where(F.col("_at") % DRAWN == 0)
    cuts = at.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", *order))).alias("_cuts"))
    found = cuts.collect()
    return spark.createDataFrame(found, cuts.schema), max((len(row["_cuts"]) for row in found), default=0)


def _before(cut: Column, order: Mapping[str, bool]) -> Column:
    """Whether a cut point comes before the row."""
    out = F.lit(False)
    for column, down in reversed(order.items()):
        left, right = cut[column], F.col(column)
        ahead = (left > right) if down else (left < right)
        less = F.coalesce(ahead, left.isNull() & right.isNotNull())
        out = less | (left.eqNullSafe(right) & out)
    return out


def _pieces_before(order: Mapping[str, bool], most: int) -> Column:
    """How many of the sorted ``_cuts`` come before the row, by bisection."""
    state = F.struct(F.lit(0).alias("low"), F.size("_cuts").alias("high"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        cut = F.get("_cuts", middle)
        open_ = at["low"] < at["high"]
        ahead = open_ & _before(cut, order)
        return F.struct(F.when(ahead, middle + 1).otherwise(at["low"]).alias("low"),
                        F.when(open_ & ~ahead, middle).otherwise(at["high"]).alias("high"))

    steps = F.sequence(F.lit(0), F.lit(most.bit_length()))
    return F.aggregate(steps, state, halve, lambda at: at["low"])


def split_rank(rows: DataFrame, keys: Sequence[str], order: Mapping[str, bool], name: str = "rn") -> DataFrame:
    """``row_number() over (partition by keys order by order)`` with no task per group.

    A window puts a whole group into one task, so a group with a third of all rows would decide
    the run time. Here large groups are cut into pieces at points of the sort order, and a row's number is its
    number within group and piece plus the rows of the group's earlier pieces. Any cut points give the same numbers.

    ``rows`` are computed once, into the shared folder; what is drawn, counted and numbered is read from there. They are
    shuffled once, by group and piece, and find their piece by bisection. The counts of the pieces of cut
    groups are combined on the map side and, like the cut points, at most as many as shuffle partitions plus groups cut.
    """
    rows = cut_lineage(rows)
    cuts, most = cut_points(rows, keys, order)
    at = [*keys, "_piece"]
    window = Window.partitionBy(*at).orderBy(*sort_columns(order))
    if not most:
        numbered = rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*sort_columns(order))).cast("bigint"))
        return numbered.select(*rows.columns, name)
    joined = rows.join(F.broadcast(_primed(cuts, keys)), _same(keys), "left")
    piece = F.when(F.col("_cuts").isNotNull(), _pieces_before(order, most))
    placed = joined.withColumn("_piece", piece).select(*rows.columns, "_piece")

    sizes = placed.where("_piece is not null").groupBy(*at).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = sizes.select(*at, F.sum("_rows").over(earlier).alias("_earlier"))
    numbered = placed.withColumn("_within", F.row_number().over(window)).join(F.broadcast(_primed(carried, at)), _same(at), "left")
    number = F.col("_within") + F.coalesce("_earlier", F.lit(0))
    return numbered.select(*rows.columns, number.cast("bigint").alias(name))


def _primed(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    return frame.withColumnsRenamed({key: f"{key}'" for key in keys})


def _same(keys: Sequence[str]) -> Column:
    """Null-safe, so that a NULL key forms a group as it does in a window."""
    return reduce(Column.__and__, [F.col(f"`{key}`").eqNullSafe(F.col(f"`{key}'`")) for key in keys])
