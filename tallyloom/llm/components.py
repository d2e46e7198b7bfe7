"""Connected components of a graph of links, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import cut_lineage

# Rows per partition of small frames that are shuffled again and again.
ROWS = 250_000


def parts_of(rows: int) -> int:
    """Partitions for so many rows."""
    return max(1, -(-rows // ROWS))


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links`` (``a, b``): the smallest node that it is connected to.

    Each round hooks every node that has a smaller neighbour to its smallest one, follows these hooks
    twice, and replaces the ends of all links by where they lead; links inside one label vanish. The
    rounds end when no link is left. A node with many links is only ever aggregated, never collected.
    All joins are by shuffle: what they join grows with the links, and broadcasts of many rounds would
    pile up on the driver.
    """
    links = cut_lineage(links.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())
    many = links.count()
    labels = links.select(F.explode(F.array("lo", "hi")).alias("node")).distinct().withColumn("label", F.col("node"))
    while many:
        # Links only get fewer; partitions follow their number, so that rounds do not leave behind many small files.
        parts = parts_of(many)
        links, labels = links.coalesce(parts), labels.coalesce(2 * parts)
        hooks = links.groupBy("hi").agg(F.min("lo").alias("to")).coalesce(parts)
        jumped = hooks
        for _ in range(2):
            step = jumped.select(F.col("hi").alias("to"), F.col("to").alias("next")).hint("merge")
            jumped = jumped.join(step, "to", "left").select("hi", F.coalesce("next", "to").alias("to")).coalesce(parts)
        jumped = cut_lineage(jumped)
        labels = cut_lineage(labels.join(jumped.withColumnRenamed("hi", "label").hint("merge"), "label", "left").select(
            "node", F.coalesce("to", "label").alias("label")).coalesce(2 * parts))
        # A hook that was not followed to its end stays as a link.
        left = links.unionByName(hooks.select(F.col("to").alias("lo"), "hi")).coalesce(parts)
        for end in ("lo", "hi"):
            moved = jumped.select(F.col("hi").alias(end), F.col("to").alias("_moved")).hint("merge")
            left = left.join(moved, end, "left").withColumn(end, F.coalesce("_moved", end)).drop("_moved").coalesce(parts)
        links = cut_lineage(left.where("lo <> hi").select(
            F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).distinct().coalesce(parts))
        many = links.count()
    return labels
