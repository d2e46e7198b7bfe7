"""Prefix trie over conversations, by fixed-length block hashing.

A node is a distinct sequence of first turns (role and text); its members are the conversations that begin with it.

1. Turns become digests and lengths; texts are not shuffled. Turns of a conversation are numbered by ``split_rank``, so
   that one with a third of all turns is no task's burden.
2. ``BLOCK`` turns form a block with a digest of its own. Digests of a conversation's earlier blocks, each hashed with
   its place, add up to the key of what comes before a block, in two levels of running sums. Conversations are grouped
   by that key and the block: those that agree on all earlier blocks.
3. Where all of a group have the same block, its turns are nodes with the same members, made from one of them. Only
   where siblings diverge, or some end, are members' turn boundaries looked at one by one.
4. Counts, smallest members and sums are combined on the map side over these groups. What a node sums over its
   subtree follows from sums over members: a conversation *owns* the nodes of which it is the smallest member, the
   last part of its path, so distinct nodes below a node are counted once through their owners. No round per depth.

The digest of the conversations that end in a node is a stream over their sorted ids; a task holds only its state.

Defined cases: rows without ``conv_id`` take no part; NULL roles and texts are empty strings; turns come in order of
``turn``, NULL first, equal ones in order of their digest, so repeated rows are turns of their own; an empty table
has no nodes. Texts may be of any length. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.shipping import shipped
from tallyloom.operators.joins import attach
from tallyloom.operators.ranking import split_rank
from tallyloom.session import cut_lineage

BLOCK = 8
# Blocks per first level of running sums.
STRETCH = 4096


def turn_digests(conversations: DataFrame) -> DataFrame:
    """``conv_id, n, digest, points``: every turn by its number within the conversation, from 1."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    bare = conversations.where("conv_id is not null").select(
        "conv_id", "turn", digest.alias("digest"), F.char_length(text).cast("long").alias("points"))
    return split_rank(bare, ["conv_id"], {"turn": False, "digest": False}, "n").select("conv_id", "n", "digest", "points")


def with_shared_heads(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of the first of their group: turns, and ``conv_id, length`` of all.

    Of conversation c the first h = crc32(c) mod ``most`` turns become the first h of conversation c - c % ``group`` (all
    if it has fewer, none if there is none).
    """
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = cut_lineage(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).withColumns(
        {"h": heads, "donor": F.col("conv_id") - F.col("conv_id") % group}))
    donors = convs.where(F.col("conv_id") == F.col("donor")).select("donor", F.col("own").alias("given"))
    given = F.least("h", F.coalesce("given", F.lit(0)))
    convs = convs.join(donors, "donor", "left").withColumn("given", given).withColumn(
        "length", F.col("given") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = cut_lineage(convs.select("conv_id", "donor", "h", "given", "length"))
    rest = attach(turns, convs.select("conv_id", "h", "given"), ["conv_id"], "inner").where("n > h").select(
        "conv_id", (F.col("n") - F.col("h") + F.col("given")).alias("n"), "digest", "points")
    # At most ``most`` - 1 turns of each donor, and at most twice ``group`` conversations that take them.
    first = turns.where((F.col("n") < most) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "donor")
    taken = first.join(convs.where("given > 0").select("conv_id", "donor", "given"), "donor").where("n <= given").select(
        "conv_id", "n", "digest", "points")
    return rest.unionByName(taken), convs.select("conv_id", "length")


def _numbers(text: Column) -> list[Column]:
    """Two numbers of sixty bits from a digest."""
    digest = F.sha2(text, 256)
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 16)]


def blocks(turns: DataFrame) -> DataFrame:
    """``conv_id, block, digests, points, whole, before, key, next``: blocks with the key of what comes before them."""
    at = F.expr(f"(n - 1) div {BLOCK}")
    grouped = turns.groupBy("conv_id", at.alias("block")).agg(F.array_sort(F.collect_list(F.struct("n", "digest", "points"))).alias("t"))
    digests = F.col("t.digest")
    whole = F.sha2(F.array_join(digests, ""), 256)
    one, two = _numbers(F.concat(F.col("block").cast("string"), F.lit(":"), "whole"))
    made = grouped.select("conv_id", "block", digests.alias("digests"), F.col("t.points").alias("points"), whole.alias("whole"),
                          F.expr(f"block div {STRETCH}").alias("stretch")).withColumns({"s1": one, "s2": two, "s3": F.aggregate(
                              "points", F.lit(0).cast("long"), lambda a, b: a + b)})
    made = cut_lineage(made)
    sums = ["s1", "s2", "s3"]
    stretches = made.groupBy("conv_id", "stretch").agg(*(F.sum(c).alias(c) for c in sums))
    over = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    earlier = stretches.select("conv_id", "stretch", *(F.sum(c).over(over).alias(f"e{c}") for c in sums))
    within = Window.partitionBy("conv_id", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    run = made.withColumns({f"w{c}": F.sum(c).over(within) for c in sums})
    run = attach(run, earlier, ["conv_id", "stretch"], "left")
    zero = F.lit(0).cast("decimal(38,0)")
    before = {c: F.coalesce(f"w{c}", zero) + F.coalesce(f"e{c}", zero) for c in sums}
    key = lambda a, b: F.concat(a.cast("string"), F.lit("."), b.cast("string"))
    return run.select("conv_id", "block", "digests", "points", "whole", before["s3"].cast("long").alias("before"),
                      key(before["s1"], before["s2"]).alias("key"),
                      key(before["s1"] + F.col("s1"), before["s2"] + F.col("s2")).alias("next"))


def _nodes_of(block: str, digests: str, points: str, before: str, key: str, following: str) -> Column:
    """The nodes along a block: ``depth, key, parent, points, before``."""
    size = F.size(digests)
    name = lambda i: F.when(i == 0, F.col(key)).when(i == BLOCK, F.col(following)).otherwise(
        F.sha2(F.concat(key, F.lit(":"), F.array_join(F.slice(digests, F.lit(1), F.greatest(i, F.lit(1))), "")), 256))
    sofar = lambda i: F.col(before) + F.aggregate(F.slice(points, F.lit(1), i), F.lit(0).cast("long"), lambda a, b: a + b)
    return F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(
        (F.col(block) * BLOCK + i).alias("depth"), name(i).alias("key"), name(i - 1).alias("parent"),
        F.element_at(points, i).alias("points"), sofar(i - 1).alias("before")))


_ROOT = "0.0"


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by node and id; gives each node's digest of its ids."""
    node, digest = None, None
    for batch in batches:
        depths, owners, ids = (batch.column(k).to_numpy() for k in range(3))
        cuts = np.flatnonzero((np.diff(depths, prepend=-1) != 0) | (np.diff(owners, prepend=0) != 0))
        cuts = np.unique(np.concatenate([[0], cuts, [len(ids)]]))
        done = []
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own, joined = (int(depths[low]), int(owners[low])), ",".join(map(str, ids[low:high].tolist())).encode()
            if own == node:
                digest.update(b"," + joined)
                continue
            if node is not None:
                done.append((*node, digest.hexdigest()))
            node, digest = own, hashlib.sha256(joined)
        yield _ends_batch(done)
    if node is not None:
        yield _ends_batch([(*node, digest.hexdigest())])


def _ends_batch(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    depth, owner, digest = zip(*rows) if rows else ((), (), ())
    return pa.record_batch([pa.array(depth, pa.int64()), pa.array(owner, pa.int64()), pa.array(digest, pa.string())],
                           names=["depth", "conv_id", "ends_sha256"])


def trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``.

    ``turns`` is ``conv_id, n, digest, points`` with numbers from 1, ``members`` ``conv_id, length`` of all conversations.
    """
    placed = cut_lineage(blocks(shipped(turns)))
    at = ["block", "key"]
    groups = placed.groupBy(*at).agg(
        F.min("whole").alias("lo"), F.max("whole").alias("hi"), F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("m"),
        F.min_by(F.struct("digests", "points", "before", "next"), "conv_id").alias("one"))
    groups = cut_lineage(groups)
    along = lambda prefix: F.explode(_nodes_of(
        "block", f"{prefix}digests", f"{prefix}points", f"{prefix}before", "key", f"{prefix}next")).alias("node")
    plain = groups.where("lo = hi").select("m", "n_convs", along("one."))
    # Members' own boundaries, where siblings diverge.
    apart = attach(placed, groups.where("lo < hi").select(*at), at, "left_semi").select("conv_id", along("")).select(
        "conv_id", "node.*")
    apart = cut_lineage(apart)
    nodes = plain.select("node.*", "m", "n_convs").unionByName(apart.groupBy("depth", "key").agg(
        *(F.first(c).alias(c) for c in ("parent", "points", "before")), F.min("conv_id").alias("m"), F.count(F.lit(1)).alias("n_convs")))
    root = members.agg(F.min("conv_id").alias("m"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        F.lit(0).cast("long").alias("depth"), F.lit(_ROOT).alias("key"), F.lit(None).cast("string").alias("parent"),
        F.lit(0).cast("long").alias("points"), F.lit(0).cast("long").alias("before"), "m", "n_convs")
    nodes = cut_lineage(nodes.unionByName(root))

    # Children, and each node's parent by its smallest member: (depth, smallest member) is one node.
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("key")).agg(
        F.count(F.lit(1)).alias("n_children"))
    named = nodes.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("parent"), F.col("m").alias("parent_conv_id"))
    # A node may have children without number: ``attach`` lets them be split.
    nodes = nodes.join(children, ["depth", "key"], "left").na.fill(0, ["n_children"])
    nodes = cut_lineage(attach(nodes, named, ["depth", "parent"], "left"))

    # Where each conversation ends, and what it owns.
    ends = placed.select("conv_id", F.element_at(_nodes_of("block", "digests", "points", "before", "key", "next"), -1).alias("last"))
    ends = ends.select("conv_id", "last.*").join(members.where("length > 0"), "conv_id").where("depth = length").select(
        "conv_id", "depth", "key", (F.col("before") + F.col("points")).alias("total"))
    ends = ends.unionByName(members.where("length = 0").select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(_ROOT).alias("key"), F.lit(0).cast("long").alias("total")))
    ends = attach(ends, nodes.select("depth", "key", "m", "n_children"), ["depth", "key"], "inner")
    owned = nodes.groupBy(F.col("m").alias("conv_id")).agg(F.min_by("before", "depth").alias("from"))
    ends = ends.join(owned, "conv_id", "left").withColumn("own", F.coalesce(F.col("total") - F.col("from"), F.lit(0)))
    ends = cut_lineage(ends.withColumn("leaf", ((F.col("m") == F.col("conv_id")) & (F.col("n_children") == 0)).cast("long")))

    sums = [F.sum(c).alias(c) for c in ("total", "own", "leaf")]
    values = ends.select("conv_id", "total", "own", "leaf")
    held = attach(placed.select("conv_id", *at), values, ["conv_id"], "inner")
    of_plain = held.groupBy(*at).agg(*sums).join(groups.where("lo = hi").select(*at, F.size("one.digests").alias("many"), "m"), at)
    of_plain = of_plain.select(F.explode(F.sequence(F.col("block") * BLOCK + 1, F.col("block") * BLOCK + F.col("many"))).alias("depth"),
                               "m", "total", "own", "leaf")
    of_apart = attach(apart.select("conv_id", "depth", "key"), values, ["conv_id"], "inner").groupBy("depth", "key").agg(
        F.min("conv_id").alias("m"), *sums).drop("key")
    of_root = values.agg(F.min("conv_id").alias("m"), *sums).select(F.lit(0).cast("long").alias("depth"), "m", "total", "own", "leaf")
    below = of_plain.unionByName(of_apart).unionByName(of_root)
    mine = values.select(F.col("conv_id").alias("m"), F.col("total").alias("m_total"), F.col("own").alias("m_own"))

    hashed = ends.select("depth", F.col("m").alias("node"), "conv_id").repartition("depth", "node").sortWithinPartitions(
        "depth", "node", "conv_id").mapInArrow(_ended, "depth long, conv_id long, ends_sha256 string")
    out = nodes.join(below, ["depth", "m"])
    out = attach(out, mine, ["m"], "inner").join(hashed.withColumnRenamed("conv_id", "m"), ["depth", "m"], "left")
    saved = F.col("total") - F.col("n_convs") * F.col("before") - (F.col("own") - F.col("m_own") + F.col("m_total") - F.col("before"))
    return out.select(
        F.col("m").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaf").alias("n_leaves"),
        saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations (``conv_id, turn, role, text``) as they are."""
    turns = cut_lineage(turn_digests(conversations))
    return trie(turns, turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length")))
