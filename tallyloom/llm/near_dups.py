"""MinHash near-dedup with HyperMinHash registers.

A document's set: its distinct shingles of five words (words are what stands between ASCII white
space, A-Z lower-cased); with fewer words the whole sequence is the one shingle. Two documents are
linked if 100 times the size of the intersection is at least 75 times that of the union.

1. Each document gets a sketch: per bucket (hash function) the minimum of its shingles' hashes,
   compressed to its number of leading zeros (6 bits) and the 10 bits after the leading one. The first
   registers are grouped into bands of ``ROWS``.
2. Documents with equal sets (by a 128-bit fingerprint of the whole set) become one node.
3. Nodes that agree on a band are candidates. In a few rounds, every node is verified against one
   other: of the centres of its band buckets, the one that it meets most often. The first round's centres
   are the smallest nodes, those of later rounds are drawn by hash. Linked nodes become one component
   after each round, and buckets with one component drop out. So a group of thousands of copies costs a
   few pairs per copy instead of all pairs.
4. Candidates that are in different components after these rounds are all examined, block by block:
   the estimate of similarity from all registers, corrected for registers that collide by chance, rules
   out those more than four standard deviations below the limit, and the others are verified.

Verification compares full sets. ``BANDS`` bands of ``ROWS`` registers miss a pair at similarity 0.75 with
probability below 1e-5, and less the more similar it is. There is no cap on buckets, candidates or partners. What
still grows with the square of its size is a bucket of nodes that turn out not to be linked; such pairs are
compared inside tasks, 512 by 512, and only those that the registers do not rule out become rows.

Defined cases: NULL texts and texts without words have an empty set, are linked with nothing and kept.
Rows that repeat a ``doc_id`` are one document: what either is linked to is connected. Rows with a NULL
``doc_id`` join the component of documents with an equal set; without one their component is NULL and
they are kept. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import arrays
from tallyloom.llm.components import components, parts_of
from tallyloom.llm.shipping import shipped
from tallyloom.operators.joins import attach, may_be_listed, without_listed
from tallyloom.session import cut_lineage

WORDS = 5
BANDS, ROWS = 44, 5
BANDED = BANDS * ROWS
# Registers for estimates: the banded ones and as many more.
REGISTERS = 2 * BANDED
MANTISSA = 10
# Links need this share; sketches are trusted to rule out a pair below the second.
PERCENT, RULED_OUT = 75, 0.66
# Rounds of one comparison per node, and rows per block when all are compared.
ROUNDS, BLOCK = 3, 512

_random = np.random.RandomState(7)
_FACTORS = (_random.randint(0, 2**62, REGISTERS).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_U = np.uint64


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[tuple[int, list[np.ndarray]]]:
    """``(first row, sets)``: of each document the sorted 64-bit hashes of its distinct shingles."""
    for row, data, offsets in arrays.chunks(texts):
        data = arrays.LOWER[data]
        starts, ends, first = arrays.word_spans(data, offsets, arrays.SOLID)
        hashes = arrays.word_hashes(data, starts, ends)
        n = len(hashes)
        rolled = np.zeros(max(n - words + 1, 0), _U)
        for k in range(words):
            rolled = rolled * arrays.MULTIPLIER + hashes[k:k + len(rolled)]
        rolled = arrays.mixed(rolled)
        sets = []
        for i in range(len(offsets) - 1):
            a, b = first[i], first[i + 1]
            if b - a >= words:
                sets.append(np.unique(rolled[a:b - words + 1]))
            elif b > a:
                one = np.array([b - a], _U)
                for k in range(a, b):
                    one = one * arrays.MULTIPLIER + hashes[k:k + 1]
                sets.append(arrays.mixed(one))
            else:
                sets.append(np.zeros(0, _U))
        yield row, sets


def registers_of(shingles: np.ndarray, starts: np.ndarray, many: int = REGISTERS) -> np.ndarray:
    """One row per set, one column per bucket: leading zeros and mantissa of the minimum."""
    out = np.empty((len(starts), many), np.uint16)
    for k, factor in enumerate(_FACTORS[:many]):
        least = np.minimum.reduceat(shingles * factor, starts)
        bits = np.frexp(np.maximum(least, _U(1)).astype(np.float64))[1].astype(np.int64)  # length in bits
        zeros = 64 - np.minimum(bits, 64)
        mantissa = (least << (zeros + 1).astype(_U)) >> _U(64 - MANTISSA)
        out[:, k] = np.minimum(zeros, 63) * (1 << MANTISSA) + mantissa.astype(np.int64)
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key per row and band; its last six bits are the number of the band."""
    keys = np.zeros((len(registers), BANDS), _U)
    for k in range(ROWS):
        keys = arrays.mixed(keys ^ registers[:, k:BANDED:ROWS].astype(_U))
    return (keys & ~_U(63)) | np.arange(BANDS, dtype=_U)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for row, sets in shingle_sets(batch.column(1)):
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            marks = np.zeros((2, len(sets)), np.int64)
            keys = np.zeros((0, BANDS), np.int64)
            if len(full):
                together = np.concatenate([sets[i] for i in full])
                starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                for j, salt in enumerate((_U(0x51ED270B), _U(0x2545F491))):
                    marks[j, full] = np.add.reduceat(arrays.mixed(together ^ salt), starts).astype(np.int64)
                keys = band_keys(registers_of(together, starts, BANDED)).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))])
            bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel()))
            yield pa.record_batch([ids.slice(row, len(sets)), pa.array(sizes), pa.array(marks[0]), pa.array(marks[1]), bands],
                                  names=["doc_id", "n_shingles", "s1", "s2", "bands"])


def sketches(docs: DataFrame) -> DataFrame:
    """``docs`` is ``doc_id, text``; gives the set's size, its fingerprint and the keys of its bands."""
    return docs.mapInArrow(_sketch, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>")


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            yield pa.record_batch([part.column(0), pa.array(
                [packer.compress((t or "").encode()) for t in part.column(1).to_pylist()], pa.binary())], names=["doc_id", "text"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of packed texts the sets and the registers for estimates."""
    unpacker = zstandard.ZstdDecompressor()
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            texts = pa.array([unpacker.decompress(t) for t in part.column(1).to_pylist()], pa.binary())
            for row, sets in shingle_sets(texts):
                sets = [s if len(s) else np.zeros(1, _U) for s in sets]
                starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
                regs = registers_of(np.concatenate(sets), starts)
                yield pa.record_batch([part.column(0).slice(row, len(sets)), pa.array([len(s) for s in sets], pa.int64()),
                                       pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary())],
                                      names=["node", "n_shingles", "shingles", "registers"])


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for left, right in zip(batch.column(2), batch.column(3)):
            a, b = np.frombuffer(left.as_buffer(), _U), np.frombuffer(right.as_buffer(), _U)
            shared = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(100 * shared >= PERCENT * (len(a) + len(b) - shared))
        yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, n_shingles, shingles, registers`` of the documents whose id is in ``nodes`` (column ``node``).

    Texts of other documents stay where they are, the others are compressed before they are shuffled.
    """
    nodes = cut_lineage(nodes.withColumnRenamed("node", "doc_id"))
    packed = may_be_listed(docs, nodes, ["doc_id"]).mapInArrow(_compressed, "doc_id long, text binary")
    wanted = packed.join(nodes.hint("merge"), "doc_id", "left_semi")
    return wanted.select("doc_id", "text").mapInArrow(_sets, "node long, n_shingles long, shingles binary, registers binary")


def verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of ``pairs`` (``a, b``) those whose full sets are similar enough."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")).hint("merge"), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")).hint("merge"), "b")
    return two.select("a", "b", "left", "right").mapInArrow(_overlaps, "a long, b long")


def estimates(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarity from equal registers (one row per pair), without the share that collides by chance.

    Two different minima share leading zeros and mantissa with a probability of about 0.72 / 2^mantissa times
    nm / (n + m)^2: the integral over both densities, where the width of a cell is on average 0.72 /
    2^mantissa of the hash value.
    """
    chance = 0.7213 / 2**MANTISSA * n * m / (n + m).astype(np.float64) ** 2
    return (equal.mean(axis=1) - chance) / (1 - chance)


def _pairs_of_block(nodes, labels, sizes, sides, band, registers) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one bucket or block pair that may be linked and meet in this band first."""
    for i in range(len(nodes) - 1):
        rest = np.arange(i + 1, len(nodes))
        small, big = np.minimum(sizes[i], sizes[rest]), np.maximum(sizes[i], sizes[rest])
        rest = rest[(labels[rest] != labels[i]) & (100 * small >= PERCENT * big) & ((sides[rest] == 2) | (sides[rest] != sides[i]))]
        if not len(rest):
            continue
        equal = registers[rest] == registers[i]
        n, m = np.full(len(rest), float(sizes[i])), sizes[rest].astype(np.float64)
        keep = estimates(equal, n, m) >= RULED_OUT
        bands = equal[keep, :BANDED].reshape(-1, BANDS, ROWS).all(axis=2)
        rest = rest[keep][bands.argmax(axis=1) == band]
        if len(rest):
            yield np.full(len(rest), nodes[i]), nodes[rest]


def _crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by ``block``; a block has at most two times ``BLOCK`` rows or so."""

    def work(table: pa.Table) -> pa.RecordBatch:
        block, nodes, labels, sizes, sides, bands = (table.column(k).to_numpy() for k in range(6))
        registers = np.frombuffer(b"".join(table.column(6).to_pylist()), np.uint16).reshape(-1, REGISTERS)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            for left, right in _pairs_of_block(nodes[lo:hi], labels[lo:hi], sizes[lo:hi], sides[lo:hi], bands[lo], registers[lo:hi]):
                a.append(left)
                b.append(right)
        return pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        blocks = held.column(0).to_numpy()
        cut = int(np.searchsorted(blocks, blocks[-1], "left"))
        if cut:
            yield work(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield work(held)


def _meetings(placed: DataFrame, turn: int, parts: int) -> DataFrame:
    """``a, b``: for every node ``b`` the centre of another component that most of its buckets have.

    ``placed`` has ``key, node, label``."""
    drawn = F.lit(0).cast("long") if turn == 0 else F.xxhash64("node", F.lit(turn))
    centres = placed.groupBy("key").agg(F.min(F.struct(drawn.alias("drawn"), "node", "label")).alias("c")).coalesce(parts)
    met = attach(placed, centres.hint("merge"), ["key"], "inner").where(F.col("label") != F.col("c.label"))
    often = met.groupBy("node", F.col("c.node").alias("a")).count().coalesce(parts)
    best = often.groupBy("node").agg(F.max(F.struct("count", -F.col("a"))).alias("best"))
    return best.select((-F.col("best.col2")).alias("a"), F.col("node").alias("b")).coalesce(parts)


def _relabelled(placed: DataFrame, labels: DataFrame, parts: int) -> DataFrame:
    """``placed`` with new labels, in buckets that still have several."""
    placed = attach(placed.drop("label"), labels.hint("merge"), ["node"], "left").withColumn("label", F.coalesce("label", "node"))
    placed = placed.coalesce(parts)
    mixed = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("many"))
    mixed = mixed.where("lo < hi").select("key", "many").coalesce(parts)
    return attach(placed.drop("many"), mixed.hint("merge"), ["key"], "inner").coalesce(parts)


def _examined(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b``: all pairs of candidates in different components that the registers do not rule out."""
    filled = attach(placed, sets.select("node", "n_shingles", "registers").hint("merge"), ["node"], "inner")
    blocks = F.ceil(F.col("many") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    spread = filled.withColumns({"blocks": blocks, "own": own}).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    block = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    rows = spread.select(block.alias("block"), "node", "label", "n_shingles", side.cast("int").alias("side"),
                         F.expr("int(key & 63)").alias("band"), "registers")
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(_crossing, "a long, b long")


def near_duplicates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``."""
    docs = shipped(documents).select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    # Row numbers of checkpointed rows stay what they are.
    sketched = cut_lineage(sketches(docs)).withColumn("row", F.monotonically_increasing_id())
    filled = sketched.where("n_shingles > 0")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row")))
    classes = filled.groupBy("s1", "s2").agg(first.alias("first")).select("s1", "s2", F.col("first.doc_id").alias("node"), "first.row")
    members = attach(filled.select("doc_id", "n_shingles", "s1", "s2"), classes.drop("row"), ["s1", "s2"], "left")
    nodes = attach(filled.select("row", "bands"), classes.where("node is not null").select("row", "node"), ["row"], "inner")

    bands = cut_lineage(nodes.select("node", "bands")).select("node", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("many")).where("many > 1")
    placed = cut_lineage(attach(bands, shared, ["key"], "inner").withColumn("label", F.col("node")))
    parts = parts_of(placed.count())
    placed = placed.coalesce(parts)
    sets = cut_lineage(full_sets(docs, placed.select("node").distinct()))
    links, labels = None, None
    for turn in range(ROUNDS):
        if turn and placed.isEmpty():
            break
        found = verified(sets, cut_lineage(_meetings(placed, turn, parts)))
        # Comparisons keep the partitions of their join; only the links found are put together.
        found = cut_lineage(found).coalesce(parts)
        links = found if links is None else links.unionByName(found)
        labels = components(links)
        placed = cut_lineage(_relabelled(placed, labels, parts))
        if turn == 0:
            sets = cut_lineage(sets.join(placed.select("node").distinct().hint("merge"), "node", "left_semi"))
    rest = cut_lineage(_examined(placed, sets))
    labels = components(links.unionByName(verified(sets, rest)))

    joined = attach(members.select("doc_id", "n_shingles", "node"), labels.hint("merge"), ["node"], "left")
    component = F.coalesce("label", "node")
    result = joined.select("doc_id", "n_shingles", component.alias("component_id")).unionByName(
        sketched.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return result.withColumn("kept", F.when(F.col("component_id").isNull(), True).otherwise(
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))))


def deduplicate(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents without near copies of a document with a smaller id. All columns stay; of rows that
    repeat an id and all else, each stays, and so do rows without an id. Texts that stay are not shuffled."""
    gone = near_duplicates(documents, id_column, text_column).where(~F.col("kept") & F.col("doc_id").isNotNull())
    mark = "_gone" + "_" * max(len(c) for c in documents.columns)  # no column of the documents
    gone = cut_lineage(gone.select(F.col("doc_id").alias(mark)).distinct())
    return without_listed(documents.withColumn(mark, F.col(id_column).cast("long")), gone, [mark]).drop(mark)
