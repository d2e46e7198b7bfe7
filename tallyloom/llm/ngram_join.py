"""N-gram Jaccard self-join by a prefix tree.

A document's set: its distinct shingles of ``WORDS`` words (words are what stands between ASCII white space, A-Z
lower-cased); with fewer words the whole sequence is the one shingle. Two documents link if 100 times the size of the
intersection is at least ``PERCENT`` times that of the union.

1. Documents with equal sets (by a 128-bit fingerprint of the whole set) become one.
2. A set of n can miss at most n - ceil(n PERCENT / 100) of its shingles in a partner. Sets with more shingles that no
   other document has are settled: they link with nothing. To see that, shingles of a fixed part of the
   hash space are dealt by hash; a slice of documents sends each but once, so a shingle that a third of all
   documents share is one number per slice. What repeats by a truncated hash counts as shared, which only settles less.
3. For the sets that are left shingles are ordered globally, rarest first. A pair that links shares one of the
   first n - ceil(n PERCENT / 100) + 1 of both. Sets are grouped by the smallest set that shares such a shingle
   with them: every pair that can link meets in a group.
4. In a group the sets are stored in a trie, in one order of all shingles, those of most sets first. One traversal
   counts, for a node of the trie, how many of its shingles every set of the group has; the counts are shared by
   all sets below the node. A subtree is left out once no set can reach the overlap it needs with what remains of both.
5. Groups beyond ``BLOCK`` sets or ``TOKENS`` shingles are dealt into blocks, each with the group's smallest set.
   What is connected then is one component; all pairs of blocks with different components follow.

No pair is missed, and no links inside a component are enumerated: a trie gives those that connect its sets.
What grows with the square of its size is a group of sets that share a rare shingle and do not link.

Defined cases: NULL texts and texts without words have an empty set and link with nothing; rows that repeat a
``doc_id`` are one document, with all that either links to; rows with a NULL ``doc_id`` get the component of documents
with an equal set, else NULL, and connect nothing; texts may be of any length, a task holds the shingles of the
longest; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm import arrays
from tallyloom.llm.components import components
from tallyloom.llm.near_dups import shingle_sets
from tallyloom.llm.shipping import shipped
from tallyloom.operators.joins import attach, may_be_listed
from tallyloom.session import cut_lineage

WORDS, PERCENT = 4, 85
# One of so many shingles, by hash, is dealt to find documents that link with nothing.
DEALT = 2
# Bytes of text per part of the dealt shingles, shingles per slice, and sets and shingles per trie.
PART, SLICE, BLOCK, TOKENS = 24 << 20, 1 << 21, 512, 1 << 21
# Stands for the documents of a shingle that a slice has more than once.
NOBODY = (1 << 32) - 1
_U = np.uint64


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, sets in shingle_sets(batch.column(1), WORDS):
            sizes = np.array([len(s) for s in sets], np.int64)
            full, dealt, marks = np.flatnonzero(sizes), np.zeros(len(sets), np.int64), np.zeros((2, len(sets)), np.int64)
            if len(full):
                together = np.concatenate([sets[i] for i in full])
                starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                dealt[full] = np.add.reduceat((together % _U(DEALT) == 0).astype(np.int64), starts)
                for j, salt in enumerate((_U(0x51ED270B), _U(0x2545F491))):
                    marks[j, full] = np.add.reduceat(arrays.mixed(together ^ salt), starts).astype(np.int64)
            yield pa.record_batch([batch.column(0).slice(row, len(sets)), pa.array(sizes), pa.array(dealt), pa.array(marks[0]), pa.array(marks[1])],
                                  names=["doc_id", "n_shingles", "n_dealt", "s1", "s2"])


def _dealing(parts: int):
    """Shingles by part: ``part, slice, ids, docs, counts, hashes``. Part -1 holds a slice's document ids, and how many
    of each document's shingles the slice has more than once."""

    def work(number: int, ids: list[np.ndarray], held: list[np.ndarray]) -> pa.RecordBatch:
        doc_ids, sizes = np.concatenate(ids), np.array([len(s) for s in held], np.int64)
        hashes, owner = np.concatenate(held), np.repeat(np.arange(len(held)), sizes)
        order = np.argsort(hashes)
        hashes, owner = hashes[order], owner[order]
        new = np.concatenate([[True], hashes[1:] != hashes[:-1]])[:len(hashes)]
        alone = new & np.concatenate([new[1:], [True]])[:len(hashes)]
        here = np.bincount(owner[~alone], minlength=len(held))
        some = np.flatnonzero(here)
        # A repeated shingle goes out once, for no document.
        hashes, owner = hashes[new], np.where(alone[new], owner[new], NOBODY)
        part = ((hashes >> _U(32)) % _U(parts)).astype(np.int64)
        order = np.lexsort((owner, part))
        part, owner, low = part[order], owner[order], (hashes[order] & _U(0xFFFFFFFF)).astype("<u4")
        run = np.flatnonzero((np.diff(part, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
        lengths = np.diff(np.append(run, len(owner))).astype("<u4")
        docs = owner[run].astype("<u4")
        cuts = np.flatnonzero(np.diff(part[run], prepend=-1))
        ends, tops = np.append(cuts[1:], len(run)), np.append(run, len(owner))
        rows = [(int(part[run[a]]), number, b"", docs[a:b].tobytes(), lengths[a:b].tobytes(), low[tops[a]:tops[b]].tobytes())
                for a, b in zip(cuts, ends)]
        rows.append((-1, number, doc_ids.tobytes(), some.astype("<u4").tobytes(), here[some].astype("<u4").tobytes(), b""))
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), *[pa.binary()] * 4))],
                               names=["part", "slice", "ids", "docs", "counts", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, held, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            doc_ids = batch.column(0).to_numpy()
            for row, sets in shingle_sets(batch.column(1), WORDS):
                own = [s[s % _U(DEALT) == 0] // _U(DEALT) for s in sets]
                ids.append(doc_ids[row:row + len(sets)])
                held += own
                size += sum(map(len, own))
                if size >= SLICE:
                    yield work(number, ids, held)
                    number, ids, held, size = number + 1, [], [], 0
        if size:
            yield work(number, ids, held)
    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part: how many of each document's shingles stand in another slice, too; a row per slice."""

    def work(rows: list[tuple]) -> pa.RecordBatch:
        hashes = np.concatenate([np.frombuffer(r[4], "<u4") for r in rows])
        order = np.argsort(hashes, kind="stable")
        same = hashes[order][1:] == hashes[order][:-1]
        many = np.zeros(len(hashes), bool)
        many[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        out, at = [], 0
        for number, _, docs, counts, own in rows:
            docs, counts = np.frombuffer(docs, "<u4"), np.frombuffer(counts, "<u4").astype(np.int64)
            held = np.add.reduceat(many[at:at + len(own) // 4].astype(np.int64), np.cumsum(counts) - counts)
            at += len(own) // 4
            some = (held > 0) & (docs != NOBODY)
            if some.any():
                out.append((number, b"", docs[some].tobytes(), held[some].astype("<u4").tobytes()))
        return made(out)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [()] * 4
        return pa.record_batch([pa.array(x, t) for x, t in zip(columns, (pa.int64(), *[pa.binary()] * 3))],
                               names=["slice", "ids", "docs", "counts"])

    held, rows = None, []
    for batch in batches:
        for part, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if part < 0:
                yield made([row[:4]])
                continue
            if part != held and rows:
                yield work(rows)
                rows = []
            held = part
            rows.append(row)
    if rows:
        yield work(rows)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by slice: what all parts found of its documents."""

    def work(rows: list[tuple]) -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(r[0] for r in rows), np.int64)
        total = np.zeros(len(ids), np.int64)
        for _, docs, counts in rows:
            np.add.at(total, np.frombuffer(docs, "<u4"), np.frombuffer(counts, "<u4"))
        some = np.flatnonzero(total)
        return pa.record_batch([pa.array(ids[some]), pa.array(total[some])], names=["doc_id", "shared"])

    held, rows = None, []
    for batch in batches:
        for number, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if number != held and rows:
                yield work(rows)
                rows = []
            held = number
            rows.append(row)
    if rows:
        yield work(rows)


def shared_counts(docs: DataFrame, parts: int) -> DataFrame:
    """``doc_id, shared``: of its dealt shingles those that another document may have; none are left out as 0.

    A row per slice and part goes to the part and back to the slice."""
    dealt = docs.mapInArrow(_dealing(parts), "part int, slice long, ids binary, docs binary, counts binary, hashes binary")
    # What a slice says of itself needs no common task.
    spread = F.when(F.col("part") < 0, F.col("slice")).otherwise(0)
    found = dealt.repartition("part", spread).sortWithinPartitions("part").mapInArrow(
        _shared, "slice long, ids binary, docs binary, counts binary")
    return found.repartition("slice").sortWithinPartitions("slice").mapInArrow(_summed, "doc_id long, shared long").groupBy(
        "doc_id").agg(F.sum("shared").alias("shared"))


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            yield pa.record_batch([part.column(0), pa.array(
                [packer.compress((t or "").encode()) for t in part.column(1).to_pylist()], pa.binary())], names=["doc_id", "text"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpacker = zstandard.ZstdDecompressor()
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            texts = pa.array([unpacker.decompress(t) for t in part.column(1).to_pylist()], pa.binary())
            for row, sets in shingle_sets(texts, WORDS):
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                values = np.concatenate([*sets, np.zeros(0, _U)]).astype(np.int64)
                yield pa.record_batch([part.column(0).slice(row, len(sets)), pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(values))], names=["node", "shingles"])


def _missing(n: Column) -> Column:
    """How many shingles of a set of n may be missing in a partner: n - ceil(n PERCENT / 100)."""
    return n - F.call_function("div", n * PERCENT + 99, F.lit(100))


def candidate_groups(sets: DataFrame) -> DataFrame:
    """``home, sid, n``: sets by the smallest set that shares one of their rarest shingles with them."""
    each = sets.select("sid", "n", F.explode("shingles").alias("shingle"))
    shared = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    each = attach(each, shared, ["shingle"], "inner")
    own = Window.partitionBy("sid")
    ranked = each.withColumns({"rank": F.row_number().over(own.orderBy("df", "shingle")), "held": F.count(F.lit(1)).over(own)})
    # Shingles that no other set has come first in the order; they are gone already.
    first = ranked.where(F.col("rank") <= _missing(F.col("n")) + 1 - (F.col("n") - F.col("held"))).select("shingle", "sid", "n")
    first = cut_lineage(first)
    homes = first.groupBy("shingle").agg(F.min("sid").alias("home"), F.count(F.lit(1)).alias("many")).where("many > 1")
    return attach(first, homes.drop("many"), ["shingle"], "inner").select("home", "sid", "n").distinct()


# --- the trie -----------------------------------------------------------------------------------

def needed(n, m):
    """Least overlap of linked sets with n and m elements."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def trie_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect what is connected among these sets of 64-bit numbers, found by one traversal of their trie."""
    many = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    kinds, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, keep = np.repeat(np.arange(many), n), count[code] > 1
    rank = np.empty(len(kinds), np.int64)
    rank[np.lexsort((kinds, -count))] = np.arange(len(kinds))
    token, owner = rank[code[keep]], owner[keep]
    order = np.lexsort((token, owner))
    held = np.bincount(owner, minlength=many)
    rows = np.split(token[order], np.cumsum(held)[:-1])
    # In the trie's order, and for each shingle the sets that have it.
    place = sorted((i for i in range(many) if held[i]), key=lambda i: rows[i].astype(">u4").tobytes())
    if len(place) < 2:
        return []
    rows, n, held = [rows[i] for i in place], n[place], held[place]
    at = np.full(many, -1)
    at[place] = np.arange(len(place))
    by_token = np.lexsort((owner, token))
    sharing, first = at[owner[by_token]], np.searchsorted(token[by_token], np.arange(len(kinds) + 1))
    common = np.zeros(len(place), np.int64)
    for i in range(1, len(place)):
        least = min(len(rows[i - 1]), len(rows[i]))
        differ = np.flatnonzero(rows[i - 1][:least] != rows[i][:least])
        common[i] = differ[0] if len(differ) else least

    links, label, spot = [], np.arange(len(place)), np.arange(len(place))
    stack = [(0, len(place), 0, np.zeros(len(place), np.int64))]
    while stack:
        low, high, depth, counts = stack.pop()
        end = int(common[low + 1:high].min()) if high - low > 1 else len(rows[low])
        segment = rows[low][depth:end]
        if len(segment):
            sizes = first[segment + 1] - first[segment]
            ends = np.cumsum(sizes)
            hit = sharing[np.repeat(first[segment] - (ends - sizes), sizes) + np.arange(ends[-1])]
            counts = counts + np.bincount(hit, minlength=len(counts))
        left = held[low:high].max() - end
        open_ = counts + np.minimum(left, held - counts) >= needed(n[low:high].min(), n)
        open_ &= (spot < high - 1) & ((label != label[low]) | (label[low:high] != label[low]).any())
        if not open_.any():
            continue
        if high - low == 1:
            for other in np.flatnonzero(open_ & (counts >= needed(n[low], n))):
                if label[other] != label[low]:
                    links.append((place[other], place[low]))
                    label[label == label[other]] = label[low]
            continue
        cuts = [low, *(low + 1 + np.flatnonzero(common[low + 1:high] == end)).tolist(), high]
        stack += [(a, b, end, counts) for a, b in zip(cuts[:-1], cuts[1:])]
    return links


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group: ``one, two, node, shingles``."""

    def work(table: pa.Table) -> pa.RecordBatch:
        keys = [table.column(c).to_numpy() for c in ("one", "two")]
        nodes, lists = table.column("node").to_numpy(), table.column("shingles").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks)
        values, ends = lists.flatten().to_numpy().view(_U), lists.offsets.to_numpy()
        ends = ends - ends[0]
        cuts = np.flatnonzero((np.diff(keys[0], prepend=keys[0][0]) != 0) | (np.diff(keys[1], prepend=keys[1][0]) != 0))
        a, b = [], []
        for low, high in zip([0, *cuts], [*cuts, len(nodes)]):
            for i, j in trie_links([values[ends[k]:ends[k + 1]] for k in range(low, high)]):
                a.append(nodes[low + i])
                b.append(nodes[low + j])
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        one, two = (held.column(c).to_numpy() for c in ("one", "two"))
        open_ = (one == one[-1]) & (two == two[-1])
        cut = int(np.argmax(open_))
        if cut:
            yield work(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None:
        yield work(held)


def _links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``rows`` is ``one, two, sid``: links between the sets of each group (one, two)."""
    filled = attach(rows, sets.select("sid", "node", "shingles"), ["sid"], "inner").select("one", "two", "node", "shingles")
    return filled.repartition("one", "two").sortWithinPartitions("one", "two").mapInArrow(_joined, "a long, b long")


def _blocks(sets: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(sets / BLOCK), F.ceil(shingles / TOKENS)).cast("long")


def _piece(blocks: str) -> Column:
    return F.pmod(F.xxhash64("sid"), F.col(blocks))


def connecting_links(sets: DataFrame) -> DataFrame:
    """``a, b``: links between nodes that connect all that is connected. ``sets`` is ``sid, node, n, shingles``."""
    members = cut_lineage(candidate_groups(sets))
    size = members.groupBy("home").agg(_blocks(F.count(F.lit(1)), F.sum("n")).alias("blocks"))
    members = cut_lineage(attach(members, size, ["home"], "inner"))
    dealt = members.where("sid <> home or blocks = 1").select(F.col("home").alias("one"), _piece("blocks").alias("two"), "sid")
    every = size.where("blocks > 1").select(F.col("home").alias("one"), F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("blocks") - 1)).alias("two"), F.col("home").alias("sid"))
    links = cut_lineage(_links(dealt.unionByName(every), sets))
    large = members.where("blocks > 1").select("home", "sid", "n")
    if large.isEmpty():
        return links

    labels = components(links)
    named = attach(large, sets.select("sid", "node"), ["sid"], "inner")
    named = attach(named, labels.hint("merge"), ["node"], "left").withColumn("label", F.coalesce("label", "node"))
    mixed = named.groupBy("home").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("home")
    named = cut_lineage(attach(named, mixed, ["home"], "left_semi").select("home", "sid", "n", "label"))
    # A component with much of a group has blocks of its own, which need not meet each other; the others share blocks.
    weights = named.groupBy("home", "label").agg(F.count(F.lit(1)).alias("many"))
    named = attach(named, weights, ["home", "label"], "inner").withColumn(
        "label", F.when(F.col("many") * 4 >= BLOCK, F.col("label")))
    whole = named.groupBy("home", "label").agg(_blocks(F.count(F.lit(1)), F.sum("n")).alias("blocks"))
    keyed = [F.coalesce("label", F.lit(0)).alias("label"), F.col("label").isNull().alias("rest")]
    named = attach(named.select("home", "sid", *keyed), whole.select("home", *keyed, "blocks"), ["home", "label", "rest"], "inner")
    named = cut_lineage(named.select("home", "sid", "label", "rest", F.xxhash64("label", "rest", _piece("blocks")).alias("unit")))
    units = named.select("home", "label", "rest", "unit").distinct()
    other = units.select("home", F.col("label").alias("label_2"), F.col("rest").alias("rest_2"), F.col("unit").alias("unit_2"))
    apart = (F.col("rest") & F.col("rest_2")) | (F.col("label") != F.col("label_2")) | (F.col("rest") != F.col("rest_2"))
    met = units.join(other, "home").where((F.col("unit") <= F.col("unit_2")) & apart)
    met = met.select("home", F.xxhash64("home", "unit").alias("one"), F.col("unit_2").alias("two"), F.array_distinct(
        F.array("unit", "unit_2")).alias("units")).select("home", "one", "two", F.explode("units").alias("unit"))
    crossing = named.join(met, ["home", "unit"]).select("one", "two", "sid")
    return links.unionByName(cut_lineage(_links(crossing, sets)))


def similar_documents(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``."""
    docs = shipped(documents).select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    marked = cut_lineage(docs.mapInArrow(_marks, "doc_id long, n_shingles long, n_dealt long, s1 long, s2 long"))
    filled = marked.where("n_shingles > 0")
    classes = filled.groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("n_dealt").alias("dealt"))
    classes = cut_lineage(classes)

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    known = docs.where("doc_id is not null")
    counts = shared_counts(known, max(1, -(-size // PART)))
    # Settled: more dealt shingles than may be missing are in no other document. A repeated id has its largest rest.
    spare = (F.col("dealt") - _missing(F.col("n")) - 1).alias("spare")
    nodes = classes.where("node is not null").select("node", spare).groupBy("node").agg(F.min("spare").alias("spare"))
    open_ = nodes.join(counts.withColumnRenamed("doc_id", "node"), "node", "left").where(
        F.coalesce("shared", F.lit(0)) > F.col("spare")).select("node")
    open_ = cut_lineage(open_)
    open_ = open_.withColumnRenamed("node", "doc_id")
    packed = may_be_listed(known, open_, ["doc_id"]).mapInArrow(_compressed, "doc_id long, text binary")
    wanted = packed.join(open_.hint("merge"), "doc_id", "left_semi")
    sets = wanted.select("doc_id", "text").mapInArrow(_sets, "node long, shingles array<long>").where(F.size("shingles") > 0)
    sets = cut_lineage(sets.withColumn("n", F.size("shingles").cast("long"))).withColumn("sid", F.monotonically_increasing_id())

    labels = components(connecting_links(sets))
    named = attach(classes.where("node is not null").select("s1", "s2", "node"), labels.hint("merge"), ["node"], "left")
    found = attach(filled.select("doc_id", "n_shingles", "s1", "s2"), named.select(
        "s1", "s2", F.coalesce("label", "node").alias("component_id")), ["s1", "s2"], "left")
    return found.select("doc_id", "n_shingles", "component_id").unionByName(
        marked.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
