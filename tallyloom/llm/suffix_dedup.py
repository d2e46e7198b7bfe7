"""Suffix-array dedup: bytes covered by a string that also starts in an earlier document are removed.

A string of ``LENGTH`` bytes is removed from a document if it also starts in a document with a smaller id;
strings are judged on the input, matches never cross documents, and a document's own repeats stay.

Every suffix of every text takes part, cut to ``LENGTH`` bytes. So that equal ones meet in one task
without a row for each, suffixes are dealt out by an anchor inside them: of the 8-byte grams in the first
``LENGTH`` bytes the leftmost one with the smallest hash. Equal strings have equal anchors at equal places.
Neighbouring suffixes mostly share an anchor; they are sent together as one piece of text, the
anchor's context, and equal contexts of a batch of documents are sent once. Pieces of all anchors that
are hashed to one partition travel as compressed blobs.

A task first drops suffixes that cannot have an equal in another document: a string holds its anchor and,
on its left or on its right, 21 more bytes, so one of these two must occur in two documents. What is left
is sorted by deep-shallow sorting: multikey quicksort on eight bytes at a time to a depth of 16, then
blind tries order the groups with a longer common prefix: a group's members are compared with their head
to find the first place where any of them branches, the bytes before it are skipped, and the group
splits by the byte there. A group that does not branch within ``LENGTH`` bytes is one string; the smallest
document id among its members decides.

The removed stretches go back to the documents, which are cut by document hash into partitions of
bounded size. A passage that many documents share has one anchor per 20 bytes or so, and
each goes to a task of its own; per copy a context costs some 12 bytes there.

Defined cases: NULL is the empty text. A NULL ``doc_id`` sorts behind all others, and two NULLs are not
smaller than one another. Rows that repeat an id are judged on their own texts and do not remove
from one another. An empty table gives an empty result. Texts shorter than ``LENGTH`` bytes lose nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import arrays
from tallyloom.llm.shipping import shipped

LENGTH, GRAM = 50, 8
GRAMS = LENGTH - GRAM + 1  # grams in a string
SIDE = (LENGTH - GRAM) // 2  # bytes on one side of the anchor that a string holds at least
SHALLOW = 16
# Bytes of text whose contexts are collected before they are sent, and suffixes sorted at once.
BATCH, AT_ONCE = 4 << 20, 300_000
# Bytes of text per partition; contexts take some three times that, a task that sorts them some 200 MB.
PARTITION = 8 << 20
NO_ID = (1 << 63) - 1
_U = np.uint64


# Blobs: a few arrays, compressed together.

def packed(*parts: np.ndarray) -> bytes:
    head = np.array([len(parts)] + [x for p in parts for x in (np.dtype(p.dtype).num, len(p))], np.int64)
    return zstandard.ZstdCompressor(level=3).compress(head.tobytes() + b"".join(np.ascontiguousarray(p).tobytes() for p in parts))


def unpacked(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    kinds = {np.dtype(t).num: np.dtype(t) for t in (np.uint8, np.uint16, np.uint32, np.uint64, np.int32, np.int64)}
    many = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 2 * many, 8)
    at, out = 8 + 16 * many, []
    for number, size in zip(head[::2], head[1::2]):
        kind = kinds[int(number)]
        out.append(np.frombuffer(data, kind, int(size), at))
        at += int(size) * kind.itemsize
    return out


def steps(ids: np.ndarray) -> np.ndarray:
    """Differences, which pack well where ids follow each other; ``np.cumsum`` undoes it."""
    return np.diff(ids, prepend=ids.dtype.type(0))


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the spans, one span after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def words_at(data: np.ndarray, size: int) -> np.ndarray:
    """For every place the ``size`` (a power of two) bytes from there as one big-endian number."""
    out, have = data.astype(_U), 1
    while have < size:
        out = (out[:-have] << _U(8 * have)) | out[have:]
        have *= 2
    return out


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one anchor: the first string's place, their number, and the anchor's place."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none
    value = (arrays.mixed(words_at(data, GRAM)) >> _U(32)).astype(np.uint32)
    place = np.arange(len(value), dtype=np.int32)

    def least(a, b, shift, n):
        right = value[shift:shift + n] if b is None else b[0][shift:shift + n]
        where = place[shift:shift + n] if b is None else b[1][shift:shift + n]
        smaller = right < a[0][:n]
        return np.where(smaller, right, a[0][:n]), np.where(smaller, where, a[1][:n])

    level, width = (value, place), 1
    while 2 * width <= GRAMS:
        level, width = least(level, level, width, len(value) - 2 * width + 1), 2 * width
    anchor = least(level, level, GRAMS - width, len(value) - GRAMS + 1)[1].astype(np.int64)
    # Strings that begin near the end of a document would cross it.
    inside = np.ones(len(anchor) + LENGTH, bool)
    for end in offsets[1:]:
        inside[max(int(end) - LENGTH + 1, 0):int(end)] = False
    inside = inside[:len(anchor)]
    begins = inside.copy()
    begins[1:] &= ~(inside[:-1] & (anchor[1:] == anchor[:-1]))
    first = np.flatnonzero(begins)
    many = np.diff(np.append(np.cumsum(inside)[first] - 1, inside.sum())) if len(first) else none
    return first, many, anchor[first]


class Contexts:
    """Contexts of a batch of documents, until they are sent."""

    def __init__(self, partitions: int):
        self.partitions = partitions
        self.clear()

    def clear(self) -> None:
        self.bytes_, self.parts, self.ids, self.marks, self.documents = 0, [], [], [], 0

    def add(self, ids: np.ndarray, marks: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
        first, many, anchor = anchors(data, offsets)
        rows = np.searchsorted(offsets, first, "right") - 1
        sums = arrays.prefix_hashes(data)
        same = arrays.span_hashes(sums, first, first + many + LENGTH - 1) ^ arrays.mixed((anchor - first).astype(_U))
        gram = arrays.span_hashes(sums, anchor, anchor + GRAM)
        self.parts.append((data, first, many, anchor - first, rows + self.documents, first - offsets[rows], same, gram))
        self.ids.append(ids)
        self.marks.append(marks)
        self.documents += len(ids)
        self.bytes_ += len(data)

    def blobs(self) -> Iterator[tuple[int, bytes]]:
        if not self.documents:
            return
        shift = np.cumsum([0] + [len(p[0]) for p in self.parts])
        data = np.concatenate([p[0] for p in self.parts])
        first = np.concatenate([p[1] + s for p, s in zip(self.parts, shift)])
        many, rel, rows, within, same, gram = (np.concatenate([p[k] for p in self.parts]) for k in range(2, 8))
        ids, marks = np.concatenate(self.ids), np.concatenate(self.marks)
        self.clear()
        _, head, own = np.unique(same, return_index=True, return_inverse=True)
        # By hash only places of one context are put together; their bytes decide.
        different = _differ(data, first, first[head[own]], many, many[head[own]])
        if different.any():
            extra = np.flatnonzero(different)
            own[extra] = len(head) + np.arange(len(extra))
            head = np.concatenate([head, extra])
        target = (gram[head] % _U(self.partitions)).astype(np.int64)
        order = np.lexsort((own, target[own]))
        bounds = np.searchsorted(target[own][order], np.arange(self.partitions + 1))
        for part in range(self.partitions):
            chosen = order[bounds[part]:bounds[part + 1]]
            if not len(chosen):
                continue
            classes, uses = np.unique(own[chosen], return_counts=True)
            lead = head[classes]
            used, local = np.unique(rows[chosen], return_inverse=True)
            yield part, packed(steps(ids[used]), marks[used], many[lead].astype(np.uint8), rel[lead].astype(np.uint8), uses.astype(np.uint32),
                               local.astype(np.uint32), within[chosen].astype(np.uint32),
                               data[spans(first[lead], many[lead] + LENGTH - 1)])


def _differ(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Which contexts differ from those that their hash says they equal."""
    out = n != m
    check = np.flatnonzero((a != b) & ~out)
    for low in range(0, len(check), 20_000):
        rows = check[low:low + 20_000]
        sizes = n[rows] + LENGTH - 1
        wrong = data[spans(a[rows], sizes)] != data[spans(b[rows], sizes)]
        if wrong.any():
            ends = np.cumsum(sizes)
            out[rows[np.unique(np.searchsorted(ends, np.flatnonzero(wrong), "right"))]] = True
    return out


def _sent(partitions: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Contexts(partitions)

        def out() -> Iterator[pa.RecordBatch]:
            for part, blob in held.blobs():
                yield pa.record_batch([pa.array([part], pa.int32()), pa.array([blob], pa.binary())], names=["part", "blob"])

        for batch in batches:
            ids, marks = (batch.column(k).to_numpy() for k in (0, 1))
            for row, data, offsets in arrays.chunks(batch.column(2)):
                held.add(ids[row:row + len(offsets) - 1], marks[row:row + len(offsets) - 1], data, offsets)
                if held.bytes_ >= BATCH:
                    yield from out()
        yield from out()
    return run


def shared_by_documents(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which keys belong to two documents; ``low`` and ``high`` are the ids that each row stands for."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]])) if len(keys) else np.zeros(0, int)
    out = np.zeros(len(keys), bool)
    if len(keys):
        several = np.minimum.reduceat(low[order], cuts) < np.maximum.reduceat(high[order], cuts)
        out[order] = np.repeat(several, np.diff(np.append(cuts, len(keys))))
    return out


def deep_shallow(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the suffixes at ``places`` by their first ``LENGTH`` bytes; gives the order and each group of equals' start.

    ``data`` has at least 8 bytes behind the last suffix's ``LENGTH``.
    """
    # Multikey quicksort, eight bytes at a time: only groups that are still equal are sorted on.
    order, group = np.arange(len(places)), np.zeros(len(places), np.int64)
    open_ = np.arange(len(places))  # positions in ``order`` of groups with more than one member
    for depth in range(0, SHALLOW, 8):
        at, keys = places[order[open_]] + depth, np.zeros(len(open_), _U)
        for k in range(8):
            keys = (keys << _U(8)) | data[at + k]
        by = np.lexsort((keys, group[open_]))
        order[open_], keys = order[open_[by]], keys[by]
        fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (group[open_][1:] != group[open_][:-1])]) if len(keys) else np.zeros(0, bool)
        group[open_] = np.maximum.accumulate(np.where(fresh, open_, 0))
        open_ = _several(group, open_)
    # Blind tries.
    done = np.full(len(places), SHALLOW)
    while len(open_):
        suffixes = places[order[open_]]
        heads = places[order[group[open_]]]
        rest = np.arange(SHALLOW, LENGTH)
        common = np.full(len(open_), LENGTH)
        for low in range(0, len(open_), 20_000):
            part = slice(low, low + 20_000)
            unequal = data[suffixes[part, None] + rest] != data[heads[part, None] + rest]
            common[part] = np.where(unequal.any(axis=1), SHALLOW + unequal.argmax(axis=1), LENGTH)
        cuts = np.flatnonzero(np.concatenate([[True], group[open_][1:] != group[open_][:-1]]))
        branch = np.repeat(np.minimum.reduceat(common, cuts), np.diff(np.append(cuts, len(open_))))
        split = branch < LENGTH
        open_, branch = open_[split], branch[split]
        done[open_] = branch
        keys = data[places[order[open_]] + branch]
        by = np.lexsort((keys, group[open_]))
        order[open_], keys = order[open_[by]], keys[by]
        if len(open_):
            fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (group[open_][1:] != group[open_][:-1])])
            group[open_] = np.maximum.accumulate(np.where(fresh, open_, 0))
        open_ = _several(group, open_)
    return order, group


def _several(group: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """Of positions in groups those whose group has more than one member."""
    if not len(open_):
        return open_
    own = group[open_]
    alike = own[1:] == own[:-1]
    return open_[np.concatenate([[False], alike]) | np.concatenate([alike, [False]])]


def removals(blobs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(ids, marks, starts, ends)`` of stretches to remove, from all contexts of a partition."""
    read = []
    while blobs:
        read.append(unpacked(blobs.pop()))
    shift = np.cumsum([0] + [len(r[0]) for r in read])
    ids, marks = np.concatenate([np.cumsum(r[0]) for r in read]), np.concatenate([r[1] for r in read])
    many, rel, uses = (np.concatenate([r[k] for r in read]).astype(np.int64) for k in (2, 3, 4))
    document = np.concatenate([r[5].astype(np.int64) + s for r, s in zip(read, shift)])
    within = np.concatenate([r[6] for r in read]).astype(np.int64)
    data = np.concatenate([r[7] for r in read] + [np.zeros(16, np.uint8)])
    del read
    sizes = many + LENGTH - 1
    at = np.cumsum(sizes) - sizes
    # Equal contexts of different batches become one.
    # Left and right of the anchor: is what a string holds there in two documents?
    has_left, has_right = rel >= SIDE, sizes - rel - GRAM >= SIDE
    same, left, right, gram = (np.zeros(len(at), _U) for _ in range(4))
    for low in range(0, len(at), 8192):
        part = slice(low, low + 8192)
        begin = at[part] - at[low]
        sums = arrays.prefix_hashes(data[at[low]:at[part][-1] + sizes[part][-1]])
        anchor = begin + rel[part]
        same[part] = arrays.span_hashes(sums, begin, begin + sizes[part]) ^ arrays.mixed(rel[part].astype(_U))
        gram[part] = arrays.span_hashes(sums, anchor, anchor + GRAM)
        left[part] = arrays.span_hashes(sums, np.maximum(anchor - SIDE, 0), anchor + GRAM)
        right[part] = arrays.span_hashes(sums, anchor, np.minimum(anchor + GRAM + SIDE, len(sums) - 1))
    _, head, own = np.unique(same, return_index=True, return_inverse=True)
    different = _differ(data, at, at[head[own]], many, many[head[own]])
    if different.any():
        extra = np.flatnonzero(different)
        own[extra] = len(head) + np.arange(len(extra))
        head = np.concatenate([head, extra])
    entry = np.repeat(own, uses)
    many, rel, at, gram, left, right, has_left, has_right = (
        x[head] for x in (many, rel, at, gram, left, right, has_left, has_right))
    del same, own
    low, high = np.full(len(head), NO_ID), np.full(len(head), -(1 << 63))
    np.minimum.at(low, entry, ids[document])
    np.maximum.at(high, entry, ids[document])
    left_shared, right_shared = np.zeros(len(head), bool), np.zeros(len(head), bool)
    left_shared[has_left] = shared_by_documents(left[has_left], low[has_left], high[has_left])
    right_shared[has_right] = shared_by_documents(right[has_right], low[has_right], high[has_right])
    del left, right
    # Strings 0 to many - 1 of a context have their anchor rel, rel - 1, ... bytes in.
    cut = np.clip(rel - SIDE + 1, 0, many)  # the first ``cut`` strings hold SIDE bytes on the left
    begin, end = np.where(left_shared, 0, cut), np.where(right_shared, many, cut)
    begin, end = np.minimum(begin, end), np.maximum(begin, end)
    relevant = np.flatnonzero(end > begin)
    relevant = relevant[np.argsort(gram[relevant], kind="stable")]
    entry_order = np.argsort(entry, kind="stable")
    entry_at = np.searchsorted(entry[entry_order], np.arange(len(head) + 1))
    load = np.cumsum((end - begin)[relevant])
    start = 0
    while start < len(relevant):
        stop = int(np.searchsorted(load, (load[start - 1] if start else 0) + AT_ONCE, "right"))
        stop = max(stop, start + 1)
        # A gram is not cut in two.
        stop = int(np.searchsorted(gram[relevant], gram[relevant[stop - 1]], "right"))
        some = relevant[start:stop]
        start = stop
        strings = (end - begin)[some]
        context = np.repeat(some, strings)
        places = spans(at[some] + begin[some], strings)
        order, group = deep_shallow(data, places)
        cuts = np.flatnonzero(group == np.arange(len(group)))
        earliest = np.empty(len(places), np.int64)
        earliest[order] = np.repeat(np.minimum.reduceat(low[context[order]], cuts), np.diff(np.append(cuts, len(places))))
        # Neighbouring strings of a context with one earliest document are a run.
        fresh = np.concatenate([[True], (context[1:] != context[:-1]) | (earliest[1:] != earliest[:-1])])
        run = np.flatnonzero(fresh)
        run_context, run_first = context[run], places[run] - at[context[run]]
        run_size, run_low = np.diff(np.append(run, len(places))), earliest[run]
        uses_ = entry_at[run_context + 1] - entry_at[run_context]
        which = np.repeat(np.arange(len(run)), uses_)
        entries = entry_order[spans(entry_at[run_context], uses_)]
        keep = run_low[which] < ids[document[entries]]
        which, entries = which[keep], entries[keep]
        starts = within[entries] + run_first[which]
        yield ids[document[entries]], marks[document[entries]], starts, starts + run_size[which] + LENGTH - 1


def _hit_blobs(partitions: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [blob for batch in batches for blob in batch.column(1).to_pylist()]
        if not blobs:
            return
        for ids, marks, starts, ends in removals(blobs):
            target = (arrays.mixed(ids.astype(_U) ^ marks.astype(_U)) % _U(partitions)).astype(np.int64)
            order = np.lexsort((starts, marks, ids, target))
            bounds = np.searchsorted(target[order], np.arange(partitions + 1))
            for part in np.unique(target):
                own = order[bounds[part]:bounds[part + 1]]
                fresh = np.concatenate([[True], (ids[own][1:] != ids[own][:-1]) | (marks[own][1:] != marks[own][:-1])])
                lead = own[fresh]
                uses = np.diff(np.append(np.flatnonzero(fresh), len(own)))
                blob = packed(steps(ids[lead]), marks[lead], uses.astype(np.uint32), starts[own].astype(np.uint32),
                              (ends - starts)[own].astype(np.uint16))
                yield pa.record_batch([pa.array([part], pa.int32()), pa.array([1], pa.int32()), pa.array([blob], pa.binary())],
                                      names=["part", "kind", "blob"])
    return run


def _document_blobs(partitions: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks, null = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
            for row, data, offsets in arrays.chunks(batch.column(2)):
                rows = np.arange(row, row + len(offsets) - 1)
                target = (arrays.mixed(ids[rows].astype(_U) ^ marks[rows].astype(_U)) % _U(partitions)).astype(np.int64)
                for part in np.unique(target):
                    own = np.flatnonzero(target == part)
                    sizes = np.diff(offsets)[own]
                    blob = packed(ids[rows[own]], marks[rows[own]], null[rows[own]].astype(np.uint8), sizes, data[spans(offsets[own], sizes)])
                    yield pa.record_batch([pa.array([part], pa.int32()), pa.array([0], pa.int32()), pa.array([blob], pa.binary())],
                                          names=["part", "kind", "blob"])
    return run


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted stretches that do not touch, from any."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[fresh], reach[np.append(np.flatnonzero(fresh)[1:] - 1, len(starts) - 1)]


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All blobs of some documents: the texts, and the stretches to remove from them."""
    texts, hits = [], []
    for batch in batches:
        for kind, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            (hits if kind else texts).append(blob)
    found: dict[tuple[int, int], list] = {}
    for blob in hits:
        ids, marks, uses, starts, sizes = unpacked(blob)
        ids = np.cumsum(ids)
        starts = starts.astype(np.int64)
        ends, at = starts + sizes, np.concatenate([[0], np.cumsum(uses.astype(np.int64))])
        for i, key in enumerate(zip(ids.tolist(), marks.tolist())):
            found.setdefault(key, []).append((starts[at[i]:at[i + 1]], ends[at[i]:at[i + 1]]))
    for blob in texts:
        ids, marks, null, sizes, data = unpacked(blob)
        rows = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "spans", "kept", "kept_sha256")}
        for i, (low, high) in enumerate(zip(np.cumsum(sizes) - sizes, np.cumsum(sizes))):
            text = data[low:high]
            key = (int(ids[i]), int(marks[i]))
            a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if key in found:
                a, b = merged(*(np.concatenate([f[k] for f in found[key]]) for k in (0, 1)))
            keep = np.ones(len(text), bool)
            for lo, hi in zip(a.tolist(), b.tolist()):
                keep[lo:hi] = False
            left = text[keep].tobytes()
            rows["doc_id"].append(None if null[i] else key[0])
            rows["n_bytes"].append(len(text))
            rows["n_removed"].append(len(text) - len(left))
            rows["spans"].append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist())])
            rows["kept"].append(left)
            rows["kept_sha256"].append(hashlib.sha256(left).hexdigest())
        yield pa.record_batch([
            pa.array(rows["doc_id"], pa.int64()), pa.array(rows["n_bytes"], pa.int64()), pa.array(rows["n_removed"], pa.int64()),
            pa.array(rows["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            pa.array(rows["kept"], pa.binary()), pa.array(rows["kept_sha256"])],
            names=["doc_id", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"])


def remove_repeats(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                   partition_bytes: int = PARTITION) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, spans, kept, kept_sha256``.

    ``spans`` are the maximal removed stretches in bytes, ``kept`` the bytes that remain (which need not be valid UTF-8).
    """
    documents = shipped(documents)
    text = F.coalesce(F.col(text_column), F.lit(""))
    size = documents.agg(F.sum(F.octet_length(text))).first()[0] or 0
    spark = documents.sparkSession
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // partition_bytes))
    # Only where ids repeat do rows need a second mark, from their text, to tell them apart.
    ids = documents.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("id"))
    repeated = not ids.groupBy("id").count().where("count > 1").isEmpty()
    mark = F.xxhash64(text) if repeated else F.lit(0).cast("long")
    own = documents.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("id"), mark.alias("mark"),
                           text.alias("text"), F.col(id_column).isNull().alias("none"))
    sent = own.select("id", "mark", "text").mapInArrow(_sent(partitions), "part int, blob binary")
    hits = sent.repartition(partitions, "part").mapInArrow(_hit_blobs(partitions), "part int, kind int, blob binary")
    texts = own.mapInArrow(_document_blobs(partitions), "part int, kind int, blob binary")
    return texts.unionByName(hits).repartition(partitions, "part").mapInArrow(
        _kept, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary, kept_sha256 string")
