"""Best-fit packing: documents' tokens into as few sequences of a fixed length as possible.

Every document becomes its tokens and one closing id; only longer ones are cut, into full pieces and a
rest. The histogram of piece lengths (at most ``capacity`` numbers, whatever the data) is all that the
driver needs. There a configuration linear program is solved: how often to use each way of filling a
sequence, so that all lengths are covered by the fewest sequences.

* More than ``GROUPS`` lengths are grouped: the smallest pieces, with ``FILL`` of the tokens, are set aside, the others form
  groups of about equal ratio, and each counts as long as the longest of its group.
* Multiplicative weights hold a price per group, which starts at the share of a sequence that it takes and falls with how
  much of its demand is covered. Each round prices configurations with a knapsack dynamic program over the
  capacity and takes a small fractional step over near-optimal ones, until all demand is covered. The sum of
  the steps is the fractional solution; prices also bound the optimum from below.
* It is rounded down; what that leaves is solved and rounded again, while that places pieces.
* Real pieces go into the slots of their group, longest first. What room that leaves, and what is left of the demand, is the
  matter of best fit: the pieces set aside, longest first, into the sequence with the least room that still fits them.

The plan says for runs of pieces of one length, numbered over all data, which sequences and offsets
they get. Numbering needs no group in one task: a piece's number is its place within its partition plus
the number of pieces of its length in earlier partitions. Texts are tokenized once; only ids' checksums,
lengths and keys are kept, in the shared checkpoint folder.

Words are the unit of tokenizing: texts are split with ``pretokens``, and each distinct word goes
through the tokenizer once per process.

Defined cases: NULL and empty texts are one piece of length 1 (the closing id); every input row is
packed, repeated ids included; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm import arrays, pretokens
from tallyloom.llm.shipping import shipped
from tallyloom.llm.token_counts import holding
from tallyloom.session import cut_lineage

# Words that a Python process remembers, some 50 bytes each, and the places of the table that finds them.
REMEMBERED, TABLE = 300_000, 1 << 21
# Lengths that the program has, and the share of tokens, in the smallest pieces, that is set aside where there are more.
GROUPS, FILL = 192, 0.042
# The largest gain of coverage of a round; how near to the best its configurations are, how fast prices fall with
# coverage, and their jitter.
STEP, NEAR, RATE, JITTER = 0.05, 0.02, 4.0, 0.002
# Solutions and roundings of what the one before left, and the largest gain of a round after the first.
REPEATS, LATER = 8, 0.2


class Words:
    """Ids of words by hash; new words are encoded by the tokenizer."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        kinds = [x["type"] for x in (described.get("normalizer") or {}).get("normalizers", [])]
        if kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path} does not normalize as expected: {kinds}")
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x["content"].encode() for x in described.get("added_tokens", [])]
        self.tables = pretokens.transitions(keeps_spaces=False)
        self.clear()

    def clear(self) -> None:
        # An open table of hashes: a word stands at its hash or soon behind.
        self.keys, self.held = np.zeros(TABLE, np.uint64), np.full(TABLE, -1, np.int64)
        self.many = 0
        self.flat, self.first, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1, np.int64), 0
        self.sizes = np.zeros(0, np.int64)

    def _known(self, hashes: np.ndarray) -> np.ndarray:
        """Slots, -1 for hashes that are not in the table."""
        at = (hashes & np.uint64(TABLE - 1)).astype(np.int64)
        slots = np.where(self.keys[at] == hashes, self.held[at], -1)
        open_ = np.flatnonzero((slots < 0) & (self.held[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (TABLE - 1)
            here = at[open_]
            same = self.keys[here] == hashes[open_]
            slots[open_[same]] = self.held[here[same]]
            open_ = open_[~same & (self.held[here] >= 0)]
        return slots

    def look_up(self, hashes: np.ndarray, word: Callable[[int], bytes]) -> np.ndarray:
        """Slots of words' hashes; ``word(i)`` gives the bytes of the i-th."""
        if self.many > REMEMBERED:
            self.clear()
        slots = self._known(hashes)
        new = np.flatnonzero(slots < 0)
        if not len(new):
            return slots
        fresh, where, inverse = np.unique(hashes[new], return_index=True, return_inverse=True)
        # A chunk brings fewer new words than the table has room for.
        lists = [e.ids for e in self.tokenizer.encode_batch([word(i).decode("utf-8") for i in new[where].tolist()], add_special_tokens=False)]
        for number, hash_ in enumerate(fresh.tolist(), self.many):
            at = hash_ & (TABLE - 1)
            while self.held[at] >= 0:
                at = (at + 1) & (TABLE - 1)
            self.keys[at], self.held[at] = hash_, number
        slots[new] = self.many + inverse
        self.many += len(fresh)
        sizes = np.array([len(x) for x in lists], np.int64)
        ids = np.fromiter((x for ids in lists for x in ids), np.uint32, int(sizes.sum()))
        self.sizes = np.concatenate([self.sizes, sizes])
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        return slots

    def ids_of(self, slots: np.ndarray) -> np.ndarray:
        """The ids of a sequence of words."""
        sizes = self.sizes[slots]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.first[slots] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


@lru_cache(maxsize=2)
def _words(path: str) -> Words:
    return Words(path)


def normalized(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """NFC and lower case, without a final sigma of its own; what is plain ASCII takes the short way."""
    if not len(data) or data.max() < 128:
        return arrays.LOWER[data], offsets
    whole = data.tobytes()
    texts = [whole[a:b].decode("utf-8") for a, b in zip(offsets[:-1], offsets[1:])]
    texts = [unicodedata.normalize("NFC", t).replace("Σ", "σ").lower().encode("utf-8") for t in texts]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def token_ids(texts: pa.Array, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, ids of all texts, offsets)``, as the tokenizer gives them without special tokens added."""
    words = _words(path)
    for row, raw, raw_offsets in arrays.chunks(texts):
        data, offsets = normalized(raw, raw_offsets)
        starts, ends, hashes = pretokens.pieces(data, offsets, words.tables)
        solid = pretokens.kinds()[_first_points(data, starts)] != pretokens.WHITE_WHITE
        starts, ends, hashes = starts[solid], ends[solid], hashes[solid]
        slots = words.look_up(hashes, lambda i: data[starts[i]:ends[i]].tobytes())
        ids = words.ids_of(slots)
        sums = np.concatenate([[0], np.cumsum(words.sizes[slots])])
        places = sums[np.searchsorted(starts, offsets)]
        special = holding(raw, raw_offsets, words.special)
        if special:
            parts = np.split(ids, places[1:-1])
            for i in special:
                text = raw[raw_offsets[i]:raw_offsets[i + 1]].tobytes().decode("utf-8")
                parts[i] = np.array(words.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            ids, places = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        yield row, ids, places


def _first_points(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The code point at each start; two bytes are enough to tell white space among the others."""
    lead = data[starts].astype(np.int64)
    second = data[np.minimum(starts + 1, len(data) - 1)].astype(np.int64) if len(data) else lead
    third = data[np.minimum(starts + 2, len(data) - 1)].astype(np.int64) if len(data) else lead
    two = ((lead & 31) << 6) | (second & 63)
    three = ((lead & 15) << 12) | ((second & 63) << 6) | (third & 63)
    return np.where(lead < 128, lead, np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, 0x10000)))


def _cut(path: str, capacity: int, closing: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, ids, places in token_ids(batch.column(1), path):
                rows, numbers, starts, lengths, sums = [], [], [], [], []
                for i in range(len(places) - 1):
                    own = np.append(ids[places[i]:places[i + 1]], np.uint32(closing)).astype("<u4")
                    for number, start in enumerate(range(0, len(own), capacity)):
                        piece = own[start:start + capacity]
                        rows.append(row + i)
                        numbers.append(number)
                        starts.append(start)
                        lengths.append(len(piece))
                        sums.append(zlib.crc32(piece.tobytes()))
                yield pa.record_batch([
                    batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def cut_pieces(documents: DataFrame, path: str, capacity: int, closing: int = 1, id_column: str = "doc_id",
               text_column: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document's pieces."""
    own = shipped(documents).select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(_cut(path, capacity, closing),
                          f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Knapsack:
    """The most valuable filling of every capacity, each size as often as it fits."""

    def __init__(self, sizes: np.ndarray, prices: np.ndarray, capacity: int):
        self.sizes, self.best = sizes, np.zeros(capacity + 1)
        # A size one, two, four times and so on makes every number of times.
        self.items = [(j, 1 << k) for j, size in enumerate(sizes.tolist()) for k in range((capacity // size).bit_length())
                      if size << k <= capacity]
        self.taken = np.zeros((len(self.items), capacity + 1), bool)
        for i, (j, times) in enumerate(self.items):
            size = int(sizes[j]) * times
            other = self.best[:-size] + prices[j] * times
            np.greater(other, self.best[size:], out=self.taken[i, size:])
            self.best = np.concatenate([self.best[:size], np.maximum(other, self.best[size:])])

    def filling(self, room: int) -> dict[int, int]:
        """How many of each size (by position) fill the room best."""
        out: dict[int, int] = {}
        above = len(self.items)
        while above:
            held = np.flatnonzero(self.taken[:above, room])
            if not len(held):
                break
            above = int(held[-1])
            j, times = self.items[above]
            out[j] = out.get(j, 0) + times
            room -= int(self.sizes[j]) * times
        return out


Configuration = tuple[tuple[int, int], ...]


def fractional(counts: np.ndarray, capacity: int, step: float = STEP) -> tuple[dict[Configuration, float], float]:
    """A fractional solution of the configuration program that covers all demand, and a lower bound of the optimum.

    ``counts[n]`` pieces have length n. Keys are configurations: sorted pairs of a length and how many pieces of it.
    """
    sizes = np.flatnonzero(counts)
    sizes = sizes[sizes > 0]
    demand, covered, jitter = counts[sizes].astype(np.float64), np.zeros(len(sizes)), np.random.RandomState(1)
    used: dict[Configuration, float] = {}
    bound = float((sizes * demand).sum() / capacity)
    while (covered < 1 - 1e-9).any():
        open_ = np.flatnonzero(covered < 1 - 1e-9)
        # Without the jitter, lengths with equal coverage tie and every configuration ends in the same few.
        prices = sizes[open_] / capacity * np.exp(-RATE * covered[open_]) * (1 + JITTER * jitter.random_sample(len(open_)))
        sack = Knapsack(sizes[open_], prices, capacity)
        # Prices under which no configuration is worth more than 1 bound the number of sequences from below.
        bound = max(bound, float((prices * demand[open_]).sum() / sack.best[capacity]))
        # The best configuration with a given length in it. Those nearly as good as the best of all are used, best first, as
        # far as no length gains more than a step.
        worth = prices + sack.best[capacity - sizes[open_]]
        gain, most = np.zeros(len(open_)), np.minimum(step, 1 - covered[open_])
        near = np.flatnonzero(worth >= (1 - NEAR) * worth.max())
        for own in near[np.argsort(-worth[near], kind="stable")].tolist():
            if gain[own] >= most[own]:
                continue
            config = sack.filling(capacity - int(sizes[open_[own]]))
            config[own] = config.get(own, 0) + 1
            times = min((most[j] - gain[j]) * demand[open_[j]] / k for j, k in config.items())
            if times <= 0:
                continue
            for j, k in config.items():
                gain[j] += k * times / demand[open_[j]]
            real = tuple(sorted((int(sizes[open_[j]]), k) for j, k in config.items()))
            used[real] = used.get(real, 0.0) + times
        covered[open_] += gain
    return used, bound


def rounded(counts: np.ndarray, capacity: int) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """Configurations with how often each is used, a whole number, and the counts left over.

    The fractional solution is rounded down; what a configuration loses is carried on to the next. What is left then is
    a smaller program.
    """
    left, chosen = counts.astype(np.int64).copy(), []
    for repeat in range(REPEATS):
        if not left.any():
            break
        carried, placed = 0.0, 0
        used, _ = fractional(left, capacity, LATER if repeat else STEP)
        for key, times in sorted(used.items(), key=lambda u: (-u[1], u[0])):
            carried += times
            whole = int(min(carried + 1e-6, *(left[n] // k for n, k in key)))
            carried = min(carried - whole, 1.0)
            if whole > 0:
                for n, k in key:
                    left[n] -= k * whole
                chosen.append((dict(key), whole))
                placed += whole
        if not placed:
            break
    return chosen, left


def grouped(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every length the one that it counts as, 0 if it is set aside; and the counts by that."""
    lengths = np.flatnonzero(counts)
    stands = np.zeros(len(counts), np.int64)
    if len(lengths) <= GROUPS:
        stands[lengths] = lengths
    else:
        tokens = np.cumsum(lengths * counts[lengths])
        lengths = lengths[tokens > FILL * tokens[-1]]
        ratio = (lengths[-1] / lengths[0]) ** (1 / GROUPS)
        top = lengths[-1]
        for length in lengths[::-1]:
            if length * ratio < top:
                top = length
            stands[length] = top
    return stands, np.bincount(stands, counts, len(counts)).astype(np.int64) * (np.arange(len(counts)) > 0)


def _slots(chosen: list[tuple[dict[int, int], int]], counts: np.ndarray, stands: np.ndarray
           ) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """The configurations with real lengths in place of their groups' longest, and the counts left over."""
    left = counts.astype(np.int64).copy()
    waiting = {int(top): [int(n) for n in np.flatnonzero((stands == top) & (counts > 0))] for top in np.unique(stands[stands > 0])}
    out = []
    for config, times in chosen:
        slots = [top for top, k in config.items() for _ in range(k)]
        while times:
            # As many sequences as can have the same lengths in all their slots.
            content: dict[int, int] = {}
            taken = {}
            for top in slots:
                own = waiting[top]
                at = len(own) - 1
                while left[own[at]] - taken.get(own[at], 0) <= 0:
                    at -= 1
                taken[own[at]] = taken.get(own[at], 0) + 1
                content[own[at]] = content.get(own[at], 0) + 1
            many = min([times, *(int(left[n]) // k for n, k in content.items())])
            for n, k in content.items():
                left[n] -= k * many
            for top in set(slots):
                while waiting[top] and not left[waiting[top][-1]]:
                    waiting[top].pop()
            out.append((content, many))
            times -= many
    return out, left


def pack(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Runs of pieces and the number of sequences.

    A run (one row: length, first number, pieces, first sequence, pieces per sequence, offset) says where the
    pieces of one length with these numbers go.
    """
    counts = counts.astype(np.int64).copy()
    counts[0] = 0
    stands, demand = grouped(counts)
    chosen, left = _slots(rounded(demand, capacity)[0], counts, stands)
    return _filled(counts, capacity, chosen, left)


def _filled(counts: np.ndarray, capacity: int, chosen: list[tuple[dict[int, int], int]], left: np.ndarray) -> tuple[np.ndarray, int]:
    """Best fit of what is left into the room of the chosen configurations and into new sequences."""
    # Sequences of equal content: [room, how many, content]; those with room are found by their room.
    groups: dict[int, list[list]] = {}
    rooms: list[int] = []
    done: list[list] = []

    def add(room: int, many: int, content: dict[int, int]) -> None:
        if room == 0:
            done.append([many, content])
            return
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append([many, content])

    for config, times in chosen:
        add(capacity - sum(n * k for n, k in config.items()), times, config)
    for length in range(len(left) - 1, 0, -1):
        waiting = int(left[length])
        while waiting:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                per = min(capacity // length, waiting)
                times = waiting // per
                add(capacity - per * length, times, {length: per})
                waiting -= per * times
                continue
            room = rooms[at]
            many, content = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            per = min(room // length, waiting)
            times = min(many, waiting // per)
            if times < many:
                add(room, many - times, content)
            add(room - per * length, times, {**content, length: content.get(length, 0) + per})
            waiting -= per * times
    sequence, numbers, runs = 0, np.zeros(len(counts), np.int64), []
    for many, content in done + [group for room in rooms for group in groups[room]]:
        offset = 0
        for length, per in content.items():
            runs.append((length, numbers[length], many * per, sequence, per, offset))
            numbers[length] += many * per
            offset += length * per
        sequence += many
    return np.array(sorted(runs), np.int64).reshape(-1, 6), sequence


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each row its number among the rows of its length in this partition."""
    seen: dict[int, np.ndarray] = {}
    for batch in batches:
        lengths = batch.column(batch.schema.names.index("length")).to_numpy()
        parts = batch.column(batch.schema.names.index("part")).to_numpy()
        number = np.zeros(len(lengths), np.int64)
        for part in np.unique(parts):
            own = np.flatnonzero(parts == part)
            top = int(lengths[own].max()) + 1
            before = seen.get(part, np.zeros(0, np.int64))
            before = np.concatenate([before, np.zeros(max(top - len(before), 0), np.int64)])
            order = own[np.argsort(lengths[own], kind="stable")]
            ordered = lengths[order]
            first = np.searchsorted(ordered, ordered, "left")
            number[order] = np.arange(len(ordered)) - first + before[ordered]
            np.add.at(before, ordered, 1)
            seen[part] = before
        yield pa.record_batch([*batch.columns, pa.array(number)], names=[*batch.schema.names, "number"])


def _placed(runs: np.ndarray) -> Callable:
    keys = (runs[:, 0] << 48) + runs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, numbers = (batch.column(batch.schema.names.index(c)).to_numpy() for c in ("length", "number"))
            row = runs[np.searchsorted(keys, (lengths << 48) + numbers, "right") - 1]
            within = numbers - row[:, 1]
            sequence = row[:, 3] + within // row[:, 4]
            offset = row[:, 5] + within % row[:, 4] * lengths
            names = [c for c in batch.schema.names if c != "number"]
            yield pa.record_batch([*(batch.column(batch.schema.names.index(c)) for c in names), pa.array(sequence), pa.array(offset)],
                                  names=[*names, "sequence_id", "offset"])
    return run


def pack_documents(documents: DataFrame, path: str, capacity: int = 4096, closing: int = 1, id_column: str = "doc_id",
                   text_column: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    pieces = cut_lineage(cut_pieces(documents, path, capacity, closing, id_column, text_column))
    pieces = pieces.withColumn("part", F.spark_partition_id())
    counted = cut_lineage(pieces.groupBy("part", "length").count())
    histogram = np.zeros(capacity + 1, np.int64)
    for length, many in counted.groupBy("length").agg(F.sum("count")).collect():  # at most ``capacity`` rows
        histogram[length] = many
    runs, _ = pack(histogram, capacity)
    if not len(runs):
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).drop("part")
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("part", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    kind = pieces.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    local = pieces.mapInArrow(_numbered, f"{columns}, part int, number long")
    numbered = local.join(before, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("before")).alias("number"))
    return numbered.mapInArrow(_placed(runs), f"{columns}, sequence_id long, offset long")
