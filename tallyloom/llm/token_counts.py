"""Token counts of a byte-level BPE tokenizer, by a compiled finite-state transducer.

Two transducers are run one after the other. The first splits texts into pieces (``pretokens``), by state
maps of chunks that are composed with a parallel prefix scan. The second reads a piece's bytes; each of its
transitions is annotated with the number of tokens that it adds (which is negative where a byte lets tokens
merge), so the count of a piece is the sum along its path, from one start state that every piece begins in.

The second is deterministic and compiled as far as texts need it. It rests on a property of BPE: a
sequence of tokens is the encoding of its bytes if and only if each pair of neighbours is the encoding of
theirs. So of all tokens that end at a byte, exactly one can follow the encoding of what stands before
it, and it is enough to know, for each token that has begun and may still grow, how far it is, which
token it would follow, and how many tokens lie behind the current count. A state is a set of such
entries, of which there are finitely many; equal sets are one state.

Counts of pieces are remembered by their hash. Texts that hold the string of a special token are rare
and go to the tokenizer itself.

Defined cases: NULL is the empty text, with 0 tokens. Every input row comes back; other columns are not
read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import arrays, pretokens
from tallyloom.llm.shipping import shipped

# Pieces that a Python process remembers, some 100 bytes each.
REMEMBERED = 400_000
# States of the compiled transducer; when there are more, compiling begins anew.
MOST_STATES = 300_000


def byte_characters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves,
    the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Counts the tokens of a piece; transitions are made when first needed."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        tokens = {bytes([b]) for b in range(256)} | {a + b for a, b in merges}
        self.tokens = tokens
        self.prefixes = {token[:k] for token in tokens for k in range(1, len(token))}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        # An entry: bytes of the token that has begun, token before it (None at the start), tokens counted
        # before it minus tokens counted now.
        self.states = {((b"", None, 0),): 0}
        self.entries = [((b"", None, 0),)]
        self.following: list[dict[int, tuple[int, int]]] = [{}]

    def encode(self, piece: bytes) -> list[bytes]:
        """Plain BPE: always the first of the pairs with the lowest rank."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(pair, 1 << 60), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit(self, left: bytes, right: bytes) -> bool:
        pair = (left, right)
        if pair not in self.fits:
            if len(self.fits) > 4 * REMEMBERED:
                self.fits.clear()
            self.fits[pair] = self.encode(left + right) == [left, right]
        return self.fits[pair]

    def step(self, state: int, byte: int) -> tuple[int, int]:
        last, behind, grown = None, 0, []
        for begun, before, rest in self.entries[state]:
            begun = begun + bytes([byte])
            if begun in self.tokens and (before is None or self.fit(before, begun)):
                last, behind = begun, rest + 1
            if begun in self.prefixes:
                grown.append((begun, before, rest))
        # The count changes by ``behind``; entries are relative to the new count.
        key = tuple(sorted((begun, before or b"", before is None, rest - behind) for begun, before, rest in grown))
        entries = (*((begun, None if none else before, rest) for begun, before, none, rest in key), (b"", last, 0))
        target = self.states.get(entries)
        if target is None:
            target = self.states[entries] = len(self.entries)
            self.entries.append(entries)
            self.following.append({})
        self.following[state][byte] = (target, behind)
        return target, behind

    def count(self, piece: bytes) -> int:
        if len(self.entries) > MOST_STATES:
            self.reset()
        state, total = 0, 0
        for byte in piece:
            found = self.following[state].get(byte)
            state, added = found if found is not None else self.step(state, byte)
            total += added
        return total


@lru_cache(maxsize=2)
def _compiled(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    splits = described.get("pre_tokenizer") or {}
    if splits.get("type") != "ByteLevel" or splits.get("add_prefix_space") or described.get("normalizer"):
        raise ValueError(f"{path} is not a plain byte-level tokenizer")
    byte_of = byte_characters()
    raw = lambda token: bytes(byte_of[c] for c in token)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in described["model"]["merges"]]
    special = [x["content"].encode() for x in described.get("added_tokens", [])]
    return (Transducer([(raw(a), raw(b)) for a, b in merges]), Tokenizer.from_file(path), special,
            pretokens.transitions(keeps_spaces=True), {})


def holding(data: np.ndarray, offsets: np.ndarray, strings: list[bytes]) -> list[int]:
    """The texts that hold one of the strings."""
    found, whole = set(), data.tobytes()
    for string in strings:
        at = whole.find(string)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, "right")) - 1
            if at + len(string) <= offsets[row + 1]:
                found.add(row)
            at = whole.find(string, at + 1)
    return sorted(found)


def counts_of(texts: pa.Array, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, tokens)`` of consecutive texts."""
    transducer, tokenizer, special, tables, remembered = _compiled(path)
    if len(remembered) > REMEMBERED:
        remembered.clear()
    for row, data, offsets in arrays.chunks(texts):
        starts, ends, hashes = pretokens.pieces(data, offsets, tables)
        known, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        counts = [remembered.get(h) for h in known.tolist()]
        for i, count in enumerate(counts):
            if count is None:
                at = where[i]
                counts[i] = transducer.count(data[starts[at]:ends[at]].tobytes())
                remembered[int(known[i])] = counts[i]
        sums = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(np.array(counts, np.int64)[inverse], out=sums[1:])
        tokens = np.diff(sums[np.searchsorted(starts, offsets)])
        for i in holding(data, offsets, special):
            text = data[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8")
            tokens[i] = len(tokenizer.encode(text, add_special_tokens=False).ids)
        yield row, np.diff(offsets), tokens


def _count(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sizes, tokens in counts_of(batch.column(1), path):
                yield pa.record_batch([batch.column(0).slice(row, len(sizes)), pa.array(sizes), pa.array(tokens)],
                                      names=["doc_id", "n_bytes", "n_tokens"])
    return run


def count_tokens(documents: DataFrame, path: str, limit: int = 1024, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit``. ``path``: a tokenizer file that every
    executor can open."""
    own = shipped(documents).select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    counted = own.mapInArrow(_count(path), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
