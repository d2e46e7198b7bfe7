"""Texts as numpy arrays inside Arrow tasks: bytes of many documents at once, words and their hashes.

Everything works on UTF-8 bytes. Lower-casing A-Z and the word classes of this subpackage only look at
ASCII, so bytes give the same words as characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text handled at once; bounds a task's memory. One longer document is handled alone.
CHUNK = 1 << 20

U64 = np.uint64
_random = np.random.RandomState(20240229)
_TABLE = _random.randint(0, 2**63, 256).astype(U64) * U64(2) + _random.randint(0, 2, 256).astype(U64)
MULTIPLIER = U64(0x9E3779B97F4A7C15)
INVERSE = U64(pow(int(MULTIPLIER), -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Bytes of words, after lower-casing: [^\x00-\x2F\x3A-\x60\x7B-\x7F] and [^\x20\x09-\x0D].
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
SOLID = np.ones(256, bool)
SOLID[[32, *range(9, 14)]] = False


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` of consecutive rows of about ``size`` bytes; NULL is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64 if wide else np.int32)[
        texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        stop = min(stop, len(texts))
        yield row, data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row]
        row = stop


def _powers(base: np.uint64):
    held = np.ones(1, U64)

    def upto(n: int) -> np.ndarray:
        nonlocal held
        if len(held) < n:
            more = np.full(max(n, CHUNK + 64), base, U64)
            more[0] = 1
            grown = np.multiply.accumulate(more)
            if n > 4 * CHUNK:  # not kept: a long document must not blow up the task for good
                return grown
            held = grown
        return held[:n]

    return upto


powers, inverse_powers = _powers(MULTIPLIER), _powers(INVERSE)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hashes`` takes the hash of any span."""
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_TABLE[data] * powers(len(data)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal for equal bytes, wherever they stand."""
    return mixed((sums[ends] - sums[starts]) * inverse_powers(len(sums))[starts])


def _eights(data: np.ndarray) -> np.ndarray:
    """At every place the eight bytes from there on, as one number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


_MASKS = np.array([0] + [(1 << 8 * k) - 1 for k in range(1, 9)], U64)
_LENGTH, _PLACE = U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans, by their bytes alone.

    Eight bytes at a time are mixed with their place, then summed: strings of at most eight bytes and equal length
    never collide, and since each summand is mixed first, longer ones do not cancel out as under a polynomial
    modulo a power of two, where a Thue-Morse word and its complement are equal.
    """
    lengths = (ends - starts).astype(np.int64)
    if not len(lengths):
        return np.zeros(0, U64)
    eights = _eights(data)
    out = mixed(eights[starts] & _MASKS[np.minimum(lengths, 8)])
    long = np.flatnonzero(lengths > 8)
    if len(long):
        more = (lengths[long] - 1) // 8
        last = np.cumsum(more)
        place = np.arange(1, last[-1] + 1) - np.repeat(last - more, more)
        at = np.repeat(starts[long], more) + 8 * place
        blocks = eights[at] & _MASKS[np.minimum(np.repeat(ends[long], more) - at, 8)]
        summands = mixed(mixed(blocks) ^ (place.astype(U64) * _PLACE))
        out[long] += np.add.reduceat(summands, last - more)
    return mixed(out + lengths.astype(U64) * _LENGTH)


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of every document, and the number of words before each document."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind[data]
    before, after = inside[:-2].copy(), inside[2:].copy()
    cuts = offsets[1:-1]
    before[cuts[cuts < len(data)]] = False
    after[cuts[cuts > 0] - 1] = False
    inside = inside[1:-1]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)
