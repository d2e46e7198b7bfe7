"""The splitting of texts before byte-pair merging, as a finite-state transducer over many texts at once.

Characters become symbols (a letter, a digit, white space before something solid, ...), and a small
deterministic transducer reads them and says where a piece begins. Its run over a long text is cut into
chunks: each chunk is turned into a map from the state before it to the state after it, the maps
are composed by a parallel prefix scan, and with every chunk's first state known all chunks are run at
once. Both public patterns differ only in their transition tables.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

from tallyloom.llm import arrays

CHUNK_SYMBOLS = 64

# Symbols. C1 is a letter that makes a contraction after an apostrophe, C2 one that does so together with the
# next letter; white space is told apart by whether something solid follows.
LETTER, C1, C2, DIGIT, OTHER, APOSTROPHE, SPACE_SOLID, WHITE_SOLID, WHITE_WHITE = range(9)
SYMBOLS = 9
# States: between pieces, inside one of a kind, after a space that belongs to what follows, after an
# apostrophe that may begin a contraction, and before the last letter of one.
START, IN_LETTERS, IN_DIGITS, IN_OTHERS, AFTER_SPACE, IN_WHITE, AFTER_APOSTROPHE, LAST_OF_CONTRACTION = range(8)
STATES = 8

# The white space of Unicode.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """For every code point: LETTER, DIGIT, OTHER or WHITE_WHITE."""
    table = np.full(0x110000, OTHER, np.uint8)
    for point in range(0x110000):
        major = unicodedata.category(chr(point))[0]
        if major == "L":
            table[point] = LETTER
        elif major == "N":
            table[point] = DIGIT
    table[WHITE] = WHITE_WHITE
    return table


def transitions(keeps_spaces: bool) -> tuple[np.ndarray, np.ndarray]:
    """``next[symbol, state]`` and ``begins[symbol, state]``: does a piece begin at this symbol?

    With ``keeps_spaces`` a space goes with the piece after it, digits form runs, and white space forms
    pieces; without, each digit is a piece and white space ends up in pieces to be dropped. Symbols from
    ``SYMBOLS`` on are the same symbols as the first of a text.
    """
    first = {LETTER: IN_LETTERS, C1: IN_LETTERS, C2: IN_LETTERS, DIGIT: IN_DIGITS if keeps_spaces else START,
             OTHER: IN_OTHERS, APOSTROPHE: AFTER_APOSTROPHE, SPACE_SOLID: AFTER_SPACE if keeps_spaces else START,
             WHITE_SOLID: START, WHITE_WHITE: IN_WHITE}
    letters, others = (LETTER, C1, C2), (OTHER, APOSTROPHE)
    stays = {(IN_LETTERS, s): IN_LETTERS for s in letters}
    stays |= {(state, s): IN_OTHERS for state in (IN_OTHERS, AFTER_APOSTROPHE) for s in others}
    stays |= {(AFTER_SPACE, s): IN_LETTERS for s in letters} | {(AFTER_SPACE, s): IN_OTHERS for s in others}
    stays |= {(IN_DIGITS, DIGIT): IN_DIGITS, (AFTER_SPACE, DIGIT): IN_DIGITS, (IN_WHITE, WHITE_WHITE): IN_WHITE}
    stays |= {(AFTER_APOSTROPHE, C1): START, (AFTER_APOSTROPHE, C2): LAST_OF_CONTRACTION}
    stays |= {(LAST_OF_CONTRACTION, s): START for s in range(SYMBOLS)}
    following = np.zeros((2 * SYMBOLS, STATES), np.uint8)
    begins = np.ones((2 * SYMBOLS, STATES), bool)
    for symbol in range(SYMBOLS):
        following[[symbol, symbol + SYMBOLS]] = first[symbol]
        for state in range(STATES):
            if (state, symbol) in stays:
                following[symbol, state], begins[symbol, state] = stays[state, symbol], False
    return following, begins


# Behind an apostrophe: 1 for a letter that ends a contraction, else the letter that has to follow.
_CONTRACTIONS = np.zeros(128, np.uint32)
_CONTRACTIONS[[*b"stmd"]] = 1
_CONTRACTIONS[[*b"rv"]], _CONTRACTIONS[[*b"l"]] = 101, 108


def symbols_of(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Symbols of all texts; ``starts`` are the first places of non-empty texts."""
    symbols = kinds()[points]
    after = np.empty_like(points)
    after[:-1], after[-1:] = points[1:], 32
    after[starts[1:] - 1] = 32  # behind the end of a text counts as white space
    # Only letters right behind an apostrophe can make a contraction; elsewhere they are letters like others.
    quotes = np.flatnonzero(points == 39)
    symbols[quotes] = APOSTROPHE
    behind = quotes[quotes < len(points) - 1] + 1
    letter, then = points[behind], after[behind]
    ends = _CONTRACTIONS[np.minimum(letter, 127)]
    symbols[behind[ends == 1]] = C1
    symbols[behind[(ends > 1) & (ends == then)]] = C2
    white = symbols == WHITE_WHITE
    before_solid = white & (kinds()[after] != WHITE_WHITE)
    symbols[before_solid] = np.where(points[before_solid] == 32, SPACE_SOLID, WHITE_SOLID)
    symbols[starts] += SYMBOLS
    return symbols


def compose_prefixes(maps: np.ndarray) -> np.ndarray:
    """Row i: the composition of maps 0 to i (first map applied first), in logarithmically many steps."""
    maps, reach = maps.copy(), 1
    while reach < len(maps):
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
        reach *= 2
    return maps


def beginnings(symbols: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Where pieces begin."""
    following, begins = tables
    n = len(symbols)
    padded = np.zeros(-(-n // CHUNK_SYMBOLS) * CHUNK_SYMBOLS, np.uint8)
    padded[:n] = symbols
    columns = np.ascontiguousarray(padded.reshape(-1, CHUNK_SYMBOLS).T).astype(np.intp) * STATES
    table = following.ravel()
    maps = np.tile(np.arange(STATES, dtype=np.intp), (columns.shape[1], 1))
    for column in columns:
        maps = table[column[:, None] + maps].astype(np.intp)
    state = np.zeros(columns.shape[1], np.intp)
    state[1:] = compose_prefixes(maps)[:-1, START]
    out = np.empty(columns.shape, bool)
    flags = begins.ravel()
    for k, column in enumerate(columns):
        place = column + state
        out[k] = flags[place]
        state = table[place].astype(np.intp)
    return np.flatnonzero(out.T.ravel()[:n])


def points_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Code points of UTF-8 texts, the texts' offsets in them, and each point's byte (None: the same)."""
    if not len(data) or data.max() < 128:
        return data.astype(np.uint32), offsets, None
    leads = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, np.searchsorted(leads, offsets), leads


def pieces(data: np.ndarray, offsets: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and hash of every piece of all texts; pieces do not cross texts and leave no gap."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    points, places, leads = points_of(data, offsets)
    starts = np.unique(places[:-1][places[:-1] < places[1:]])
    begun = beginnings(symbols_of(points, starts), tables)
    begun = begun if leads is None else leads[begun]
    ends = np.append(begun[1:], len(data))
    return begun, ends, arrays.word_hashes(data, begun, ends)
