"""PII: format-preserving pseudonyms by a keyed Feistel permutation.

Found in texts and checked: card numbers (13 to 19 digits, Luhn), IBANs (check digits), phone numbers of ten digits
in three groups and others with a country code, IPv4 addresses, US social security numbers, calendar dates
from 1900 to 2099, and e-mail addresses. Each is read as a number in the set of all values of its format, the number is
permuted by a Feistel network whose round function is a keyed hash, walking the cycle until the result
is in the set again, and written back in the same format with the same separators; check digits are made
anew. So every value has one pseudonym under a key, equal values stay linked across documents, different
values stay different, and whoever has the key can undo it (``inverse=True``). Of an e-mail address
the letters and digits of the local part are permuted among letters and digits; the domain stays.

All work is per row in Arrow batches; nothing is shuffled or gathered. Candidates are found by a scan for digits and ``@``:
from each start every kind and length that passes its check (card numbers by prefix sums of the digits, so a
line of numbers takes time in proportion to its length). Where candidates overlap, those are read that together cover
most: a digit or letter counts eight, in a card of unusual form (length and first digits, grouping) one; a card has spaces or
hyphens, not both; at equal cover other kinds go before cards. So a number that is only by chance a card, made of parts of its neighbours, does not
take their place. A value's pseudonym depends on the value and the key alone, so equal values stay linked whatever is beside them.

Defined cases: NULL texts stay NULL and empty ones empty; numbers that fail their check are left as they are; a text
keeps its number of characters, and texts of any length are read in linear time; rows are independent, so repeated rows
and ids, ties and empty tables need no rule. All other columns are passed through, whatever their names. Undoing reads
the pseudonyms anew; where, in rare cases, their digits and numbers beside them form another value by chance, it
may read that.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import string
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shipping import shipped

ROUNDS = 10
# Pseudonyms that a task remembers, some 200 bytes each.
REMEMBERED = 200_000

KINDS = ("email", "iban", "card", "phone", "ip", "ssn", "date")

EMAIL_RIGHT = re.compile(r"[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}", re.ASCII)
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", re.ASCII)
IBAN_RUN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){8,31}", re.ASCII)
IBAN_LENGTHS = {country: int(length) for length, countries in (
    ("15", "NO"), ("16", "BE BI"), ("18", "DK FI FK FO GL NL SD"), ("19", "MK SI"), ("20", "AT BA EE KZ LT LU MN XK"),
    ("21", "CH HR LI LV"), ("22", "BG BH CR DE GB GE IE ME RS VA"), ("23", "AE GI IL IQ OM SO TL"),
    ("24", "AD CZ ES MD PK RO SA SE SK TN VG"), ("25", "LY PT ST"), ("26", "IS TR"), ("27", "BF DJ FR GR IT MC MR SM"),
    ("28", "AL AZ BY CY DO GT HU LB NI PL SV"), ("29", "BR EG PS QA UA"), ("30", "JO KW MU YE"), ("31", "MT SC"), ("33", "RU"),
) for country in countries.split()}
# Where a number of any kind may stand, to be read in detail from each START.
SPAN = re.compile(r"[+(0-9][0-9 ().:/\-]{5,}[0-9]", re.ASCII)
START = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}|(?<!\d)\d|[+(]", re.ASCII)
NUMBER = re.compile(r"\d+", re.ASCII)
# How cards of common issuers begin, how many digits they have, and how these are grouped.
ISSUED = [("34 37", 15), ("30 36 38 39", 14), ("2 4 5 6 35", 16)]
GROUPINGS = {(16,), (15,), (14,), (4, 4, 4, 4), (4, 6, 5), (4, 6, 4)}
# One pattern per number of digits.
PHONE = re.compile(r"(?<![\d.+])(?:\+1[ .-]?|1[ .-])?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)", re.ASCII)
FOREIGN = [re.compile(rf"(?<![\d.])\+[1-9](?:[ .()-]{{0,2}}\d){{{n}}}(?!\d)", re.ASCII) for n in range(13, 6, -1)]
OTHERS = [("ip", re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)", re.ASCII)),
          ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", re.ASCII)),
          ("date", re.compile(r"(?<![\d./-])(?:\d{4}[-/.]\d{2}[-/.]\d{2}|\d{2}[-/.]\d{2}[-/.]\d{4})(?![\d])", re.ASCII))]
WORDY = frozenset(string.ascii_letters + string.digits)
LOCAL = WORDY | set("._%+-")
# What a digit of a value counts against one of an unusual card: two such cards do not outweigh a date.
FULL = 8

FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Permutation:
    """Keyed bijections of ``range(size)``, different for every label."""

    def __init__(self, key: bytes, inverse: bool = False):
        self.key, self.inverse = key[:64], inverse

    def _round(self, label: str, turn: int, half: int, mask: int) -> int:
        data = f"{label}|{turn}|{half:x}".encode()
        first = hashlib.blake2b(data, key=self.key, digest_size=64).digest()
        # As many bits as a half has, however long the value.
        more = (hashlib.blake2b(first + bytes([i % 256, i // 256 % 256, i // 65536]), key=self.key, digest_size=64).digest()
                for i in range(mask.bit_length() // 512))
        return int.from_bytes(first + b"".join(more), "big") & mask

    def _once(self, label: str, value: int, bits: int) -> int:
        mask = (1 << bits) - 1
        left, right = value >> bits, value & mask
        turns = range(ROUNDS)
        for turn in reversed(turns) if self.inverse else turns:
            if self.inverse:
                left, right = right ^ self._round(label, turn, left, mask), left
            else:
                left, right = right, left ^ self._round(label, turn, right, mask)
        return left << bits | right

    def __call__(self, label: str, value: int, size: int) -> int:
        if size < 2:
            return value
        bits = ((size - 1).bit_length() + 1) // 2
        label = f"{label}|{size}"
        value = self._once(label, value, bits)
        while value >= size:
            value = self._once(label, value, bits)
        return value


def luhn(digits: str) -> int:
    """The check digit that belongs behind ``digits``."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def iban_check(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(number) % 97:02d}"


def mixed_radix(values: list[int], radices: list[int]) -> int:
    out = 0
    for value, radix in zip(values, radices):
        out = out * radix + value
    return out


def digits_of(value: int, radices: list[int]) -> list[int]:
    out = []
    for radix in reversed(radices):
        value, rest = divmod(value, radix)
        out.append(rest)
    return out[::-1]


def _refill(found: str, digits: str) -> str:
    """The digits of ``found`` replaced in order; everything else stays."""
    fresh = iter(digits)
    return "".join(next(fresh) if c in string.digits else c for c in found)


def _classes(permute: Permutation, label: str, found: str) -> str:
    """Letters and digits permuted together, each staying in its class and case."""
    alphabets = [next((a for a in (string.digits, string.ascii_lowercase, string.ascii_uppercase) if c in a), None) for c in found]
    places = [(c, a) for c, a in zip(found, alphabets) if a]
    radices = [len(a) for _, a in places]
    if not places:
        return found
    shape = "".join({10: "0"}.get(len(a), a[0]) for _, a in places)
    size = mixed_radix([r - 1 for r in radices], radices) + 1
    values = digits_of(permute(f"{label}|{shape}", mixed_radix([a.index(c) for c, a in places], radices), size), radices)
    fresh = iter(a[v] for v, (_, a) in zip(values, places))
    return "".join(next(fresh) if a else c for c, a in zip(found, alphabets))


def pseudonym(permute: Permutation, kind: str, found: str) -> str | None:
    """The pseudonym of a found value, or None if it fails the check of its kind."""
    digits = "".join(c for c in found if c in string.digits)
    if kind == "email":
        local, _, domain = found.rpartition("@")
        return f"{_classes(permute, kind, local)}@{domain}"
    if kind == "iban":
        plain = found.replace(" ", "")
        country, check, rest = plain[:2], plain[2:4], plain[4:]
        if iban_check(country, rest) != check:
            return None
        rest = _classes(permute, f"{kind}|{country}", rest)
        fresh = iter(country + iban_check(country, rest) + rest)
        return "".join(c if c == " " else next(fresh) for c in found)
    if kind == "card":
        if luhn(digits[:-1]) != int(digits[-1]) or not digits.strip("0"):
            return None
        # The leading digit tells the kind of issuer and stays.
        body = digits[0] + f"{permute(f'{kind}|{len(digits)}|{digits[0]}', int(digits[1:-1]), 10 ** (len(digits) - 2)):0{len(digits) - 2}d}"
        return _refill(found, body + str(luhn(body)))
    if kind == "phone":
        # The country code stays; of other countries' numbers the first two digits do.
        keep = len(digits) - 10 if len(digits) == 10 or len(digits) == 11 and digits[0] == "1" else 2
        code, own = digits[:keep], digits[keep:]
        return _refill(found, code + f"{permute(f'{kind}|{code}|{len(own)}', int(own), 10 ** len(own)):0{len(own)}d}")
    if kind == "ip":
        parts = [int(x) for x in found.split(".")]
        if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in found.split(".")):
            return None
        # Octets keep their number of digits, and with it the text its length.
        low = [(0, 10, 100)[len(x) - 1] for x in found.split(".")]
        radices = [(10, 90, 156)[len(x) - 1] for x in found.split(".")]
        size = mixed_radix([r - 1 for r in radices], radices) + 1
        value = permute(f"{kind}|{low}", mixed_radix([p - a for p, a in zip(parts, low)], radices), size)
        return ".".join(str(a + v) for a, v in zip(low, digits_of(value, radices)))
    if kind == "ssn":
        area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
        if area in (0, 666) or area >= 900 or group == 0 or serial == 0:
            return None
        radices = [898, 99, 9999]
        a, b, c = digits_of(permute(kind, mixed_radix([area - 1 - (area > 666), group - 1, serial - 1], radices), 898 * 99 * 9999), radices)
        return _refill(found, f"{a + 1 + (a + 1 >= 666):03d}{b + 1:02d}{c + 1:04d}")
    # Dates: year first, or day first, or month first where the day cannot be a month.
    if len({c for c in found if c not in string.digits}) > 1:
        return None
    parts = re.split(r"[-/.]", found)
    orders = ["ymd"] if len(parts[0]) == 4 else ["dmy", "mdy"]
    for order in orders:
        named = dict(zip(order, parts))
        try:
            day = datetime.date(int(named["y"]), int(named["m"]), int(named["d"])).toordinal()
        except ValueError:
            continue
        if FIRST_DAY <= day <= LAST_DAY:
            new = datetime.date.fromordinal(FIRST_DAY + permute(kind, day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1))
            written = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
            return _refill(found, "".join(written[c] for c in order))
    return None


def emails(text: str) -> dict[int, int]:
    """Begin and end of each e-mail address."""
    found, at, done = {}, text.find("@"), 0
    while at >= 0:
        left = at
        while left > done and text[left - 1] in LOCAL:
            left -= 1
        right = EMAIL_RIGHT.match(text, at + 1) if left < at else None
        if right:
            found[left] = right.end()
        done = at + 1
        at = text.find("@", at + 1)
    return found


def clusters(text: str) -> list[tuple[int, int]]:
    """Places apart from each other, outside of which no value has a character."""
    places = sorted([*emails(text).items(), *(m.span() for m in IBAN_RUN.finditer(text)), *(m.span() for m in SPAN.finditer(text))])
    merged: list[tuple[int, int]] = []
    for low, high in places:
        if merged and low <= merged[-1][1]:
            low, high = merged[-1][0], max(high, merged.pop()[1])
        merged.append((low, high))
    return merged


def usual_card(digits: str, groups: list[int]) -> bool:
    """Whether a card number has the form of a common issuer's."""
    return tuple(groups) in GROUPINGS and any(
        len(digits) == length and digits.startswith(tuple(first.split())) for first, length in ISSUED)


class Reader:
    """Values in one string, each checked where it is found."""

    def __init__(self, text: str, new: Callable[[str, str], str | None]):
        self.text, self.new, self.emails = text, new, emails(text)

    def _valid(self, kind: str, start: int, end: int) -> bool:
        return self.new(kind, self.text[start:end]) is not None

    def _iban(self, start: int) -> int | None:
        run = IBAN_RUN.match(self.text, start)
        if not run:
            return None
        length = IBAN_LENGTHS.get(self.text[start:start + 2])
        ends = [e for e in range(run.end(), start + 11, -1) if self.text[e:e + 1] not in WORDY and self.text[e - 1] != " "]
        # The country's own length first, then any other.
        ends.sort(key=lambda e: len(self.text[start:e].replace(" ", "")) != length)
        for end in ends:
            whole = IBAN.match(self.text, start, end)
            if whole and whole.end() == end and self._valid("iban", start, end):
                return end
        return None

    def _cards(self, low: int, high: int) -> Iterator[tuple[int, int, str, int]]:
        """Cards of 13 to 19 digits with at most one space, or one hyphen, between two; from a start that has a usual one, only that."""
        text = self.text
        numbers = [m.span() for m in NUMBER.finditer(text, low, high)]
        digits = "".join(text[a:b] for a, b in numbers)
        # Digits up to a place with every second one doubled, counted from the front, for either parity.
        sums = [[0], [0]]
        for i, d in enumerate(map(int, digits)):
            twice = 2 * d - 9 * (d > 4)
            sums[0].append(sums[0][-1] + (twice if i % 2 else d))
            sums[1].append(sums[1][-1] + (d if i % 2 else twice))
        at = [0]
        for a, b in numbers:
            at.append(at[-1] + b - a)
        for g, (start, _) in enumerate(numbers):
            if start and text[start - 1] == ".":
                continue
            found, groups, between, h = [], [], None, g
            while True:
                groups.append(at[h + 1] - at[h])
                many = at[h + 1] - at[g]
                if many > 19:
                    break
                if many >= 13:
                    total = sums[(at[h + 1] - 1) % 2]
                    own = digits[at[g]:at[h + 1]]
                    if (total[at[h + 1]] - total[at[g]]) % 10 == 0 and own.strip("0"):
                        usual = usual_card(own, groups)
                        found.append((usual, start, numbers[h][1], many))
                if h + 1 == len(numbers) or numbers[h + 1][0] - numbers[h][1] != 1 or text[numbers[h][1]] not in (between or " -"):
                    break
                between = text[numbers[h][1]]
                h += 1
            for usual, low_, high_, many in found:
                if usual or not any(f[0] for f in found):
                    yield low_, high_, "card", many * (FULL if usual else 1)

    def _others(self, start: int) -> Iterator[tuple[int, int, str, int]]:
        text = self.text
        if start in self.emails:
            yield start, self.emails[start], "email", FULL * (self.emails[start] - start)
        if text[start].isalpha():
            end = self._iban(start)
            if end:
                yield start, end, "iban", FULL * sum(c in WORDY for c in text[start:end])
            return
        found = [("phone", PHONE.match(text, start))]
        if text[start] == "+":
            found += [("phone", pattern.match(text, start)) for pattern in FOREIGN]
        elif text[start] != "(":
            found += [(kind, match) for kind, pattern in OTHERS if (match := pattern.match(text, start)) and self._valid(kind, start, match.end())]
        for kind, match in found:
            if match:
                yield start, match.end(), kind, FULL * sum(c in string.digits for c in match[0])

    def candidates(self, low: int, high: int) -> list[tuple[int, int, str, int]]:
        """``(start, end, kind, weight)`` of all that passes its check, whether or not they overlap."""
        starts = {m.start() for m in START.finditer(self.text, low, high)} | {e for e in self.emails if low <= e < high}
        return [*self._cards(low, high), *(c for start in starts for c in self._others(start))]

    def values(self, low: int, high: int) -> list[tuple[int, int, str]]:
        """The candidates that together weigh most, without overlap; then with fewest cards, then fewest values."""
        found = sorted(self.candidates(low, high), key=lambda c: (c[1], c[0], c[2]))
        ends, best, last = [low], [(0, 0, 0)], [None]
        for candidate in found:
            start, end, kind, weight = candidate
            before = bisect_right(ends, start) - 1
            total = (best[before][0] + weight, best[before][1] - (kind == "card"), best[before][2] - 1)
            if total > best[-1]:
                ends.append(end)
                best.append(total)
                last.append((before, candidate))
        chosen, at = [], len(ends) - 1
        while last[at]:
            at, candidate = last[at]
            chosen.append(candidate[:3])
        return chosen[::-1]


def replaced(text: str, permute: Permutation, known: dict[tuple[str, str], str | None]) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many of each kind."""
    def new(kind: str, found: str) -> str | None:
        key = (kind, found)
        if key not in known:
            if len(known) > REMEMBERED:
                known.clear()
            known[key] = pseudonym(permute, kind, found)
        return known[key]

    out, done, counts = [], 0, {}
    for low, high in clusters(text):
        # With the neighbours that the patterns look at.
        base = max(0, low - 1)
        own = text[base:high + 2]
        for start, end, kind in Reader(own, new).values(low - base, high - base):
            out += [text[done:base + start], new(kind, own[start:end])]
            done = base + end
            counts[kind] = counts.get(kind, 0) + 1
    return "".join([*out, text[done:]]), counts


def _replacing(key: bytes, inverse: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permute, known = Permutation(key, inverse), {}
        for batch in batches:
            at = batch.schema.names.index("_text")
            # A slice at a time, so that a task holds few texts twice.
            for low in range(0, max(batch.num_rows, 1), 512):
                part = batch.slice(low, 512)
                texts, counts = [], []
                for text in part.column(at).to_pylist():
                    new, many = (None, {}) if text is None else replaced(text, permute, known)
                    texts.append(new)
                    counts.append(many)
                columns = [c for i, c in enumerate(part.columns) if i != at]
                names = [n for n in part.schema.names if n != "_text"]
                yield pa.record_batch([*columns, pa.array(texts, pa.string()), *(
                    pa.array([c.get(kind, 0) for c in counts], pa.int64()) for kind in KINDS)],
                    names=[*names, "_new", *(f"_n_{kind}" for kind in KINDS)])
    return run


def pseudonymise(documents: DataFrame, key: bytes, inverse: bool = False, text_column: str = "text",
                 counts: bool = False) -> DataFrame:
    """The documents with pseudonyms in their texts; with ``counts`` also ``n_<kind>`` for every kind."""
    if not key:
        raise ValueError("a key is needed")
    names = [c for c in documents.columns if c != text_column]
    own = shipped(documents).select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(names)), F.col(text_column).alias("_text"))
    schema = ", ".join([*(f"_{i} {own.schema[f'_{i}'].dataType.simpleString()}" for i in range(len(names))), "_new string",
                        *(f"_n_{kind} long" for kind in KINDS)])
    done = own.mapInArrow(_replacing(key, inverse), schema)
    new = {c: F.col(f"_{i}") for i, c in enumerate(names)} | {text_column: F.col("_new")}
    return done.select(*(new[c].alias(c) for c in documents.columns),
                       *(F.col(f"_n_{kind}").alias(f"n_{kind}") for kind in KINDS if counts))
