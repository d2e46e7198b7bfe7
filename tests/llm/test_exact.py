"""Operators against plain Python versions, on given tables and on small hand-made rows."""

import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from given_rows import documents  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import decontaminate, licenses, near_dups, packing, pretokens, suffix_dedup, token_counts
from tallyloom.llm.queries import ORACLE, QUERIES, tokenizer_file

FOLDER = "/root/testdata/sf0.001"
ODD = ["", None, " ", "one", "two words", "A b C d", "É é ß 日本 \U0001f642", "x" * 400, "ab " * 700, "\n\t a \x0b b ", "<|endoftext|> and <|startoftext|>"]


def rows_of(spark, name="documents"):
    return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/{name}.parquet").select("doc_id", "text").collect()]


def odd_rows():
    base = "the quick brown fox jumps over the lazy dog and then it runs away from all the other animals " * 3
    near = base.replace("lazy", "sleepy", 1)
    texts = ODD + [base, base, base.upper(), near, near + " end", base[:120], base[60:], None]
    return list(enumerate(texts, 1))


# --- repeated strings --------------------------------------------------------------------------

def removed(frame):
    return {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in suffix_dedup.remove_repeats(frame).collect()}


def test_repeats_equal_brute_force(spark, documents):
    rows = odd_rows()
    assert removed(documents(rows)) == brute.repeats_removed(rows)
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert removed(frame) == brute.repeats_removed(rows_of(spark))


def test_repeats_of_missing_and_repeated_ids(documents):
    text = "0123456789" * 6
    out = suffix_dedup.remove_repeats(documents([(1, text), (1, text), (None, text), (None, text), (2, text[5:])])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in out) == [(0, 60), (0, 60), (1, 0), (1, 0), (2, 55)]
    assert suffix_dedup.remove_repeats(documents([])).collect() == []


@given(st.lists(st.text("ab", min_size=0, max_size=120), min_size=1, max_size=8), st.integers(1, 5))
@settings(max_examples=30, deadline=None)
def test_repeats_of_texts_with_few_letters(texts, partitions):
    """The blobs by hand, without Spark: many equal grams, ties and periods."""
    data = [t.encode() for t in texts]
    held = suffix_dedup.Contexts(partitions)
    held.add(np.arange(len(data)), np.arange(len(data)), np.frombuffer(b"".join(data), np.uint8),
             np.concatenate([[0], np.cumsum([len(d) for d in data])]))
    parts = {}
    for part, blob in held.blobs():
        parts.setdefault(part, []).append(blob)
    gone = [bytearray(len(d)) for d in data]
    for blobs in parts.values():
        for ids, _, starts, ends in suffix_dedup.removals(blobs):
            for i, a, b in zip(ids, starts, ends):
                gone[i][a:b] = b"\x01" * (b - a)
    want = brute.repeats_removed(list(enumerate(texts)))
    assert {i: sum(g) for i, g in enumerate(gone)} == {i: w[1] for i, w in want.items()}


@given(st.lists(st.text("abc", min_size=66, max_size=66), min_size=1, max_size=40))
@settings(max_examples=30, deadline=None)
def test_deep_shallow_sorts_suffixes(texts):
    data = np.frombuffer("".join(texts).encode() + b"\0" * 16, np.uint8)
    places = np.arange(0, 66 * len(texts), 3)
    places = places[places % 66 <= 16]
    strings = [data[p:p + 50].tobytes() for p in places]
    order, group = suffix_dedup.deep_shallow(data, places)
    assert [strings[i] for i in order] == sorted(strings)
    assert all((strings[order[i]] == strings[order[i - 1]]) == (group[i] == group[i - 1]) for i in range(1, len(order)))


# --- near duplicates ---------------------------------------------------------------------------

def test_near_duplicates_equal_brute_force(spark, documents):
    for rows in (odd_rows(), rows_of(spark)):
        got = near_dups.near_duplicates(documents(rows)).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near_duplicates(rows)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_a_large_group_of_near_copies(spark, documents):
    """Every copy differs from the others in some places; many pairs are just above or below the limit."""
    random = np.random.RandomState(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in random.choice(120, random.randint(0, 7), replace=False):
            words[at] = f"x{random.randint(1000)}"
        rows.append((i, " ".join(words)))
    got = near_dups.near_duplicates(documents(rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: c for d, (_, c) in brute.near_duplicates(rows).items()}


def test_near_duplicates_of_missing_and_repeated_ids(documents):
    a, b = "a b c d e f g h", "k l m n o p q r"
    out = near_dups.near_duplicates(documents([(3, a), (None, a), (None, "z"), (3, b), (5, b), (7, None)])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in out) == [
        (0, 0, True), (0, 3, False), (3, 3, True), (3, 3, True), (5, 3, False), (7, 7, True)]
    assert near_dups.near_duplicates(documents([])).collect() == []
    kept = near_dups.deduplicate(documents([(1, a), (2, a), (3, b), (None, b)])).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 3]


def test_register_estimates_are_corrected(spark):
    random = np.random.RandomState(0)
    errors = []
    for shared in (0, 100, 300, 900):
        values = random.randint(0, 2**62, 2000 - shared).astype(np.uint64)
        a, b = values[:1000], values[1000 - shared:2000 - shared]
        regs = near_dups.registers_of(np.concatenate([a, b]), np.array([0, 1000]))
        estimate = near_dups.estimates((regs[:1] == regs[1:]), np.array([1000.0]), np.array([1000.0]))[0]
        errors.append(abs(estimate - shared / (2000 - shared)))
    assert max(errors) < 0.1


# --- benchmark ---------------------------------------------------------------------------------

def test_contamination(spark, documents):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(7, item), (70, "Short ITEM"), (8, None), (9, "..."), (71, "short item")], "item_id long, text string")
    docs = documents([(1, "zero ONE two-three four five six seven eight nine ten, eleven twelve"), (2, "a short item here"), (3, None),
                      (4, "one two three four five six seven eight nine"), (2, "a short item here"), (None, "short item"), (5, "")])
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.items, r.contaminated) for r in decontaminate.contamination(docs, bench).collect())
    assert got == [(0, 2, 2, ["70", "71"], True), (1, 13, 11, ["7"], True), (2, 4, 2, ["70", "71"], True), (2, 4, 2, ["70", "71"], True),
                   (3, 0, 0, [], False), (4, 9, 0, [], False), (5, 0, 0, [], False)]
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()) == [3, 4, 5]
    cleaned = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, remove="spans").collect()}
    assert cleaned[1] == "zero twelve" and cleaned[2] == "a here" and cleaned[3] is None and cleaned[None] == ""
    assert decontaminate.contamination(documents([]), bench).collect() == []
    assert not any(r.contaminated for r in decontaminate.contamination(docs, bench.where("false")).collect())


def test_contamination_beyond_the_broadcast(spark, documents, monkeypatch):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(7, item), (70, "Short ITEM"), (71, "short item")], "item_id long, text string")
    docs = documents([(1, f"zero {item} twelve"), (2, "a short item here"), (3, None), (2, "a short item here"), (None, "short item"), (5, "")])
    small = sorted(map(repr, decontaminate.contamination(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "MAX_WINDOWS", 1)
    assert sorted(map(repr, decontaminate.contamination(docs, bench).collect())) == small
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()) == [3, 5]
    node = decontaminate.hits_of(decontaminate._marked(docs, "doc_id", "text"), bench, 10)._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().apply(0)
    sent = node.children().apply(0).output()
    assert "words" not in {sent.apply(i).name() for i in range(sent.size())}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_their_sql(spark, name):
    from compare import connect, of_spark, of_sql
    assert of_spark(QUERIES[name](spark, FOLDER)) == of_sql(connect(FOLDER), ORACLE[name])


# --- tokens ------------------------------------------------------------------------------------

PIECES = st.lists(st.sampled_from([" ", "  ", "\n", "'", "'s", "'re", "'LL", "don't", "a", "the", "é", "1", "23", "!", "...", "日本", "ж", "İ",
                                   "Σ", "\u0301", "\u00a0", "\U0001f642", "<|endoftext|>", "<|endof", "\r\n", "²", "x" * 70]), max_size=25).map("".join)


@given(st.lists(PIECES, min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_tokens_equal_the_library(texts):
    from tokenizers import Tokenizer
    for name, ours in (("byte_bpe_50k.json", lambda p: [n for _, _, c in token_counts.counts_of(pa.array(texts), p) for n in c]),
                       ("word_bpe_49k.json", lambda p: [ids[a:b].tolist() for _, ids, at in packing.token_ids(pa.array(texts), p)
                                                        for a, b in zip(at[:-1], at[1:])])):
        path = tokenizer_file(name)
        want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
        assert ours(path) == ([len(w) for w in want] if name.startswith("byte") else want)


def test_prefix_scan_equals_stepping():
    random = np.random.RandomState(1)
    following, begins = pretokens.transitions(True)
    symbols = random.randint(0, 2 * pretokens.SYMBOLS, 1000).astype(np.uint8)
    state, want = pretokens.START, []
    for i, s in enumerate(symbols):
        if begins[s, state]:
            want.append(i)
        state = following[s, state]
    assert pretokens.beginnings(symbols, (following, begins)).tolist() == want


def test_token_counts_of_odd_rows(documents):
    got = token_counts.count_tokens(documents([(1, None), (1, ""), (None, "a b"), (2, "word " * 2000)]), tokenizer_file("byte_bpe_50k.json")).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens > 0, r.over_limit) for r in got) == [
        (0, 3, True, False), (1, 0, False, False), (1, 0, False, False), (2, 10000, True, True)]


# --- packing -----------------------------------------------------------------------------------

@given(st.dictionaries(st.integers(1, 64), st.integers(1, 400), max_size=30))
@settings(max_examples=40, deadline=None)
def test_plans_hold_every_piece_once(histogram):
    counts = np.zeros(65, np.int64)
    for length, many in histogram.items():
        counts[length] = many
    runs, sequences = packing.pack(counts, 64)
    fill, seen = np.zeros(sequences, np.int64), np.zeros(65, np.int64)
    for length, first, many, sequence, per, offset in runs:
        assert first == seen[length] and many % per == 0 and offset + per * length <= 64
        seen[length] += many
        fill[sequence:sequence + many // per] += per * length
    assert (seen == counts).all() and (not sequences or fill.max() <= 64 and fill.min() > 0)
    if counts.sum():
        best = -(-(counts * np.arange(65)).sum() // 64)
        assert sequences <= 1.25 * best + 2 or sequences <= counts[33:].sum() + best


def test_few_lengths_reach_the_program_bound():
    """No configuration is filled to 99.5 %, and best fit alone needs 1100 sequences."""
    counts = np.zeros(4097, np.int64)
    counts[[2070, 1095, 1055, 935]] = 600, 600, 600, 1200
    used, bound = packing.fractional(counts, 4096)
    covered = np.zeros(4097)
    for config, times in used.items():
        assert sum(n * k for n, k in config) <= 4096
        for n, k in config:
            covered[n] += k * times
    assert (covered >= counts - 1e-6).all() and 899 <= bound <= sum(used.values()) <= 1.01 * bound
    runs, sequences = packing.pack(counts, 4096)
    assert bound - 1e-6 <= sequences <= 905 and runs[:, 2].sum() == counts.sum()


def test_many_lengths_are_covered_by_the_program():
    """A real histogram: the fractional solution covers all, and best fit gets at most a twentieth of the tokens."""
    random = np.random.RandomState(2)
    counts = np.bincount(np.clip(random.lognormal(5.5, 1.1, 8000).astype(int), 1, 4096), minlength=4097)
    stands, demand = packing.grouped(counts)
    assert np.count_nonzero(demand) <= packing.GROUPS + 1 and (stands[stands > 0] >= np.flatnonzero(stands)).all()
    used, bound = packing.fractional(demand, 4096)
    covered = np.zeros(4097)
    for config, times in used.items():
        for n, k in config:
            covered[n] += k * times
    assert (covered >= demand - 1e-6).all() and sum(used.values()) <= 1.01 * bound
    chosen, left = packing._slots(packing.rounded(demand, 4096)[0], counts, stands)
    tokens = (counts * np.arange(4097)).sum()
    assert (left * np.arange(4097)).sum() <= 0.06 * tokens
    assert packing.pack(counts, 4096)[1] <= 1.01 * -(-tokens // 4096)


@given(st.lists(st.tuples(st.integers(1, 30), st.floats(0.01, 1)), min_size=1, max_size=6, unique_by=lambda x: x[0]), st.integers(0, 40))
@settings(max_examples=40, deadline=None)
def test_knapsack_equals_plain_recursion(items, room):
    sizes, prices = np.array([i[0] for i in items]), np.array([i[1] for i in items])
    best = [0.0] * 41
    for r in range(1, 41):
        best[r] = max([best[r - 1], *(best[r - s] + p for s, p in items if s <= r)])
    sack = packing.Knapsack(sizes, prices, 40)
    content = sack.filling(room)
    assert sum(int(sizes[j]) * k for j, k in content.items()) <= room
    assert abs(sum(prices[j] * k for j, k in content.items()) - best[room]) < 1e-9


def thue_morse(length):
    text = "a"
    while len(text) < length:
        text += text.translate({97: 98, 98: 97})
    return text, text.translate({97: 98, 98: 97})


def test_texts_that_collide_under_polynomial_hashes(spark, documents):
    """Words, and sequences of words, for which a polynomial modulo a power of two has equal hashes."""
    from tokenizers import Tokenizer
    texts = [t for n in (1024, 2048) for t in thue_morse(n)]
    texts += [" ".join({"a": "yes", "b": "no"}[c] for c in t) for t in thue_morse(1024)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        want = [e.ids for e in Tokenizer.from_file(tokenizer_file(name)).encode_batch(texts, add_special_tokens=False)]
        if name.startswith("byte"):
            assert [n for _, _, c in token_counts.counts_of(pa.array(texts), tokenizer_file(name)) for n in c] == [len(w) for w in want]
        else:
            assert [ids[a:b].tolist() for _, ids, at in packing.token_ids(pa.array(texts), tokenizer_file(name)) for a, b in zip(at[:-1], at[1:])] == want
    padded = [f"one two three four {t}" for t in texts[:4]]
    for _, sets in near_dups.shingle_sets(pa.array(padded + texts[:4])):
        assert len({s.tobytes() for s in sets}) == len(sets)


def test_packed_documents(spark, documents):
    path = tokenizer_file("word_bpe_49k.json")
    rows = odd_rows() + [(1, "again"), (None, "no id"), (99, "word " * 9000)]
    got = packing.pack_documents(documents(rows), path, capacity=512).collect()
    from tokenizers import Tokenizer
    encode = Tokenizer.from_file(path).encode
    want = []
    for doc_id, text in rows:
        ids = np.array([*encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(doc_id or 0, k, k * 512, len(ids[k * 512:k * 512 + 512]), zlib.crc32(ids[k * 512:k * 512 + 512].tobytes()))
                 for k in range(-(-len(ids) // 512))]
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 512
    assert len(places) <= -(-sum(r.length for r in got) // 512) + 1
    assert packing.pack_documents(documents([]), path).collect() == []


# --- licenses ----------------------------------------------------------------------------------

def test_license_places_equal_a_plain_scan(spark, documents):
    texts = ODD + ["Apache License; MIT license. CC-BY cc by, the GNU General Public License v3", "gnu general public", "mit\nlicense mit license",
                   "Licensed under the Apache License, Version 2.0.", "Permission is hereby granted, free of charge, to any person"]
    for rows in (list(enumerate(texts)), rows_of(spark)):
        got = licenses.scan_licenses(documents(rows)).collect()
        assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, ",".join(r.base_labels)) for r in got} == {
            d: brute.license_places(t) for d, t in rows}
        assert all(set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1 and bool(r.labels) == (r.score > 0) for r in got)
    assert licenses.scan_licenses(documents([])).collect() == []
