"""Prefix-tree join, conversation trie and divergence audit against plain Python versions, on given and hand-made rows."""

import brute
import numpy as np
import pytest
from conftest import rows as sorted_rows
from given_rows import documents  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import conversation_trie, divergence, ngram_join
from tallyloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


# --- n-gram join -------------------------------------------------------------------------------

def components(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in frame.collect()}


def family(size, length, edits, base=0, seed=3):
    """Texts that differ from one another in a few words; many pairs are just above or below the limit."""
    random = np.random.RandomState(seed)
    out = []
    for i in range(size):
        words = [f"w{base}x{k}" for k in range(length)]
        for at in random.choice(length, random.randint(0, edits), replace=False):
            words[at] = f"y{random.randint(10_000)}"
        out.append((base + i, " ".join(words)))
    return out


def test_join_equals_brute_force(spark, documents):
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    given_rows = [tuple(r) for r in frame.select("doc_id", "text").collect()]
    odd = family(120, 60, 3) + family(60, 120, 7, 1000) + [
        (5000, None), (5001, ""), (5002, "a b"), (5003, "A b"), (5004, "a b c"), (5005, "word " * 3000), (5006, " \t\n"), (5007, "x" * 70_000)]
    for rows in (given_rows, odd):
        assert components(ngram_join.similar_documents(documents(rows))) == brute.near_duplicates(rows, 4, 85)


def test_groups_beyond_a_block(spark, documents, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "TOKENS", 3000)
    rows = family(150, 60, 4) + family(60, 90, 7, 1000)
    assert components(ngram_join.similar_documents(documents(rows))) == brute.near_duplicates(rows, 4, 85)


def test_join_of_missing_and_repeated_ids(documents):
    a, b = "a b c d e f g h", "k l m n o p q r"
    out = ngram_join.similar_documents(documents([(3, a), (None, a), (None, "z"), (3, b), (5, b), (7, None), (8, a + " i")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in out) == [(0, 0), (0, 3), (3, 3), (3, 3), (5, 3), (7, 7), (8, 8)]
    assert ngram_join.similar_documents(documents([])).collect() == []


@given(st.lists(st.sets(st.integers(0, 25), min_size=1, max_size=18), min_size=1, max_size=25, unique_by=frozenset))
@settings(max_examples=150, deadline=None)
def test_trie_links_connect_what_is_linked(sets):
    arrays_ = [np.array(sorted(s), np.uint64) * np.uint64(2**40 + 1) for s in sets]
    links = ngram_join.trie_links(arrays_)
    assert len(links) < len(sets)

    def labels(pairs):
        label = list(range(len(sets)))
        for i, j in pairs:
            label = [label[i] if x == label[j] else x for x in label]
        return [label.index(x) for x in label]

    alike = lambda i, j: 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])
    assert all(alike(i, j) for i, j in links)
    assert labels(links) == labels([(i, j) for i in range(len(sets)) for j in range(i) if alike(i, j)])


# --- conversations -----------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def test_conversation_trie_of_the_query(spark):
    turns = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op12_conversation_trie"](spark, "/root/testdata/sf0.01")
    assert sorted_rows(got) == brute.prefix_trie(brute.shared_heads(turns))


def test_trie_of_long_and_odd_conversations(spark):
    """Lengths around blocks, copies, ends inside of others, NULLs, negative ids, repeated turns, donors that lack."""
    random = np.random.RandomState(1)
    turns = [(c, k, "u", "x" * (k % 3 + 1) if random.rand() < 0.97 else random.choice(["a", "b"]))
             for c in range(50) for k in range(random.choice([1, 3, 7, 8, 9, 16, 17, 30]))]
    turns += [(100, None, None, None), (100, None, None, "b"), (100, 1, "u", "z"), (100, 1, "u", "z"), (None, 1, "u", "t"), (-5, 0, "u", "x"),
              (-105, 1, "u", "x"), (250, 0, "u", "x"), (777, 0, "u", "é\U0001f642" * 20_000)]
    frame = spark.createDataFrame(turns, TURNS).selectExpr("*", "1 as n", "2 as depth", "'x' as key", "3 as digest")
    digests = conversation_trie.turn_digests(frame)
    got = conversation_trie.trie(*conversation_trie.with_shared_heads(digests))
    assert sorted_rows(got) == brute.prefix_trie(brute.shared_heads(turns))
    assert conversation_trie.prefix_trie(frame.where("false")).collect() == []


def test_trie_of_conversations_as_they_are(spark):
    turns = [(c, k, "u", t) for c, texts in {1: "abc", 2: "abd", 3: "ab", 4: "abc", 5: "x"}.items() for k, t in enumerate(texts)]
    got = conversation_trie.prefix_trie(spark.createDataFrame(turns, TURNS))
    assert sorted_rows(got, "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens") == sorted([
        (1, 0, None, 5, 2, 3, 7), (1, 1, 1, 4, 1, 2, 7), (1, 2, 1, 4, 2, 2, 4), (1, 3, 1, 2, 0, 1, 1), (2, 3, 1, 1, 0, 1, 0), (5, 1, 1, 1, 0, 1, 0)], key=repr)


# --- divergence --------------------------------------------------------------------------------

def test_divergence_of_odd_rows(spark):
    """Terms in several chunks of a document, around the least number of documents; groups without terms; NULLs."""
    rows = [(i, f"Red-red green{i % 3} red, (blue) {'rare' if i < 29 else 'x'}", "en", f"s{i % 4}") for i in range(60)]
    rows += [(i, "RARE! rare? x-rare-x ...", "en", "s0") for i in range(100, 101)] + [(i, None, "en", "none") for i in range(3)]
    rows += [(None, "12 34 --- " + "*" * 50, "fr", None), (None, "ça va", "fr", "b"), (7, "a,b;" * 5000, None, "c"), (7, "a,b;" * 5000, None, "c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as term", "2 as g", "3 as chunk", "4 as n")
    got = divergence.divergence(frame, at_least=30, top=3).collect()
    want = brute.divergence([r[1:] for r in rows], 30, 3)
    assert sorted(map(tuple, got)) == sorted(want)
    assert divergence.divergence(frame.where("false")).collect() == []


@pytest.mark.parametrize("terms, sources", [(2, 2), (1, 100), (50, 1)])
def test_comparing_in_slices_and_blocks(spark, monkeypatch, terms, sources):
    rows = [(f"{'a b c d e f g'[:2 * (i % 7) + 1]} {'z' * (i % 5 + 1)}", "en" if i % 3 else "de", f"s{i % 6}") for i in range(90)]
    frame = spark.createDataFrame(rows, "text string, lang string, source string")
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "SOURCES", sources)
    got = divergence.divergence(frame, at_least=3, top=5).collect()
    assert sorted(map(tuple, got)) == sorted(brute.divergence(rows, 3, 5))
