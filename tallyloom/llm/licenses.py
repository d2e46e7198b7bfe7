"""License scan by a positional index of rare words.

Templates are short license texts, each with a mandatory key phrase. The index holds, for every word of the templates,
the templates and positions it stands at; its inverse document frequency comes from all documents. For
each file, the words that are in the index are looked up. The rarest word of a template's key phrase
gives a posting, that is an alignment of the template to the file: the word's place minus its position.
At each alignment the postings of the other words are intersected by relative position, the key phrase
must be complete there, and the share of the template's words found in their places, weighted by inverse
document frequency, is the score of the match.

Every place of a key phrase contains its rarest word, so no place is missed, whatever the frequencies.
Templates with a base label count all places of their phrase.

Two passes over the texts, both without a shuffle of texts: one counts in how many documents each of the
index' words occurs (a few hundred numbers), one scans.

Defined cases: NULL is the empty text: no words, no places, empty labels and score 0. Every input row comes
back, repeated ones too; other columns are not read. In an empty table nothing is counted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import arrays
from tallyloom.llm.shipping import shipped


@dataclass(frozen=True)
class Template:
    """``phrase`` stands in ``text`` and is mandatory; ``base`` templates count all their places."""

    label: str
    text: str
    phrase: str
    base: bool = False

    def words(self) -> list[str]:
        return self.text.split()

    def offset(self) -> int:
        words, phrase = self.words(), self.phrase.split()
        return next(i for i in range(len(words)) if words[i:i + len(phrase)] == phrase)


# The four base phrases and their labels.
BASE = [Template("gpl", "gnu general public license", "gnu general public license", True),
        Template("apache", "apache license", "apache license", True),
        Template("cc-by", "cc by", "cc by", True),
        Template("mit", "mit license", "mit license", True)]

# Opening words of public licenses, in the form of this module's words.
OPENINGS = [
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             "permission is hereby granted free of charge"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose",
             "permission to use copy modify and or distribute this software"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             "redistribution and use in source and binary forms"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             "free and unencumbered software"),
]
TEMPLATES = BASE + OPENINGS


def word_hashes(words: list[str]) -> np.ndarray:
    data = [w.encode("utf-8") for w in words]
    ends = np.cumsum([len(w) for w in data])
    starts = np.concatenate([[0], ends[:-1]])
    sums = arrays.prefix_hashes(np.frombuffer(b"".join(data), np.uint8))
    return arrays.span_hashes(sums, starts, ends)


class Index:
    """Templates as numbers of distinct words, with a table that finds a word's number by its hash."""

    def __init__(self, templates: list[Template]):
        self.templates = templates
        self.words = sorted({w for t in templates for w in t.words()})
        number = {w: i for i, w in enumerate(self.words)}
        hashes = word_hashes(self.words)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order
        self.table = np.zeros(1 << 16, bool)
        self.table[(hashes >> np.uint64(48)).astype(np.int64)] = True
        self.rows = [np.array([number[w] for w in t.words()]) for t in templates]

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of words that are in the index, and their numbers."""
        at = np.flatnonzero(self.table[(hashes >> np.uint64(48)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        same = self.hashes[place] == hashes[at]
        return at[same], self.numbers[place[same]]


def _found(texts: pa.Array, index: Index) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(first row, first word of each text, places, numbers)``"""
    for row, data, offsets in arrays.chunks(texts):
        data = arrays.LOWER[data]
        starts, ends, first = arrays.word_spans(data, offsets, arrays.ALNUM)
        hashes = arrays.span_hashes(arrays.prefix_hashes(data), starts, ends)
        yield row, first, *index.look_up(hashes)


def _frequencies(templates: list[Template]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        held, documents = np.zeros(len(index.words), np.int64), 0
        for batch in batches:
            documents += batch.num_rows
            for _, first, places, numbers in _found(batch.column(0), index):
                rows = np.searchsorted(first, places, "right")
                pairs = np.unique(rows * len(index.words) + numbers)
                held += np.bincount(pairs % len(index.words), minlength=len(index.words))
        yield pa.record_batch([pa.array([documents]), pa.array([held])], names=["documents", "held"])
    return run


def document_frequencies(documents: DataFrame, templates: list[Template], text_column: str = "text") -> np.ndarray:
    """Inverse document frequency of each of the index' words over all documents."""
    width = len(Index(templates).words)
    counted = shipped(documents).select(F.col(text_column).alias("text")).mapInArrow(
        _frequencies(templates), "documents long, held array<long>")
    sums = [F.sum("documents"), *(F.sum(F.col("held")[i]) for i in range(width))]
    total, *held = [x or 0 for x in counted.agg(*sums).first()]
    return np.log((1 + total) / (1 + np.array(held)))


def _scan(templates: list[Template], idf: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for batch in batches:
            for row, first, places, numbers in _found(batch.column(1), index):
                n = len(first) - 1
                at = np.full(int(first[-1]) + 1, -1)
                at[places] = numbers
                count, low, high = np.zeros(n, np.int64), np.full(n, 1 << 60), np.full(n, -1)
                score = np.zeros(n)
                labels: list[set] = [set() for _ in range(n)]
                base: list[set] = [set() for _ in range(n)]
                for template, words in zip(templates, index.rows):
                    offset, size = template.offset(), len(template.phrase.split())
                    phrase = words[offset:offset + size]
                    rarest = int(idf[phrase].argmax())
                    # Alignments, as the place of the phrase's first word.
                    begin = places[numbers == phrase[rarest]] - rarest
                    rows = np.searchsorted(first, begin + rarest, "right") - 1
                    inside = (begin >= first[rows]) & (begin + size <= first[rows + 1])
                    begin, rows = begin[inside], rows[inside]
                    for k, word in enumerate(phrase):
                        keep = at[begin + k] == word
                        begin, rows = begin[keep], rows[keep]
                    if not len(begin):
                        continue
                    weight, share = np.maximum(idf[words], 1e-9), np.zeros(len(begin))
                    for k, word in enumerate(words):
                        place = begin - offset + k
                        ok = (place >= first[rows]) & (place < first[rows + 1])
                        share[ok] += weight[k] * (at[place[ok]] == word)
                    np.maximum.at(score, rows, share / weight.sum())
                    if template.base:
                        np.add.at(count, rows, 1)
                        np.minimum.at(low, rows, begin - first[rows])
                        np.maximum.at(high, rows, begin - first[rows])
                    for i in np.unique(rows).tolist():
                        labels[i].add(template.label)
                        if template.base:
                            base[i].add(template.label)
                none = count == 0
                yield pa.record_batch([
                    batch.column(0).slice(row, n), pa.array(np.diff(first)), pa.array(count),
                    pa.array(low, mask=none), pa.array(high, mask=none),
                    pa.array([sorted(x) for x in base], pa.list_(pa.string())), pa.array([sorted(x) for x in labels], pa.list_(pa.string())),
                    pa.array(np.minimum(score, 1.0))],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
    return run


def scan_licenses(documents: DataFrame, templates: list[Template] | None = None, id_column: str = "doc_id",
                  text_column: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``;
    labels are sorted arrays."""
    templates = TEMPLATES if templates is None else templates
    idf = document_frequencies(documents, templates, text_column)
    own = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(_scan(templates, idf), f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, "
                          "base_labels array<string>, labels array<string>, score double")
