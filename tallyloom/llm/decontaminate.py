"""Benchmark decontamination: a broadcast hash set of the test items' word n-grams.

Texts are lower-cased (A-Z) and cut into words (``columns.WORD``). A window is ``size`` consecutive words of an
item; an item with fewer words, but not none, is one window. Each window's 64-bit hash goes into a
broadcast hash table; every window of every document is looked up by its hash, and a hit is verified
word by word. All of this is one projection, one ``explode`` of positions and one broadcast hash join,
compiled by Spark; only hits are shuffled, with at most one row per word of a document.

The benchmark is broadcast. Its size is the caller's test set, which does not grow with the corpus;
``MAX_WINDOWS`` states the bound, and beyond it the windows are joined by a shuffle instead, with equal
results; there each place of a document sends its hash and its window of at most ``size`` words.

Defined cases: NULL and empty texts have no words and no hits; an empty benchmark hits nothing; equal
windows of several items count for each of them; rows that repeat a ``doc_id`` are judged on their own
text; a NULL ``doc_id`` is kept; NULL item ids do not appear in lists of items. Other columns of the
documents are passed through by ``decontaminate`` and ignored by ``contamination``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.columns import WORD, ascii_lower, words_of

# Windows of a benchmark up to which they are broadcast: some 200 bytes each.
MAX_WINDOWS = 1_000_000


def windows_of(benchmark: DataFrame, size: int, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """``length, hash, window, items``: the distinct windows and the ids of the items that hold them."""
    item = (benchmark.select(F.col(id_column).cast("string").alias("item"), words_of(F.col(text_column)).alias("words"))
            .where(F.size("words") > 0)
            .withColumn("length", F.least(F.lit(size), F.size("words"))))
    placed = item.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)))
    return (placed.select("item", "length", F.slice("words", F.col("at"), F.col("length")).alias("window"))
            .groupBy("length", "window").agg(F.collect_set("item").alias("items"))
            .withColumn("hash", _hash(F.col("window"), F.lit(0), F.col("length"), size)))


def _hash(words: Column, at: Column, length: Column, size: int) -> Column:
    """64-bit hash of ``length`` words from ``at`` (from 0), ``length`` being 1 to ``size``."""
    out = F.lit(None).cast("long")
    for n in range(1, size + 1):
        out = F.when(length == n, F.xxhash64(*(words[at + k] for k in range(n)))).otherwise(out)
    return out


def hits_of(docs: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    """``docs`` has ``doc_id, mark, words``; gives ``doc_id, mark, hits``: sorted places, lengths, items."""
    windows = windows_of(benchmark, size)
    # At most ``size`` rows: which lengths there are decides which hashes a document needs.
    counted = {row[0]: row[1] for row in windows.groupBy("length").count().collect()}
    lengths = sorted(counted) or [size]
    bounded = sum(counted.values()) <= MAX_WINDOWS
    placed = docs.where(F.size("words") > 0).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - 1)))
    if len(lengths) == 1:
        placed = placed.withColumn("length", F.lit(lengths[0]))
        key = F.xxhash64(*(F.col("words")[F.col("at") + k] for k in range(lengths[0])))
    else:
        placed = placed.withColumn("length", F.explode(F.array(*map(F.lit, lengths))))
        key = _hash(F.col("words"), F.col("at"), F.col("length"), size)
    placed = placed.where(F.col("at") + F.col("length") <= F.size("words"))
    windows = windows.withColumnRenamed("length", "window_length")
    here = F.slice("words", F.col("at") + 1, F.col("length"))
    if bounded:
        found = placed.join(F.broadcast(windows), (key == F.col("hash")) & (F.col("length") == F.col("window_length"))
                            & (here == F.col("window")))
    else:
        # Only a place's own words are shuffled, not its document's.
        places = placed.select("doc_id", "mark", "at", "length", key.alias("key"), here.alias("here"))
        found = places.join(windows, (F.col("key") == F.col("hash")) & (F.col("length") == F.col("window_length"))
                            & (F.col("here") == F.col("window")))
    return (found.select("doc_id", "mark", F.struct("at", "length", "items").alias("hit"))
            .groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("hit")).alias("hits")))


def _covered(hits: Column) -> Column:
    """Words inside any hit; ``hits`` is sorted by place."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def add(so_far: Column, hit: Column) -> Column:
        end = F.greatest(so_far["end"], hit["at"] + hit["length"])
        return F.struct((so_far["n"] + end - F.greatest(so_far["end"], hit["at"])).alias("n"), end.alias("end"))

    return F.aggregate(hits, start, add)["n"]


def _marked(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return documents.select(
        F.col(id_column).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("mark"),
        words_of(F.col(text_column)).alias("words"))


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = 10, id_column: str = "doc_id",
                  text_column: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items, contaminated``."""
    docs = _marked(documents, id_column, text_column)
    hits = (hits_of(docs, benchmark, size)
            .select(F.col("doc_id").alias("hit_id"), F.col("mark").alias("hit_mark"), _covered(F.col("hits")).alias("n_hit"),
                    F.array_sort(F.array_distinct(F.flatten(F.col("hits.items")))).alias("items")))
    counted = docs.select("doc_id", "mark", F.size("words").cast("long").alias("n_words"))
    same = counted["doc_id"].eqNullSafe(hits["hit_id"]) & (counted["mark"] == hits["hit_mark"])
    items = F.coalesce("items", F.array().cast("array<string>"))
    return counted.join(hits, same, "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"), items.alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, size: int = 10, remove: str = "documents",
                  id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents without contaminated ones (``remove="documents"``), or with the hit words and what
    separates them from the next word taken out of their texts (``remove="spans"``). All columns stay."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be documents or spans, got {remove!r}")
    hits = (hits_of(_marked(documents, id_column, text_column), benchmark, size)
            .select(F.col("doc_id").alias("_hit_id"), F.col("mark").alias("_hit_mark"), F.col("hits").alias("_hits")))
    mark = F.xxhash64(F.coalesce(documents[text_column], F.lit("")))
    same = documents[id_column].eqNullSafe(hits["_hit_id"]) & (mark == hits["_hit_mark"])
    if remove == "documents":
        return documents.join(hits, same, "left_anti")
    text = F.col(text_column)
    lowered = ascii_lower(text)
    lead = F.char_length(F.regexp_extract(lowered, f"^(?:(?!{WORD})[\\s\\S])*", 0))
    # Each word with what follows it, as lengths in the lower-cased text, which has the same characters.
    pieces = F.regexp_extract_all(lowered, F.lit(f"{WORD}(?:(?!{WORD})[\\s\\S])*"), F.lit(0))
    ends = F.aggregate(pieces, F.array(lead), lambda ends, piece: F.concat(
        ends, F.array(F.element_at(ends, -1) + F.char_length(piece))))
    runs = F.aggregate(F.col("_hits"), F.array().cast("array<struct<a:int,b:int>>"), lambda runs, hit: F.when(
        (F.size(runs) > 0) & (F.element_at(runs, -1)["b"] >= hit["at"]),
        F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.struct(
            F.element_at(runs, -1)["a"].alias("a"),
            F.greatest(F.element_at(runs, -1)["b"], hit["at"] + hit["length"]).alias("b"))))
    ).otherwise(F.concat(runs, F.array(F.struct(hit["at"].alias("a"), (hit["at"] + hit["length"]).alias("b"))))))
    cleaned = F.aggregate(F.col("_runs"), F.struct(F.lit("").alias("kept"), F.lit(0).alias("end")), lambda so_far, run: F.struct(
        F.concat(so_far["kept"], F.substr(text, so_far["end"] + 1, F.col("_ends")[run["a"]] - so_far["end"])).alias("kept"),
        F.col("_ends")[run["b"]].alias("end")))
    whole = F.concat(cleaned["kept"], F.substr(text, cleaned["end"] + 1))
    joined = documents.join(hits, same, "left").withColumns({
        "_runs": F.when(F.col("_hits").isNotNull(), runs), "_ends": F.when(F.col("_hits").isNotNull(), ends)})
    return joined.select(*(
        F.when(F.col("_hits").isNotNull(), whole).otherwise(text).alias(c) if c == text_column else documents[c]
        for c in documents.columns))
