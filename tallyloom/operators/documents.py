"""The work of the run steps: validating documents, text of pages, chunks, dataset records.

All of it is built-in column functions. Verdicts belong to rows, not to ids, which may repeat or be missing. Duplicates
are settled on digests and counts of chunks on lengths; a text is shuffled only where it is, in all likelihood, a
duplicate to be dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.html import title, visible_text
from tallyloom.operators.joins import attach, without_listed
from tallyloom.operators.ranking import split_rank

# A document needs this many characters.
SHORTEST = 50
# Characters per chunk, and how many of them the next chunk begins with.
SIZE, OVERLAP = 500, 100
# Turns of a conversation in one chat sample.
TURNS = 8

VERDICTS = ["empty", "length_mismatch", "too_short", "duplicate", "ok"]


def is_blank_text(text: Column) -> Column:
    """NULL, empty or nothing but ASCII white space."""
    return ~F.coalesce(text.rlike(r"[^\x09-\x0D\x20]"), F.lit(False))


# --- validate_data -----------------------------------------------------------------------------

def _early(text: Column) -> Column:
    """The verdict that a row gets by itself, if any."""
    return (F.when(is_blank_text(text), "empty")
            .when(F.length(text) != F.coalesce("n_chars", F.lit(-1)), "length_mismatch")
            .when(F.length(text) < SHORTEST, "too_short"))


def _judged(documents: DataFrame, **more: Column) -> DataFrame:
    """One row per document with its ``verdict`` and ``_digest``, and ``more`` columns made of it."""
    text = F.col("text")
    judged = documents.select("doc_id", "source", "lang", F.sha2(text, 256).alias("_digest"), _early(text).alias("_early"),
                              *(column.alias(name) for name, column in more.items()))
    firsts = judged.groupBy("_digest").agg(F.min("doc_id").alias("_first"))
    verdict = F.coalesce("_early", F.when(F.col("doc_id") > F.col("_first"), "duplicate").otherwise("ok"))
    return attach(judged, firsts, ["_digest"], "left").withColumn("verdict", verdict).drop("_early", "_first")


def document_verdicts(documents: DataFrame) -> DataFrame:
    """``doc_id, source, lang, verdict``; the first of ``VERDICTS`` that applies.

    A duplicate has the text of a document with a smaller id. Digests are folded to their smallest id on the map
    side, so a text that a third of all documents share is one row per task; rows that repeat id and text are
    judged alike, and a row without an id is never a duplicate.
    """
    return _judged(documents).select("doc_id", "source", "lang", "verdict")


def validation_report(documents: DataFrame) -> DataFrame:
    """Documents by verdict and the share of good ones, per source and language."""
    counts = {f"n_{verdict}": F.count_if(F.col("verdict") == verdict) for verdict in VERDICTS}
    report = document_verdicts(documents).groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("n_documents"), *[count.alias(name) for name, count in counts.items()])
    return report.withColumn("pass_rate", F.col("n_ok") / F.col("n_documents"))


# --- ocr_extraction ----------------------------------------------------------------------------

def page_text(pages: DataFrame) -> DataFrame:
    """Visible text of each page, empty without HTML. See ``functions.html``."""
    return pages.select("page_id", visible_text(F.coalesce("html", F.lit(""))).alias("text"))


def page_titles(pages: DataFrame) -> DataFrame:
    """Title of each page, empty if it has none."""
    return pages.select("page_id", title(F.coalesce("html", F.lit(""))).alias("title"))


# --- chunk_data --------------------------------------------------------------------------------

def _chunks(length: Column, size: int, overlap: int) -> Column:
    """How many chunks a text of this length has."""
    return F.ceil(F.greatest(length - overlap, F.lit(1)) / (size - overlap)).cast("bigint")


def check_chunking(size: int, overlap: int) -> None:
    if overlap < 0 or size <= overlap:
        raise ValueError(f"overlap must be at least 0 and below size, got size={size}, overlap={overlap}")


def _windows(text: Column, size: int, overlap: int) -> tuple[Column, Column]:
    """All chunks of a text, made of the array ``_blocks``, and that array, in time linear in the text's length.

    A substring by position is counted from the text's start, chunk after chunk; here the text is cut once, into blocks
    of what a chunk is ahead of the one before, and each chunk is put together from the blocks that it spans.
    """
    step = size - overlap
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    spanned = -(-size // step)
    numbers = F.sequence(F.lit(1), _chunks(F.length(text), size, overlap).cast("int"))
    return F.transform(numbers, lambda i: F.left(F.array_join(F.slice("_blocks", i, F.lit(spanned)), ""), F.lit(size))), blocks


def document_chunks(documents: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, chunk, start, text``: windows of ``size`` characters; blank documents have none."""
    check_chunking(size, overlap)
    windows, blocks = _windows(F.col("text"), size, overlap)
    cut = documents.where(~is_blank_text(F.col("text"))).select("doc_id", "text", blocks.alias("_blocks"))
    placed = cut.select("doc_id", F.posexplode(windows).alias("chunk", "text"))
    chunk = F.col("chunk").cast("bigint")
    return placed.select("doc_id", chunk.alias("chunk"), (chunk * (size - overlap)).alias("start"), "text")


def chunk_stats(documents: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_chunks, total_chars, mean_chars`` per document with chunks.

    From the length alone: all chunks but the last are full.
    """
    check_chunking(size, overlap)
    n = _chunks(F.length("text"), size, overlap)
    total = (n - 1) * size + F.length("text") - (n - 1) * (size - overlap)
    counted = documents.where(~is_blank_text(F.col("text"))).select("doc_id", n.alias("n_chunks"), total.alias("total_chars"))
    return counted.withColumn("mean_chars", F.col("total_chars") / F.col("n_chunks"))


# --- generate_dataset --------------------------------------------------------------------------

def split_of(doc_id: Column) -> Column:
    """About a tenth of all documents are for validation, each with all its records."""
    return F.when(F.substring(F.md5(doc_id.cast("string")), 1, 2) < "1a", "val").otherwise("train")


def _good(documents: DataFrame) -> DataFrame:
    """Rows with verdict ``ok``: those with no verdict of their own, without the duplicates among them."""
    duplicates = _judged(documents).where("verdict = 'duplicate'").select("_digest", "doc_id")
    left = documents.where(_early(F.col("text")).isNull()).withColumn("_digest", F.sha2("text", 256))
    return without_listed(left, duplicates, ["_digest", "doc_id"]).select(*documents.columns)


def dataset_records(documents: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``record_id, doc_id, chunk, split, text``: the chunks of good documents.

    A row without an id has records without one, for training; rows that repeat an id have their own records each.
    """
    records = document_chunks(_good(documents), size, overlap)
    return records.select(F.concat(F.col("doc_id").cast("string"), F.lit("-"), F.col("chunk").cast("string")).alias("record_id"),
                          "doc_id", "chunk", split_of(F.col("doc_id")).alias("split"), "text")


def min_samples_gate(documents: DataFrame, min_samples: int, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Per source the records that its good documents give, and whether they are enough."""
    check_chunking(size, overlap)
    judged = _judged(documents, _n=_chunks(F.length("text"), size, overlap))
    totals = judged.groupBy("source").agg(
        F.coalesce(F.sum(F.when(F.col("verdict") == "ok", F.col("_n"))), F.lit(0)).alias("n_records"))
    return totals.withColumn("result", F.when(F.col("n_records") >= min_samples, "ok").otherwise("insufficient"))


def chat_samples(conversations: DataFrame, turns: int = TURNS) -> DataFrame:
    """``conv_id, part, n_turns, sample``: the turns of a conversation in order, as JSON.

    Turns are numbered before they are dealt to records, in order of ``turn``, role and text with NULL first, so a record
    never holds more than ``turns`` of them, whatever their values; no conversation, however long, is one
    row or one task; all parts together hold every turn.
    """
    if turns < 1:
        raise ValueError(f"turns must be at least 1, got {turns}")
    numbered = split_rank(conversations.select("conv_id", "turn", "role", "text"), ["conv_id"],
                          {"turn": False, "role": False, "text": False}, "_n")
    part = F.expr(f"(_n - 1) div {turns}").alias("part")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_n", "turn", "role", "text"))), lambda t: F.struct(
        t["turn"].alias("turn"), t["role"].alias("role"), t["text"].alias("text")))
    return numbered.groupBy("conv_id", part).agg(
        F.count(F.lit(1)).alias("n_turns"), F.to_json(ordered, {"ignoreNullFields": "false"}).alias("sample"))
