"""Source divergence audit: how far apart the sources of a language are in their choice of terms.

Chunk factorization keeps the number of rows far below the number of words:

1. Tasks count white-space chunks per document, A-Z lower-cased and without what cannot be part of a term at either
   end, a slice of documents at a time, and write one row per language and distinct chunk of the slice: the number of documents, the documents themselves as long as they are fewer
   than ``at_least``, and the occurrences in each source.
2. Rows are brought together by chunk, each globally distinct chunk is tokenized once, and its terms get the
   chunk's documents per language. A term's documents lie between the largest number of one of its chunks and their
   sum. Where that does not settle whether there are ``at_least``, every chunk has fewer, so the
   documents are at hand: they are joined and counted without repetition.
3. The chunks that hold a kept term are joined back to the rows of step 1, which gives occurrences per
   language, source and term. A bitmap of fixed size first drops the rows of other chunks where they are; what is left is
   summed per language, source and chunk before the join.
4. Counts become smoothed shares in billionths, by integer arithmetic. All pairs of sources are compared in tasks
   that hold a slice of a language's terms and two blocks of its sources; partial sums are added up.

Tables in between are written to the shared folder and removed once the result is there.

Defined cases: NULL text, language and source are empty strings; every row is a document, also rows that repeat an id
or have none; groups without terms take part with their smoothed shares; a language without kept terms
has pairs of value 0; an empty table gives an empty result. Texts may be of any length; a task holds
one slice, which is one text where a text is longer. Other columns are not read.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm import arrays
from tallyloom.llm.shipping import shipped
from tallyloom.operators.joins import attach, may_be_listed
from tallyloom.session import cut_lineage, remove_folder, shared_folder

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
# Bytes of text per slice.
SLICE = 16 << 20
# Terms and sources that a comparing task holds, and copies of small tables, so that no language is one task.
TERMS, SOURCES, SALTS = 2048, 256, 16
UNIT, ADDED = 1_000_000_000, 5


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    sizes = ends - starts
    sums = np.cumsum(sizes)
    gathered = data[np.repeat(starts - (sums - sizes), sizes) + np.arange(sums[-1] if len(sums) else 0)]
    offsets = np.concatenate([[0], sums]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(gathered)]).cast(pa.string())


_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(97, 123), *range(128, 256)]] = True


def _trimmed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without bytes of no term at either end; empty if there are no others."""
    starts, ends = starts.copy(), ends.copy()
    for turn in range(4):
        front = np.flatnonzero((starts < ends) & ~_IN_TERM[data[np.minimum(starts, len(data) - 1)]])
        starts[front] += 1
        back = np.flatnonzero((starts < ends) & ~_IN_TERM[data[ends - 1]])
        ends[back] -= 1
    # Long runs of them are passed over at once.
    left = np.flatnonzero((starts < ends) & ~(_IN_TERM[data[np.minimum(starts, len(data) - 1)]] & _IN_TERM[data[ends - 1]]))
    for i in left.tolist():
        inside = np.flatnonzero(_IN_TERM[data[starts[i]:ends[i]]])
        starts[i], ends[i] = (starts[i] + inside[0], starts[i] + inside[-1] + 1) if len(inside) else (ends[i], ends[i])
    return starts, ends


def _counted(table: pa.Table, number: int, at_least: int) -> pa.RecordBatch:
    """Chunks of one slice, per language."""
    table = table.sort_by([("lang", "ascending"), ("source", "ascending")]).combine_chunks()
    langs, sources, texts = (pa.concat_arrays(table.column(c).chunks) for c in ("lang", "source", "text"))
    codes = langs.dictionary_encode().indices.to_numpy(), sources.dictionary_encode().indices.to_numpy()
    lang = np.cumsum(np.diff(codes[0], prepend=0) != 0)
    group = np.cumsum((np.diff(codes[0], prepend=0) != 0) | (np.diff(codes[1], prepend=0) != 0))
    (_, data, offsets), = arrays.chunks(texts, 1 << 62)
    data = arrays.LOWER[data]
    starts, ends, first = arrays.word_spans(data, offsets, arrays.SOLID)
    many = len(texts)
    doc = np.repeat(np.arange(many), np.diff(first))
    starts, ends = _trimmed(data, starts, ends)
    some = starts < ends
    starts, ends, doc = starts[some], ends[some], doc[some]
    _, where, chunk = np.unique(arrays.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    strings = _strings(data, starts[where], ends[where])
    # Documents stand in order of language and source, so pairs in order of chunk and document do as well.
    pairs, times = np.unique(chunk * many + doc, return_counts=True)
    chunk, doc = pairs // many, pairs % many
    run = np.flatnonzero((np.diff(chunk, prepend=-1) != 0) | (np.diff(lang[doc], prepend=-1) != 0))
    part = np.flatnonzero((np.diff(chunk, prepend=-1) != 0) | (np.diff(group[doc], prepend=-1) != 0))
    n_docs = np.diff(np.append(run, len(doc)))
    few = n_docs < at_least
    kept = doc[np.repeat(few, n_docs)]
    ends = np.concatenate([[0], np.cumsum(n_docs * few)])
    tops = np.append(np.searchsorted(part, run), len(part))
    counts = np.add.reduceat(times, part) if len(part) else np.zeros(0, np.int64)
    return pa.record_batch([
        pa.array(np.full(len(run), number, np.int64)), langs.take(pa.array(doc[run])), strings.take(pa.array(chunk[run])),
        pa.array(n_docs.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(kept, pa.int32())),
        pa.ListArray.from_arrays(pa.array(tops, pa.int32()), sources.take(pa.array(doc[part]))),
        pa.ListArray.from_arrays(pa.array(tops, pa.int32()), pa.array(counts, pa.int64()))],
        names=["slice", "lang", "chunk", "n_docs", "docs", "sources", "counts"])


def _slices(at_least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def work() -> pa.RecordBatch:
            return _counted(pa.Table.from_batches(held), (part << 32) + number, at_least)

        for batch in batches:
            if not batch.num_rows:
                continue
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy().astype(np.int64))
            low = 0
            while low < batch.num_rows:
                before = ends[low - 1] if low else 0
                stop = max(low + 1, int(np.searchsorted(ends, before + SLICE - size, "right")))
                held.append(batch.slice(low, stop - low))
                size += int(ends[stop - 1] - before)
                low = stop
                if size >= SLICE or low < batch.num_rows:
                    yield work()
                    held, size, number = [], 0, number + 1
        if held:
            yield work()
    return run


def chunk_counts(documents: DataFrame, at_least: int) -> DataFrame:
    """``slice, lang, chunk, n_docs, docs, sources, counts``; ``documents`` is ``lang, source, text``."""
    return documents.mapInArrow(_slices(at_least), "slice long, lang string, chunk string, n_docs long, docs array<int>, "
                                                   "sources array<string>, counts array<long>")


def _salted(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of rows whose keys are few and hot: the other side is copied, and each copy meets a part of the rows."""
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(copies, [*keys, "_salt"]).drop("_salt")


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 kept)), exactly."""
    wide = "decimal(38,0)"
    top = (F.lit(UNIT).cast("decimal(10,0)") * (n + ADDED).cast("decimal(20,0)")).cast(wide)
    under = F.when(kept > 0, total + ADDED * kept).cast(wide)
    return 1 + F.call_function("div", top, under)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by language, slice and blocks: fillers (no term) with a source's share of an absent term, and
    terms with theirs."""

    def work(table: pa.Table) -> pa.RecordBatch:
        fill = pc.is_null(table.column("term")).to_numpy(zero_copy_only=False)
        names = table.column("source").combine_chunks().dictionary_encode()
        code = names.indices.to_numpy()
        p = table.column("p").to_numpy()
        rest = table.filter(pa.array(~fill))
        term = rest.column("term").combine_chunks().dictionary_encode()
        shares = np.zeros((len(names.dictionary), len(term.dictionary)), np.int64)
        absent, side = np.zeros(len(shares), np.int64), np.zeros(len(shares), np.int64)
        absent[code[fill]], side[code[fill]] = p[fill], table.column("side").to_numpy()[fill]
        shares[:] = absent[:, None]
        shares[code[~fill], term.indices.to_numpy()] = p[~fill]
        left, right, value = [], [], []
        for i in range(len(shares)):
            others = np.flatnonzero((side == 2) | (side != side[i]))
            others = others[others != i]
            left.append(np.full(len(others), i))
            right.append(others)
            value.append(np.abs(shares[others] - shares[i]).sum(axis=1))
        left, right, value = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right, value))
        return pa.record_batch([
            pa.repeat(table.column("lang")[0], len(left)).cast(pa.string()), names.dictionary.take(pa.array(left)), names.dictionary.take(pa.array(right)),
            pa.array(value)], names=["lang", "source", "item", "value"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        last = {c: held.column(c)[-1] for c in ("lang", "slice", "lo", "hi")}
        same = np.ones(held.num_rows, bool)
        for column, value in last.items():
            same &= pc.equal(held.column(column), value).to_numpy()
        cut = int(np.argmax(same))
        yield from (work(t) for t in _runs(held.slice(0, cut)))
        held = held.slice(cut)
    if held is not None:
        yield from (work(t) for t in _runs(held))


def _runs(table: pa.Table) -> Iterator[pa.Table]:
    """Consecutive rows of equal language, slice and blocks."""
    if not table.num_rows:
        return
    changes = np.zeros(table.num_rows, bool)
    changes[0] = True
    for column in ("lang", "slice", "lo", "hi"):
        codes = table.column(column).combine_chunks().dictionary_encode().indices.to_numpy()
        changes[1:] |= np.diff(codes) != 0
    cuts = np.append(np.flatnonzero(changes), table.num_rows)
    for low, high in zip(cuts[:-1], cuts[1:]):
        yield table.slice(low, high - low)


def source_distances(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """``lang, source, item, value``: for each source the summed difference of shares to each other one of its language.

    ``groups`` is ``lang, source, kept, absent``: kept terms of the language and the share of a term that the source
    lacks; ``shares`` is ``lang, source, term, p, kept``.
    """
    slices = F.greatest(F.ceil(F.col("kept") / TERMS), F.lit(1)).cast("long")
    sizes = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / SOURCES).cast("long").alias("blocks"))
    filler = groups.join(sizes, "lang").select(
        "lang", "source", F.lit(None).cast("string").alias("term"), F.coalesce("absent", F.lit(0)).alias("p"), "blocks",
        F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)).alias("slice"))
    rows = _salted(shares, sizes, ["lang"]).select(
        "lang", "source", "term", "p", "blocks", F.pmod(F.xxhash64("term"), slices).alias("slice")).unionByName(filler)
    own = F.pmod(F.xxhash64("source"), F.col("blocks"))
    spread = rows.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))})
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    keys = ["lang", "slice", "lo", "hi"]
    placed = spread.select("lang", "slice", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
                           side.cast("int").alias("side"), "source", "term", "p")
    sums = placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        _compared, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(documents: DataFrame, at_least: int = 30, top: int = 50, text_column: str = "text",
               lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` ranks the other sources by distance, part ``term`` the
    ``top`` terms that the source has more of than its language."""
    spark = documents.sparkSession
    folder = os.path.join(shared_folder(spark), f"divergence-{uuid.uuid4().hex}")

    def written(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(os.path.join(folder, name))
        return spark.read.parquet(os.path.join(folder, name))

    lang, source = (F.coalesce(F.col(c), F.lit("")) for c in (lang_column, source_column))
    own = shipped(documents).select(lang.alias("lang"), source.alias("source"), F.col(text_column).alias("text"))
    names = written(own.select("lang", "source").distinct(), "groups")
    counted = written(chunk_counts(own, at_least), "chunks")

    # By chunk alone, so that all languages of a chunk meet and it is tokenized once.
    met = counted.select("chunk", "lang", "n_docs").repartition("chunk").groupBy("chunk", "lang").agg(F.sum("n_docs").alias("n_docs"))
    met = met.groupBy("chunk").agg(F.collect_list(F.struct("lang", "n_docs")).alias("langs"))
    met = met.withColumn("terms", F.regexp_extract_all("chunk", F.lit(TERM), F.lit(0))).select(
        "chunk", "langs", F.explode(F.array_distinct("terms")).alias("term"), "terms")
    times = F.size(F.filter("terms", lambda t: t == F.col("term"))).cast("long")
    placed = written(met.select("chunk", "term", times.alias("times"), F.explode("langs").alias("l")).select(
        "l.lang", "chunk", "term", "times", "l.n_docs"), "placed")

    # Documents per language: settled by bounds, or counted.
    bounds = placed.groupBy("lang", "term").agg(F.max("n_docs").alias("low"), F.sum("n_docs").alias("high"))
    bounds = written(bounds.where(F.col("high") >= at_least).select("lang", "term", (F.col("low") < at_least).alias("open")), "bounds")
    key, held = ["lang", "chunk"], F.collect_list(F.struct("term", "times", "open")).alias("held")
    wanted = written(attach(placed, bounds, ["lang", "term"], "inner").groupBy(*key).agg(held), "wanted")
    open_ = wanted.select(*key, F.filter("held", lambda t: t["open"])["term"].alias("terms")).where(F.size("terms") > 0)
    few = may_be_listed(counted.where(F.col("n_docs") < at_least).select(*key, "slice", "docs"), open_, key)
    pairs = attach(few, open_, key, "inner").select("lang", "slice", F.explode("terms").alias("term"), "docs").select(
        "lang", "term", "slice", F.explode("docs").alias("doc")).distinct()
    reached = pairs.groupBy("lang", "term").count().where(F.col("count") >= at_least)
    kept = written(bounds.where("not open").select("lang", "term").unionByName(reached.select("lang", "term")), "kept")

    found = may_be_listed(counted.select(*key, "sources", "counts"), wanted, key).select(
        *key, F.explode(F.arrays_zip("sources", "counts")).alias("s"))
    found = found.groupBy(*key, F.col("s.sources").alias("source")).agg(F.sum("s.counts").alias("n"))
    counts = attach(found, wanted, key, "inner").select("lang", "source", "n", F.explode("held").alias("t")).groupBy(
        "lang", "source", F.col("t.term").alias("term")).agg(F.sum(F.col("n") * F.col("t.times")).alias("n"))
    counts = written(attach(counts, kept, ["lang", "term"], "left_semi"), "counts")
    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"))
    by_lang = whole.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n_lang").alias("total_lang"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = names.select("lang", "source").join(by_lang, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(
        0, ["kept", "total_lang", "total"])
    groups = written(groups.withColumn("absent", _share(F.lit(0), F.col("total"), F.col("kept"))), "totals")
    shares = _salted(attach(counts, whole, ["lang", "term"], "inner"), groups.drop("absent"), ["lang", "source"])
    shares = written(shares.select(
        "lang", "source", "term", "kept", _share(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
        _share(F.col("n_lang"), F.col("total_lang"), F.col("kept")).alias("q")), "shares")

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    far = source_distances(groups.select("lang", "source", "kept", "absent"), shares.drop("q")).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
    marked = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                          (F.col("p") - F.col("q")).alias("value"))
    marked = marked.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    result = cut_lineage(far.unionByName(marked))
    remove_folder(spark, folder)
    return result

