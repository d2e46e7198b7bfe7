"""Documents to packed sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame; ``run`` writes it as Parquet into the shared
folder and the next stage reads it from there, so a lost executor or a repeated stage never goes back
further than one stage. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontaminate, near_dups, packing, pseudonyms, toxicity
from tallyloom.llm.columns import table
from tallyloom.llm.queries import pii_key, tokenizer_file
from tallyloom.session import remove_folder, shared_folder

# Documents with at least this probability of being toxic go.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled documents of ``docs``, does not reject."""
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), score_column="_toxicity")
    return scored.where(F.col("_toxicity") < TOXIC).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    return near_dups.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms in their texts; a text keeps its number of characters."""
    return pseudonyms.pseudonymise(docs, pii_key(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes; see ``packing.pack_documents``."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", replace_personal_data),
    ("packing", pack),
]

# Hash sketches, a trained classifier, keyed pseudonyms and a tokenizer: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = os.path.join(shared_folder(spark), f"corpus-pipeline-{uuid.uuid4().hex}")
    before = None
    for number, (name, stage) in enumerate(STAGES):
        path = os.path.join(folder, f"{number}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        # Nothing goes back further than the rows just written.
        if before is not None:
            remove_folder(spark, before)
        before = path
    return docs
