"""The registered queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import conversation_trie, decontaminate, divergence, licenses, multi_index, near_dups, ngram_join, packing, pseudonyms, suffix_dedup, token_counts, toxicity, url_filter
from tallyloom.llm.columns import table
from tallyloom.llm.oracle import ORACLE
from tallyloom.session import cut_lineage

__all__ = ["ORACLE", "QUERIES"]

# The host and path rules of the URL query.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
             ("block", "net/es/"), ("block", "net/fr/")]


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, folder, "pages"), URL_RULES)


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(table(spark, folder, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    judged = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return judged.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file; the package that names its place is only there on the machines that have it."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer_file("word_bpe_49k.json"))


def op6_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    return multi_index.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, folder, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


# The key of a session that names none: public, for the given tables only.
PII_KEY = b"key of the registered query"


def pii_key(spark: SparkSession) -> bytes:
    """The secret of ``spark.tallyloom.pii.key``."""
    return spark.conf.get("spark.tallyloom.pii.key", PII_KEY.decode()).encode()


def op8_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    done = pseudonyms.pseudonymise(table(spark, folder, "documents").select("doc_id", "text"), pii_key(spark), counts=True)
    return done.withColumn("n_replaced", sum((F.col(f"n_{kind}") for kind in pseudonyms.KINDS), F.lit(0)))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"), keep=["doc_id"])
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_near_dups(spark: SparkSession, folder: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, folder, "documents"))


def op11_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, folder, "documents"))


def op12_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = cut_lineage(conversation_trie.turn_digests(table(spark, folder, "conversations")))
    return conversation_trie.trie(*conversation_trie.with_shared_heads(turns, group=100, most=6))


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_token_counts": op4_token_counts,
    "op5_packing": op5_packing,
    "op6_multi_index": op6_multi_index,
    "op7_licenses": op7_licenses,
    "op8_pseudonyms": op8_pseudonyms,
    "op9_toxicity": op9_toxicity,
    "op10_near_dups": op10_near_dups,
    "op11_ngram_join": op11_ngram_join,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_source_divergence": op13_source_divergence,
}
