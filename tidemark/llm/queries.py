"""Queries of the corpus operators over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, chat, lang_id, mixing, packing, pii, quality, repeats, resampling, simhash, suffix_tree_lm, toxicity, variants
from tidemark.llm.common import read

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one, by graphs."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op3_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suffix tree's and the unigrams' scores of every document."""
    return suffix_tree_lm.score(read(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, read back and digested."""
    return chat.digests(chat.format_conversations(chat.with_trap(read(spark, sf_dir, "conversations"))))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated strings."""
    return repeats.digests(repeats.remove(read(spark, sf_dir, "documents")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures and verdict."""
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.judge(read(spark, sf_dir, "documents")).select(*columns)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document's pieces in sequences of 1,024 tokens."""
    return packing.pack_documents(read(spark, sf_dir, "documents"), TOKENIZER)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot of every document in the mixture of sources."""
    return mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, counts and spans."""
    return pii.report(read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of being toxic."""
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language."""
    return lang_id.identify(read(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight, score and rank in the draw towards the benchmark's words."""
    return resampling.drawn(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word's near words, form and root."""
    return variants.group(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_ann, op3_suffix_tree_lm, op4_chat, op5_repeats, op6_quality, op7_packing, op8_mixing, op9_pii, op10_toxicity, op11_lang_id, op12_resampling, op13_variants, pipeline)}

ORACLE_SQL = {"op4_chat": chat.ORACLE_SQL, "op6_quality": quality.ORACLE_SQL, "op12_resampling": resampling.ORACLE_SQL, "op13_variants": variants.ORACLE_SQL}
