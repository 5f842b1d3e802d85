"""A corpus pipeline of five stages; each works on all that the one before kept, written as Parquet in between."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, packing, pii, simhash, toxicity
from tidemark.llm.common import cut, ensure_checkpoint_dir, fresh, in_file_order, read
from tidemark.llm.queries import TOKENIZER


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labelled examples near to them don't call toxic."""
    return toxicity.reject(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id."""
    return simhash.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str, weights: dict[str, float] | None = None) -> DataFrame:
    """All documents in the order of the mixture: files in the order of slots, rows in the order of slots and places."""
    slot, place, key = fresh(docs, "mix_slot", "mix_place", "mix_key")
    # the schedule needs ids and sources alone; equal pairs of both take each other's places
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "source", "text"))
    slots = mixing.mix(cut(keyed.select("doc_id", "source", key)), weights)
    turn = slots.groupBy("doc_id", "source", key).agg(F.min("slot").alias(slot), F.min_by("place", F.struct("slot", "place")).alias(place))
    same = [keyed[c].eqNullSafe(turn[c]) for c in ("doc_id", "source", key)]
    return keyed.join(turn, same).select(*(keyed[c] for c in docs.columns), slot, place).orderBy(slot, place).drop(slot, place)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences of 1,024 tokens, by the order of the files and of their rows."""
    order = fresh(docs, "file_part", "file_row")
    return packing.pack_documents(in_file_order(docs, *order), TOKENIZER, order=tuple(order))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: No stage but the fourth could be told in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
