"""From raw documents to packed training sequences, in five stages.

Each stage takes what the one before kept. Toxic documents go, one document of
each near-duplicate group stays, contaminated documents go, personal data is
masked, and what is left is packed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from distillery.llm import common, decontaminate, neardup, packing, pii, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine does not reject; learned from those of the labels that are not held out.

    Null and empty texts get the score of no terms, and repeated rows the same one.
    """
    machine = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.fit(docs, machine)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose word shingles are alike at 0.85 or more; all without words stay.

    The document of least doc_id (nulls last) stays, whatever else its rows say.
    """
    return neardup.distinct(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of 13 benchmark words stands, however long they are.

    Items of fewer words are common phrases: a document goes for them where
    they make up one word in twenty. Null and empty texts stay.
    """
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"), decontaminate.leaks())


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data masked, and their lengths as they then are; a null text stays null."""
    masked = pii.redact(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))
    return masked.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of at most 2048 tokens; a null text is the end id alone, repeated rows are packed each."""
    pieces = packing.write_pieces(docs, common.shared_dir(spark, "packing"), end_id=0)
    light = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(light).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", neardup_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", pii_stage),
    ("packing", packing_stage),
]

#: No stage but decontamination is expressible in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    root = common.shared_dir(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
