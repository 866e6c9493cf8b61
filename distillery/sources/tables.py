"""Tables, text files, and the structured documents derived from the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Questions that are asked of every structured document.
QUESTIONS = (
    "Why was this selected and what are the constraints?",
    "What is AGENT-INT-03?",
    "Which task must implement the pipeline v2.1?",
    "What are the steps of the workflow?",
    "Compare SOC2 goal",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that ``spark.checkpoint.dir`` names, which driver and executors share; in the warehouse where it is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/distillery/{label}-{uuid.uuid4().hex[:12]}"


def plain_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id and text of the documents table."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.coalesce("text", F.lit("")).alias("text"))


def structured(docs: DataFrame) -> DataFrame:
    """Documents whose lines become headers, lists, labels and tags by a fixed rule, all of them."""

    def line(text, i):
        k = (F.col("doc_id") * 7 + i) % 16
        shapes = {
            0: F.concat(F.lit("# "), text), 1: F.concat(F.lit("- "), text), 2: F.concat(F.lit("- "), text), 3: F.concat(F.lit("1. "), text),
            4: F.concat(F.lit("Decision: "), text), 5: F.concat(F.lit("[CON-01] Limit: "), text), 6: F.concat(F.lit("[REA-02] Why: "), text),
            7: F.concat(F.lit("We selected this because "), F.lower(text)), 8: F.lit("Requirement:"), 9: text, 10: F.concat(F.lit("Goal: "), text),
            11: F.concat(F.lit("Services must never stop. "), text), 12: F.lit("Task: implement the pipeline v2.1"), 13: F.lit("---"),
            14: F.lit("Is AGENT-INT-03 ready?"), 15: F.concat(F.lit("Compare versus SOC2. "), text),
        }
        shaped = text
        for n, shape in shapes.items():
            shaped = F.when(k == n, shape).otherwise(shaped)
        gap = F.when(i == 0, "").when(k.isin(2, 3, 9), "\n").otherwise("\n\n")
        return F.concat(gap, shaped)

    lines = F.split("text", "\n", -1)
    return docs.select(F.col("doc_id").cast("string").alias("document_id"), F.array_join(F.transform(lines, line), "").alias("text"))


def structured_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document, of any language or none; a null text is an empty one."""
    return structured(table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit(""))))


def questions(spark: SparkSession, asked: tuple[str, ...] = QUESTIONS) -> DataFrame:
    return spark.createDataFrame([(f"q{k}", q) for k, q in enumerate(asked)], "query_id string, query string")


def text_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """document_id (the path) and text of each file at any depth under a path whose name fits the pattern, each once, by path."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select(F.input_file_name().alias("document_id"), F.col("value").alias("text")).dropDuplicates(["document_id"]).orderBy("document_id")


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    return text_files(spark, path, "*.md")


def first_files(files: DataFrame, n: int) -> DataFrame:
    """The first n files by path."""
    return files.orderBy("document_id").limit(n)


def question_bank(spark: SparkSession, questions_path: str, answers_path: str) -> DataFrame:
    """question_id, question, answer: lines "[Q-nn] question", and "[Q-nn] ANSWER KEY:" with the lines that follow it."""
    head = r"^\[(Q-\d+)\]\s*(.*)$"
    asked = spark.read.text(questions_path).where(F.col("value").rlike(head)).select(F.regexp_extract("value", head, 1).alias("question_id"), F.trim(F.regexp_extract("value", head, 2)).alias("question"))
    blocks = spark.read.text(answers_path, wholetext=True).select(F.explode(F.split("value", r"(?m)^(?=\[Q-\d+\])")).alias("block"))
    keyed = r"(?s)^\[(Q-\d+)\] ANSWER KEY:\s*(.*?)\s*$"
    answers = blocks.where(F.col("block").rlike(keyed)).select(F.regexp_extract("block", keyed, 1).alias("question_id"), F.regexp_replace(F.regexp_extract("block", keyed, 2), r"\s*\n\s*", " ").alias("answer"))
    return asked.join(answers, "question_id", "left")
