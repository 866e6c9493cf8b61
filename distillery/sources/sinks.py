"""Where results go: JSON, a growing history, CSV details and a Markdown report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.evaluate import with_section


def write_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def append_history(rows: DataFrame, path: str) -> None:
    """Adds a run's rows under its time; earlier runs stay as they are."""
    rows.withColumn("timestamp", F.current_timestamp()).write.mode("append").parquet(path)


def write_details(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of one row, as one text file."""
    report.select(F.col(report.columns[0]).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\n\z", "").alias("report"))


def update_report(section: DataFrame, path: str, title: str = "Evaluation", first: str = "") -> None:
    """Puts a section into the report at a path, over the one of that title and all that follows it; ``first`` begins a new report."""
    spark = section.sparkSession
    try:
        old = read_report(spark, path).first()[0]
    except AnalysisException:
        old = first
    write_report(section.select(with_section(F.lit(old), F.col(section.columns[0]), title).alias("report")), path)
