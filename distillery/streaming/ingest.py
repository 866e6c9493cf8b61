"""Documents that arrive as a stream: each micro-batch is ingested once and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..plans.engine import SCHEMAS, Settings, ingest

SCHEMA = T.StructType([T.StructField("document_id", T.StringType()), T.StructField("text", T.StringType())])


def _known(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"{SCHEMAS['meta']}, batch string, buckets int, bucket int").parquet(f"{path}/meta")
    except AnalysisException:
        return None


def ingest_stream(docs: DataFrame, path: str, checkpoint: str, settings: Settings | None = None) -> StreamingQuery:
    """Appends what is new of each micro-batch to the memory at path; a document's first text stays.

    A batch writes its own folders, the known documents last: one that failed in
    between is written over when it comes again, and loses nothing.
    """
    def batch(df: DataFrame, number: int) -> None:
        if df.take(1):
            known = _known(df.sparkSession, path)
            others = None if known is None else known.where(F.col("batch") != str(number))
            ingest(df, settings, others).save(path, str(number))

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
