"""What the training-data operators share: table access and the shared folder."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path for one run's tables in the folder that driver and executors share.

    ``spark.checkpoint.dir`` names it; where that is unset, it is in the warehouse.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/distillery/{label}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back, which cuts its lineage."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a table that no later read needs."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_others(spark: SparkSession, path: str, kept: set[str]) -> None:
    """Deletes what is under a path but for the names that later reads need."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(p):
        if status.getPath().getName() not in kept:
            fs.delete(status.getPath(), True)


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under names that clash with nothing (c0, c1, ...), and the own names of those columns in order."""
    own = {f"c{k}": name for k, name in enumerate(docs.columns)}
    return docs.toDF(*own), own


#: A key with more than one in HOT of a table's rows takes its facts from a broadcast: of HOT keys at most.
HOT = 1000


def hot_join(rows: DataFrame, facts: DataFrame, keys: list[str], uses: str, total: int) -> DataFrame:
    """rows joined with the facts of their keys; ``uses`` of the facts says how many of the ``total`` rows have them.

    Rows of a hot key stay where they are; facts may leave keys out, and their rows go.
    """
    hot = F.broadcast(facts.where(F.col(uses) * HOT > total).drop(uses))
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(facts.where(F.col(uses) * HOT <= total).drop(uses), keys)
    return cold.unionByName(rows.join(hot, keys))


def few(keys: DataFrame, limit: int = 500_000) -> DataFrame:
    """A table of one number a row, to be sent to every executor if it has no more rows than the limit, which it is asked."""
    return F.broadcast(keys) if keys.count() <= limit else keys


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def doc_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, a null text as the empty one; other columns never get in the way."""
    return docs.select(F.col("doc_id").cast(T.LongType()).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def joined_spans(spans: Column) -> Column:
    """kind:start:end of an array of such structs, comma-joined in its order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(kind: str):
    return lambda span: span["kind"] == kind


def utf8(column) -> list[bytes]:
    """The bytes of an Arrow column of strings."""
    return column.cast("binary").to_pylist()


def slices(batches, rows: int = 512):
    """The same rows in smaller batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def give_back() -> None:
    """Returns to the system what earlier stages left in this worker: encoders with their tables, and memory that is free.

    Spark's workers serve one stage after another, and would hold a vocabulary
    and its table of words through stages that encode nothing. For the start of
    a task that does not encode.
    """
    from . import tokens

    if tokens.forget():
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def task_number() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0
