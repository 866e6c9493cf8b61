"""Ingest documents once, then reduce them for any number of questions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens, rounded
from ..operators import answers, choose, classify, graphs, score, segment, whole


@dataclass(frozen=True)
class Settings:
    max_sentences: int = 4
    max_tokens: int | None = None
    context_window: int = 1
    min_tokens: int = 250
    extractors: Sequence[classify.Extractor] = classify.LEXICAL
    splitter: Callable[[Column], Column] = segment.by_capitals

    #: Ranges and first values that a user may choose from.
    OFFERED = {"max_sentences": (3, 12, 6), "context_window": (0, 3, 1), "min_tokens": (100, 1000, 250)}

    @classmethod
    def offered(cls, **chosen: int) -> Settings:
        """Settings within the offered ranges; what is not chosen has its first value."""
        for name, value in chosen.items():
            low, high, _ = cls.OFFERED[name]
            if not low <= value <= high:
                raise ValueError(f"{name} must be from {low} to {high}")
        return cls(**{name: first for name, (_, _, first) in cls.OFFERED.items()} | chosen)

    def __post_init__(self):
        if self.max_sentences < 1 or self.context_window < 0 or self.min_tokens < 0 or (self.max_tokens or 0) < 0:
            raise ValueError("settings must not be negative, and at least one sentence is chosen")


#: Tables of a memory.
SCHEMAS = {
    "units": "document_id string, unit_pos int, sentence_index int, text string, unit_type string, subject string, relation string, object string, context_header string, render_text string, steps array<string>, workflow_name string",
    "knowledge": "document_id string, node string, sentence_idx int",
    "reasoning": "document_id string, source_idx int, target_idx int",
    "meta": "document_id string, original_chars int, original_sentences int, original_estimated_tokens int",
}
#: Parts by the hash of document_id, of which a lookup reads one.
BUCKETS = 64


def bucket(document_id: Column, buckets: Column) -> Column:
    return F.pmod(F.xxhash64(document_id), buckets).cast("int")


@dataclass(frozen=True)
class Memory:
    """What ingesting leaves: documents_meta, units, and the two graphs' edges."""

    meta: DataFrame
    units: DataFrame
    knowledge: DataFrame
    reasoning: DataFrame
    #: The documents themselves, where nothing was brought to ingest them: they are reduced from their rows.
    docs: DataFrame | None = None

    #: In the order in which they are written. A document is known by its row in meta, so that comes last.
    NAMES = ("units", "knowledge", "reasoning", "meta")

    def save(self, path: str, batch: str = "0", buckets: int = BUCKETS) -> Memory:
        """Writes the tables under a batch, over what an earlier attempt at it left."""
        spark = self.units.sparkSession
        spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // buckets)
        for name in self.NAMES:
            rows = getattr(self, name).select(*[F.col(c.split()[0]) for c in SCHEMAS[name].split(", ")])
            rows = rows.withColumn("buckets", F.lit(buckets)).withColumn("bucket", bucket(F.col("document_id"), F.lit(buckets)))
            if buckets > 1:
                # A bucket is written by several tasks where there are more tasks than buckets.
                rows = rows.repartition("bucket", F.pmod(F.hash("document_id"), F.lit(spread)))
            where = f"{path}/{name}/batch={batch}"
            rows.write.mode("overwrite").partitionBy("buckets", "bucket").parquet(where)
            if name == "units":
                # The edges are made from what was stored, not from the documents again.
                units = spark.read.schema(SCHEMAS["units"]).parquet(where)
                self = Memory(self.meta, units, graphs.knowledge_edges(units), graphs.reasoning_edges(units))
        return self.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Memory:
        return cls(**{name: spark.read.schema(f"{SCHEMAS[name]}, batch string, buckets int, bucket int").parquet(f"{path}/{name}").drop("batch") for name in cls.NAMES})

    def of(self, document_id: str) -> Memory:
        """The memory of one document, read from its bucket alone."""
        one = (F.col("document_id") == document_id) & (F.col("bucket") == bucket(F.lit(document_id), F.col("buckets")))
        return Memory(*[getattr(self, n).where(one).drop("bucket", "buckets") for n in ("meta", "units", "knowledge", "reasoning")])


def new_documents(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The first text of each id (least text in a batch), without ids that are known already."""
    first = docs.groupBy("document_id").agg(F.min("text").alias("text"))
    return first.join(known.select("document_id"), "document_id", "left_anti") if known is not None else first


def by_content(texts: DataFrame) -> DataFrame:
    """Documents whose id is the MD5 of their text."""
    return texts.select(F.md5(F.col("text").cast("binary")).alias("document_id"), "text")


def document_meta(docs: DataFrame, sentences: DataFrame) -> DataFrame:
    """Sizes of each document that has a sentence."""
    n = sentences.groupBy("document_id").agg(F.count("*").cast("int").alias("original_sentences"))
    return docs.join(n, "document_id").select("document_id", F.length("text").alias("original_chars"), "original_sentences", estimate_tokens(F.col("text")).alias("original_estimated_tokens"))


def ingest(docs: DataFrame, settings: Settings | None = None, known: DataFrame | None = None) -> Memory:
    settings = settings or Settings()
    docs = new_documents(docs, known)
    if tuple(settings.extractors) == classify.LEXICAL and settings.splitter is segment.by_capitals:
        units = whole.units(docs).drop("connectivity", "idf")
        return Memory(whole.meta(docs), units, graphs.knowledge_edges(units), graphs.reasoning_edges(units), docs)
    sentences = segment.sentences(docs, settings.splitter)
    units = classify.units(sentences, settings.extractors)
    return Memory(document_meta(docs, sentences), units, graphs.knowledge_edges(units), graphs.reasoning_edges(units))


def retrieve(memory: Memory, queries: DataFrame, settings: Settings | None = None, pairs: DataFrame | None = None, dense: DataFrame | None = None) -> DataFrame:
    """document_id, query_id, context and its sizes, for each asked pair whose document has units."""
    s = settings or Settings()
    features = score.question_features(queries)
    if memory.docs is not None and pairs is None and dense is None:
        return with_ratio(whole.reduced(memory.docs, score.few(features), s))
    # Units are gathered once, by document; connectivity and edges follow from them in place, scores for each question too.
    rows = choose.documents(memory.units)
    rows = rows.select("document_id", "units", graphs.connected(F.col("units")).alias("near"), graphs.edges_of(F.col("units")).alias("edges"))
    if dense is None:
        rows = score.asked(rows, features, pairs).withColumn("units", score.scored_units(F.col("units"), F.col("near")))
    else:
        scored = choose.gathered(score.scored(memory.units, features, graphs.connectivity(memory.units), pairs, dense))
        rows = scored.join(rows.select("document_id", "edges"), "document_id")
    rows = rows.withColumn("selected", choose.greedy(F.col("units"), s.max_sentences, s.max_tokens, s.min_tokens))
    near = choose.adjacent(F.col("units"), F.col("selected"), s.context_window) if s.context_window else F.col("selected")
    rows = rows.withColumn("near", near)
    rows = rows.withColumn("kept", F.when(F.size("selected") > 0, choose.reasoned(F.col("units"), F.col("near"), F.col("edges"))).otherwise(F.col("selected")))
    rows = rows.withColumn("context", choose.assembled(F.col("units"), F.col("kept")))
    return sizes(rows.join(memory.meta, "document_id"))


def recalls(docs: DataFrame, queries: DataFrame, kind: str, settings: Settings | None = None) -> DataFrame:
    """document_id, query_id, recall by kind (evaluate.graph_recall, evaluate.dependency_recall) of what is retrieved for each question; of each document's first half, as question half, and of the whole.

    A document is ingested, reduced, and measured by what its contexts say when they are ingested, all in its own row.
    """
    return whole.recalls(new_documents(docs), score.few(score.question_features(queries)), settings or Settings(), kind)


def sizes(rows: DataFrame) -> DataFrame:
    return with_ratio(rows.withColumn("reduced_sentences", F.size("kept")).withColumn("selected_sentence_count", F.size("selected")))


def with_ratio(rows: DataFrame) -> DataFrame:
    ratio = rounded(1 - F.length("context") / F.greatest("original_chars", F.lit(1)), 4)
    return rows.select(
        "document_id", "query_id", "context", "original_sentences", "reduced_sentences", "selected_sentence_count",
        "original_chars", F.length("context").alias("reduced_chars"), "original_estimated_tokens", estimate_tokens(F.col("context")).alias("reduced_estimated_tokens"), ratio.alias("reduction_ratio"),
    )


def reduce(texts: DataFrame, queries: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Reduces each text for each question; a text's id is its MD5."""
    return retrieve(ingest(by_content(texts), settings), queries, settings)


def cost_saved(reduced: DataFrame, per_token: float = 0.000003) -> DataFrame:
    return reduced.select("document_id", "query_id", ((F.col("original_estimated_tokens") - F.col("reduced_estimated_tokens")) * per_token).alias("cost_saved"))


def run(texts: DataFrame, queries: DataFrame, settings: Settings | None = None, model=None, parsed: DataFrame | None = None) -> DataFrame:
    """Reduces each text for each question and answers from what is left: question, reduced_context, metadata and answer.

    Answers are extractive without a model, a function of a column of prompts.
    """
    reduced = reduce(texts, queries, settings)
    sizes_ = F.struct(*[c for c in reduced.columns if c not in ("document_id", "query_id", "context")])
    # Few questions go to all tasks; a context is answered in its own row.
    return answers.answered(reduced.select("document_id", "query_id", "context", sizes_.alias("metadata")), F.broadcast(queries), model, parsed)
