"""Evaluation questions from Markdown documents: sections, documents worth asking about, questions with expected phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip, word_count
from .evaluate import phrases

# Header names of each section, the first that occurs counts; questions and categories by section.
HEADERS = {
    "summary": ("Summary",), "motivation": ("Motivation",), "design": (r"Detailed\s+Design", "Proposal", "Design"), "alternatives": ("Alternatives",),
    "constraints": ("Non-Goals", "Constraints", "Limitations", "Drawbacks"), "reasoning": ("Goals", "Reasoning", r"Unresolved\s+Questions?"),
}
ASKS = {
    "summary": ("What is the summary of document %s?", "general"), "motivation": ("What is the motivation for document %s?", "constraint"),
    "design": ("What is the proposed detailed design of document %s?", "workflow"), "alternatives": ("What are the alternatives considered in document %s?", "decision"),
    "reasoning": ("What is the reasoning and unresolved questions in document %s?", "reason"),
}
#: Sections that are asked about in turn.
TURNS = ("summary", "motivation", "design", "alternatives")
#: Least words of each section of a document that is asked about.
LEAST_WORDS = 15
LEFT_OUT = ("template", "owners", "license", "triagebot")


def _first(text: Column, names: tuple[str, ...]) -> Column:
    """Where a section's header begins and ends, counted from 1; null without one."""
    out = F.lit(None).cast("struct<at:int,end:int>")
    for name in reversed(names):
        pattern = F.lit(rf"(?im)^#+\s+{name}")
        at = F.regexp_instr(text, pattern)
        out = F.when(at > 0, F.struct(at.alias("at"), (at + F.length(F.regexp_extract(text, rf"(?im)^#+\s+{name}", 0))).alias("end"))).otherwise(out)
    return out


def sections(docs: DataFrame) -> DataFrame:
    """document_id, section, content: from a section's first header to the next recognised one."""
    found = F.array(*[F.struct(_first(F.col("text"), names).alias("p"), F.lit(k).alias("section")) for k, names in HEADERS.items()])
    rows = docs.withColumn("found", F.array_sort(F.filter(found, lambda x: x["p"].isNotNull())))
    text = F.col("text")

    def content(x: Column, i: Column) -> Column:
        after = F.coalesce(F.get("found", i + 1)["p"]["at"], F.length(text) + 1)
        return F.struct(x["section"].alias("section"), strip(F.substring(text, x["p"]["end"], after - x["p"]["end"])).alias("content"))

    return rows.select("document_id", F.inline(F.transform("found", content)))


def strong_documents(docs: DataFrame) -> DataFrame:
    """Documents with all six sections at length, and no name that tells of a template or the like."""
    name = F.lower("document_id")
    fine = ~F.contains(name, F.lit(LEFT_OUT[0]))
    for word in LEFT_OUT[1:]:
        fine = fine & ~F.contains(F.element_at(F.split(name, "/"), -1), F.lit(word))
    full = sections(docs).where(word_count(F.col("content")) >= LEAST_WORDS).groupBy("document_id").agg(F.count("*").alias("n")).where(F.col("n") == len(HEADERS))
    return docs.where(fine).join(full, "document_id", "left_semi")


def question_set(docs: DataFrame, n: int, each: int = 1) -> DataFrame:
    """Questions about the first n strong documents by id: two of each document in turn, one of four in turn, or about all five sections (each=5)."""
    first = strong_documents(docs).orderBy("document_id").limit(n)
    # At most n rows: a stated bound.
    first = first.withColumn("k", F.row_number().over(Window.orderBy("document_id")) - 1)
    if each == 2:
        wanted = F.when(F.col("k") % 2 == 0, F.array(F.lit("summary"), F.lit("design"))).otherwise(F.array(F.lit("motivation"), F.lit("alternatives")))
    elif each == 5:
        wanted = F.array(*map(F.lit, ASKS))
    else:
        wanted = F.array(F.element_at(F.array(*map(F.lit, TURNS)), (F.col("k") % 4 + 1).cast("int")))
    asked = first.select("document_id", F.explode(wanted).alias("section")).join(sections(docs), ["document_id", "section"])
    name = F.regexp_replace(F.element_at(F.split("document_id", "/"), -1), r"\.md$", "")
    question, category = F.lit(None).cast("string"), F.lit(None).cast("string")
    for section, (template, kind) in ASKS.items():
        question = F.when(F.col("section") == section, F.format_string(template, name)).otherwise(question)
        category = F.when(F.col("section") == section, F.lit(kind)).otherwise(category)
    return asked.select("document_id", F.concat_ws("-", name, "section").alias("question_id"), question.alias("question"), phrases(F.col("content")).alias("expected_phrases"), category.alias("category"))


def two_corpora(first: DataFrame, second: DataFrame, n_first: int = 25, n_second: int = 50) -> DataFrame:
    """Two questions about each of the first corpus, one about each of the second; corpus says which."""
    parts = [question_set(docs, n, each).withColumn("corpus", F.lit(name)) for name, docs, n, each in (("first", first, n_first, 2), ("second", second, n_second, 1))]
    return parts[0].unionByName(parts[1])


def document_names(questions: DataFrame) -> DataFrame:
    """The documents that are asked about, by name."""
    return questions.select("document_id").distinct().orderBy("document_id")


def questions_of(questions: DataFrame, document_id: str) -> DataFrame:
    return questions.where(F.col("document_id") == document_id)
