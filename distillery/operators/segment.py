"""From text to sentences: label lines are merged, lists stay whole, the rest is split at sentence ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import SENTENCE_END, is_list_item, normalize_text, strip


def merged_lines(docs: DataFrame) -> DataFrame:
    """document_id, pos, line: a line that is a label alone takes up the next one, unless that is blank or a list item.

    Merging is greedy from the top, so in a run of lines that could merge, every other one does.
    """
    lines = docs.select("document_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    order = Window.partitionBy("document_id").orderBy("pos")
    label, after = strip(F.col("line")), strip(F.lead("line").over(order))
    colons = F.length(label) - F.length(F.replace(label, F.lit(":")))
    can = F.coalesce(label.endswith(":") & (colons == 1) & (after != "") & ~is_list_item(after), F.lit(False))
    lines = lines.withColumn("label", label).withColumn("after", after).withColumn("can", can)
    lines = lines.withColumn("run", F.sum(F.when(F.col("can"), 0).otherwise(1)).over(order))
    in_run = F.row_number().over(Window.partitionBy("document_id", "run", "can").orderBy("pos"))
    lines = lines.withColumn("merges", F.col("can") & (in_run % 2 == 1))
    lines = lines.withColumn("taken", F.coalesce(F.lag("merges").over(order), F.lit(False))).where("not taken")
    indent = F.regexp_extract("line", r"(?U)^\s*", 0)
    return lines.select("document_id", "pos", F.when(F.col("merges"), F.concat(indent, "label", F.lit(" "), "after")).otherwise(F.col("line")).alias("line"))


def paragraphs_of(text):
    return F.filter(F.transform(F.split(text, "\n\n", -1), strip), lambda p: p != "")


def by_capitals(text):
    """Sentences of a text: cut after . ! or ? where white space and a capital follow."""
    return F.split(text, SENTENCE_END, -1)


def _pieces(paragraph, splitter):
    lines = F.transform(F.split(paragraph, "\n", -1), strip)
    whole = F.flatten(F.transform(F.filter(lines, lambda s: s != ""), lambda s: F.when(is_list_item(s) | s.endswith(":"), F.array(s)).otherwise(splitter(s))))
    return F.when(F.exists(lines, is_list_item), whole).otherwise(splitter(paragraph))


def sentences(docs: DataFrame, splitter=by_capitals) -> DataFrame:
    """document_id, sentence_index, text. One shuffle, by document.

    splitter maps a column of text to an array of its sentences; list items and
    lines that end in a colon never come to it.
    """
    line = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    texts = merged_lines(docs).groupBy("document_id").agg(F.array_join(line, "\n").alias("text"))
    pieces = F.filter(F.flatten(F.transform(paragraphs_of(F.col("text")), lambda p: _pieces(p, splitter))), lambda s: normalize_text(s) != "")
    return texts.select("document_id", F.posexplode(pieces).alias("sentence_index", "text"))


def _plain():
    return F.filter(F.transform(F.split("text", "\n", -1), strip), lambda s: s != "")


def plain_lines(docs: DataFrame) -> DataFrame:
    """document_id, line_no, line: the non-blank lines that the retrieval baselines search."""
    return docs.select("document_id", F.posexplode(_plain()).alias("line_no", "line"))


def lines_of(docs: DataFrame) -> DataFrame:
    """The documents that have such lines, with an array of them, lines, in place of their text. A document has one row."""
    lines = F.transform(_plain(), lambda s, k: F.struct(k.alias("line_no"), s.alias("line")))
    return docs.select(*[c for c in docs.columns if c != "text"], lines.alias("lines")).where(F.size("lines") > 0)
