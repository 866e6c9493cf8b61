"""Retrieval baselines: everything, Okapi BM25 over lines, and vector search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import cosine, dot, let, rounded

# BM25's saturation, length weight, and share of the mean that replaces a negative weight.
K1, B, EPSILON = 1.5, 0.75, 0.25


def bm25(lines: DataFrame, queries: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """document_id, line_no, query_id, score of the lines that hold a word of the question. Words are split at white space, case kept.

    Weights belong to a document; one of its lines is one text. pairs names
    (document_id, query_id); without it every document is asked everything.
    """
    rows = scored_lines(lines, queries, pairs).withColumn("lines", F.filter("lines", lambda x: x["score"].isNotNull()))
    return rows.select("document_id", "query_id", F.explode("lines").alias("x")).select("document_id", "x.line_no", "query_id", "x.score")


def scored_lines(lines: DataFrame, queries: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """document_id, query_id, lines: all lines of a document in order, each with its bm25 score, null where it holds no word of the question.

    One shuffle, of the lines by document; the rest are expressions over a document's lines. None where lines has
    a row for each document (segment.lines_of), and no further one where that names its question in query_id.
    """
    def split(c: str | Column) -> Column:
        return F.regexp_extract_all(c, F.lit(r"(?U)\S+"), F.lit(0))

    rows = _gathered(lines)
    own_question = ["query_id"] if "query_id" in rows.columns else []
    rows = rows.withColumn("words", F.transform("lines", lambda x: split(x["line"]))).withColumn("n", F.size("lines"))
    total = F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + F.size(w))
    rows = rows.select("document_id", *own_question, "lines", "words", "n", (total / F.col("n")).alias("mean"), _floor(F.col("words"), F.col("n")).alias("floor"))
    asked = queries.select("query_id", split("query").alias("terms"))
    if own_question:
        rows = rows.join(F.broadcast(asked), "query_id")
    elif pairs is None:
        rows = rows.crossJoin(F.broadcast(asked))
    else:
        rows = rows.join(pairs.select("document_id", "query_id").join(asked, "query_id"), "document_id")

    def weight(t: Column, own: Column) -> Column:
        raw = let(F.size(F.filter(own, lambda o: F.array_contains(o, t))), lambda df: _raw(F.col("n"), df))
        return let(raw, lambda r: F.when(r < 0, F.col("floor")).otherwise(r))

    def score(words: Column, own: Column, weights: Column) -> Column:
        def part(x: Column) -> Column:
            tf = F.size(F.filter(words, lambda w: w == x["term"]))
            return let(tf, lambda tf: x["idf"] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.size(words) / F.col("mean"))))

        held = F.filter(weights, lambda x: F.array_contains(own, x["term"]))
        return F.when(F.size(own) > 0, F.aggregate(held, F.lit(0.0), lambda s, x: s + part(x)))

    def every(own: Column) -> Column:
        weights = F.transform("terms", lambda t: F.struct(t.alias("term"), weight(t, own).alias("idf")))
        return let(weights, lambda w: F.transform("lines", lambda x, k: F.struct(x["line_no"].alias("line_no"), x["line"].alias("line"), score(F.col("words")[k], own[k], w).alias("score"))))

    own = F.transform("words", lambda w: F.array_intersect(w, F.col("terms")))
    return rows.select("document_id", "query_id", let(own, every).alias("lines"))


def _gathered(lines: DataFrame) -> DataFrame:
    """document_id, lines, in order; each document once."""
    return lines if "lines" in lines.columns else lines.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("lines"))


def _raw(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def _floor(words: Column, n: Column) -> Column:
    """A share of the mean weight of a document's words, which stands for negative weights. Words are sorted and counted in their runs."""
    def mean(own: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: (i == 0) | (own[i] != own[F.greatest(i - 1, F.lit(0))]))
        dfs = let(begins, lambda b: F.transform(b, lambda i, j: F.coalesce(F.get(b, j + 1), F.size(own)) - i))
        return let(dfs, lambda d: F.aggregate(d, F.lit(0.0), lambda s, df: s + _raw(n, df)) / F.size(d) * EPSILON)

    each = F.sort_array(F.flatten(F.transform(words, lambda w: F.array_distinct(w))))
    return let(each, lambda own: F.when(F.size(own) > 0, mean(own)))


def best_lines(rows: DataFrame, n: int, digits: int) -> DataFrame:
    """document_id, query_id, lines: the n best of rows' lines, best first. Scores are rounded, 0 where there is none; ties by place."""
    ranked = F.sort_array(F.transform("lines", lambda x: F.struct((-rounded(F.coalesce(x["score"], F.lit(0.0)), digits)).alias("minus"), x["line_no"].alias("line_no"), x["line"].alias("line"))))
    return rows.select("document_id", "query_id", F.slice(ranked, 1, n).alias("lines"))


def joined_lines(rows: DataFrame, by_place: bool = False) -> DataFrame:
    """document_id, query_id, context: rows' lines as they are ranked (keyword search) or in order of place (vector search)."""
    own = F.sort_array(F.transform("lines", lambda x: F.struct(x["line_no"].alias("line_no"), x["line"].alias("line")))) if by_place else F.col("lines")
    return rows.select("document_id", "query_id", F.array_join(F.transform(own, lambda x: x["line"]), "\n").alias("context"))


def liked_lines(lines: DataFrame, queries: DataFrame, embed) -> DataFrame:
    """document_id, query_id, lines: all lines of a document with the cosine of their vector and the question's, for each of a few questions.

    embed is as for line_vector_scores; vectors are compared where lines are read, and are not shuffled. Nothing is
    where lines has a row for each document (segment.lines_of); embed is then a function of an array's elements too.
    """
    asked = queries.select(F.struct("query_id", embed(F.col("query")).alias("v")).alias("a")).agg(F.sort_array(F.collect_list("a")).alias("asked"))
    def likes(v: Column) -> Column:
        return let(F.sqrt(dot(v, v)), lambda own: F.transform("asked", lambda a: F.coalesce(F.try_divide(dot(v, a["v"]), own * F.sqrt(dot(a["v"], a["v"]))), F.lit(0.0))))

    if "lines" in lines.columns:
        each = F.transform("lines", lambda x: F.struct(x["line_no"].alias("line_no"), x["line"].alias("line"), let(embed(x["line"]), likes).alias("scores")))
        rows = lines.crossJoin(F.broadcast(asked)).select("document_id", each.alias("lines"))
    else:
        own = lines.select("document_id", "line_no", "line", embed(F.col("line")).alias("v")).crossJoin(F.broadcast(asked))
        rows = own.groupBy("document_id").agg(F.collect_list(F.struct("line_no", "line", likes(F.col("v")).alias("scores"))).alias("lines"))
    names = asked.select(F.posexplode("asked").alias("k", "a")).select("k", "a.query_id")
    one = F.transform("lines", lambda x: F.struct(x["line_no"].alias("line_no"), x["line"].alias("line"), x["scores"][F.col("k")].alias("score")))
    return rows.crossJoin(F.broadcast(names)).select("document_id", "query_id", one.alias("lines"))


def with_the_rest(scores: DataFrame, lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """Scores of all lines of the pairs' documents: 0 for lines that hold none of the question's words."""
    every = lines.select("document_id", "line_no").join(pairs.select("document_id", "query_id"), "document_id")
    return every.join(scores, ["document_id", "line_no", "query_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def top_lines(scores: DataFrame, n: int) -> DataFrame:
    """The n best lines of each pair; ties by place."""
    order = Window.partitionBy("document_id", "query_id").orderBy(F.desc("score"), "line_no")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def context_of(lines: DataFrame, chosen: DataFrame, by: str = "rank") -> DataFrame:
    """document_id, query_id, context: the chosen lines in order of rank (keyword search) or of place (vector search)."""
    rows = lines.join(chosen, ["document_id", "line_no"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("o"), "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("document_id", "query_id").agg(joined.alias("context"))


def vector_scores(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, vec_id, score: cosine of each vector with each of a few question vectors, which every executor gets."""
    q = queries.select("query_id", F.col("embedding").alias("asked"))
    return vectors.crossJoin(F.broadcast(q)).select("query_id", "vec_id", cosine(F.col("embedding"), F.col("asked")).alias("score"))


def line_vector_scores(lines: DataFrame, queries: DataFrame, pairs: DataFrame, embed) -> DataFrame:
    """document_id, line_no, query_id, score: cosine of each line's vector with its question's, for lines that are like it at all.

    embed is a function of a column of text that gives its vector (a pandas UDF, say).
    """
    own = lines.select("document_id", "line_no", embed(F.col("line")).alias("v")).join(pairs.select("document_id", "query_id"), "document_id")
    return own.join(queries.select("query_id", embed(F.col("query")).alias("q")), "query_id").select("document_id", "line_no", "query_id", F.coalesce(cosine(F.col("v"), F.col("q")), F.lit(0.0)).alias("score"))


def letter_counts(text: Column) -> Column:
    """A stand-in for a sentence embedder: how often each letter from a to z occurs."""
    return let(F.lower(text), lambda low: F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c)))).cast("double") for c in "abcdefghijklmnopqrstuvwxyz"]))


def top_vectors(scores: DataFrame, n: int, library_top: int = 10, keys: tuple[str, ...] = ("query_id",), place: str = "vec_id") -> DataFrame:
    """The n best of each question's library_top, for a context in order of place."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), place)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= min(n, library_top))
