"""Extractive answers from a context, and the prompt for a model that a caller brings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import let, strip, words

# Fixed value: the answer where there is no context.
UNKNOWN = "I cannot determine that from the context."
# What a shared entity and a shared root are worth beside a shared word.
ENTITY_WORTH, SAME_ROOT, ROOT_AMONG_TERMS = 1.5, 3.0, 1.5
#: Words that carry no content, where no parser says so.
STOP_WORDS = tuple("a an and are as at be been but by do does for from had has have how i if in is it its of on or our so that the their they this to was we were what when where which who why will with you your".split())


def content_terms(c: Column) -> Column:
    """Words of content in order, repeats included."""
    return F.filter(words(c), is_content)


def is_content(w: Column) -> Column:
    return ~w.isin(*STOP_WORDS) & ~w.rlike("^[0-9]+$")


def question_word(query: Column) -> Column:
    """The first of who, what, where, when, why; empty if none."""
    return F.regexp_extract(F.lower(query), r"\b(who|what|where|when|why)\b", 1)


def lines_of(context: Column) -> Column:
    """Each non-blank line of a context, without a leading [Sn]."""
    def unmarked(s: Column) -> Column:
        return F.when(s.startswith("[S"), F.regexp_replace(s, r"^\[S\d+\]\s*", "")).otherwise(s)

    return F.filter(F.transform(F.split(context, "\n", -1), lambda s: let(strip(s), unmarked)), lambda s: s != "")


def context_lines(contexts: DataFrame) -> DataFrame:
    return contexts.select("document_id", "query_id", F.posexplode(lines_of(F.col("context"))).alias("line_no", "line"))


#: What a parser may say of a line, as columns of the parsed lines: its terms, entities, root, and the phrases that answers are taken from.
PARSED = {"terms": "array<string>", "entities": "array<string>", "root": "string", "subject": "string", "names": "array<string>", "object": "string"}


def line_scores(lines: DataFrame, queries: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """Terms that a line shares with its question, and where a parser gave them, entities of the line in the question and its root.

    parsed has document_id, query_id, line_no and any of the columns of PARSED;
    queries may have terms and root. What is missing is taken from the words,
    or adds nothing.
    """
    known = [] if parsed is None else [c for c in PARSED if c in parsed.columns]
    rows = lines if parsed is None else lines.join(parsed.select("document_id", "query_id", "line_no", *known), ["document_id", "query_id", "line_no"], "left")
    rows = rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in PARSED.items() if c not in known])
    own = [F.col(c).alias(f"asked_{c}") if c in queries.columns else F.lit(None).cast(PARSED[c]).alias(f"asked_{c}") for c in ("terms", "root")]
    rows = rows.join(queries.select("query_id", "query", *own), "query_id")
    terms = F.array_distinct(F.coalesce("terms", content_terms(F.col("line"))))
    shared = F.size(F.array_intersect(terms, F.coalesce("asked_terms", content_terms(F.col("query")))))
    entities = F.size(F.filter(F.coalesce("entities", F.array().cast("array<string>")), lambda e: F.contains(F.lower("query"), F.lower(e))))
    root = F.lower(F.trim(F.coalesce("asked_root", F.lit(""))))
    rooted = F.when(root == "", 0.0).when(root == F.lower(F.trim("root")), SAME_ROOT).when(F.array_contains(terms, root), ROOT_AMONG_TERMS).otherwise(0.0)
    return rows.withColumn("score", shared + entities * F.lit(ENTITY_WORTH) + rooted)


def _reason(line: Column) -> Column:
    """After the first because, up to a comma or the final full stops."""
    first = F.substring(line, F.locate("because", F.lower(line)) + F.lit(7), F.length(line))
    return strip(F.split(F.regexp_replace(strip(first), r"\.+$", ""), ",")[0])


def _extracted(queries: DataFrame) -> Column:
    """The answer from a row's context to its query, as extractive gives it without parsed lines, in place."""
    root = F.lower(F.trim(F.coalesce("root", F.lit("")))) if "root" in queries.columns else F.lit("")
    asked = content_terms(F.col("query"))
    wanted = F.coalesce("terms", asked) if "terms" in queries.columns else asked
    why = question_word(F.col("query")) == "why"

    def ranked(own: Column, wanted: Column) -> Column:
        def one(line: Column, k: Column) -> Column:
            def score(own: Column) -> Column:
                rooted = F.when((root != "") & is_content(root) & F.array_contains(own, root), ROOT_AMONG_TERMS).otherwise(0.0)
                return F.size(F.filter(wanted, lambda t: F.array_contains(own, t))) + rooted

            minus = -let(words(line), score)
            return F.struct(minus.alias("minus"), k.alias("k"), line.alias("line"), F.when(why & F.contains(F.lower(line), F.lit("because")), _reason(line)).alias("taken"))

        return F.transform(own, one)

    def best(rows: Column) -> Column:
        return F.coalesce(F.array_min(F.filter(rows, lambda x: x["taken"].isNotNull()))["taken"], F.array_min(rows)["line"], F.lit(UNKNOWN))

    # Few words are asked for: those that carry no content count in no line.
    return let(let(F.filter(F.array_distinct(wanted), is_content), lambda w: ranked(lines_of(F.col("context")), w)), best)


def extractive(contexts: DataFrame, queries: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """document_id, query_id, answer, from the lines in order of their score.

    "who" takes the first line's subject, or else its first name, of the first
    line that has one; "what", "where" and "when" the first object; "why" what
    follows the first because. Otherwise, and where there is none, the best
    line answers.
    """
    if parsed is None:
        known = queries.select("query_id", "query", *[c for c in ("terms", "root") if c in queries.columns])
        rows = contexts.select("document_id", "query_id", "context").join(known, "query_id", "left")
        return rows.select("document_id", "query_id", F.coalesce(_extracted(queries), F.lit(UNKNOWN)).alias("answer"))
    ranked = line_scores(context_lines(contexts), queries, parsed).withColumn("wh", question_word(F.col("query")))
    order = Window.partitionBy("document_id", "query_id").orderBy(F.desc("score"), "line_no")
    blank = F.lit("")
    who = F.coalesce(F.nullif("subject", blank), F.nullif(F.get("names", F.lit(0)), blank))
    why = F.when(F.contains(F.lower("line"), F.lit("because")), _reason(F.col("line")))
    taken = F.when(F.col("wh") == "who", who).when(F.col("wh").isin("what", "where", "when"), F.nullif("object", blank)).when(F.col("wh") == "why", why)
    ranked = ranked.withColumn("rank", F.row_number().over(order)).withColumn("taken", taken)
    best = ranked.groupBy("document_id", "query_id").agg(F.min_by("line", "rank").alias("top"), F.min_by("taken", F.when(F.col("taken").isNotNull(), F.col("rank"))).alias("said"))
    answer = F.coalesce("said", "top", F.lit(UNKNOWN))
    return contexts.select("document_id", "query_id").join(best, ["document_id", "query_id"], "left").select("document_id", "query_id", answer.alias("answer"))


def prompt(query: Column, context: Column) -> Column:
    return F.concat(F.lit("Use nothing but the context to answer. If it does not hold the answer, say so.\n\nContext:\n"), context, F.lit("\n\nQuestion: "), query, F.lit("\nAnswer:"))


def answered(contexts: DataFrame, queries: DataFrame, model=None, parsed: DataFrame | None = None) -> DataFrame:
    """Answer packets, with the contexts' metadata if they have any. model maps a column of prompts to answers (a pandas UDF, say); without it answers are extractive."""
    asked = contexts.join(queries.select("query_id", "query", *[c for c in ("terms", "root") if c in queries.columns]), "query_id")
    if model is None and parsed is None:
        rows, mode = asked.withColumn("answer", F.coalesce(_extracted(queries), F.lit(UNKNOWN))), "extractive"
    elif model is None:
        rows = asked.join(extractive(contexts, queries, parsed), ["document_id", "query_id"])
        mode = "extractive"
    else:
        rows, mode = asked.withColumn("answer", F.trim(model(prompt(F.col("query"), F.col("context"))))), "model"
    return rows.select("document_id", "query_id", F.col("query").alias("question"), F.col("context").alias("reduced_context"), F.struct(F.lit(mode).alias("mode"), "answer").alias("answer"), *[c for c in ("metadata",) if c in contexts.columns])
