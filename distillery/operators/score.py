"""Question features, term weights and the score of a unit for a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WORD, let, words
from .classify import weight

# The patterns of hard identifiers, words that ask for a process, pronouns, types worth preserving, and what each part of the score is worth.
IDENTIFIER = r"\b[A-Z]+-[A-Z0-9\-]+\b|\b[A-Z0-9]{3,}\b|\[[A-Z]+-\d+\]|\b[A-Z][a-z]+[A-Z][a-zA-Z0-9]*\b|\bv\d+(?:\.\d+)*\b"
PROCESS_WORDS = ("pipeline", "workflow", "process", "steps", "stages")
PRONOUNS = ("he", "she", "it", "its", "his", "her", "they", "their")
PRESERVED = ("decision", "constraint", "goal", "workflow", "task", "question")
QUESTION_WORDS = ("who", "what", "where", "when", "why")
TYPE_WORTH, FURTHER_TERM, PHRASE_WORTH, INTENT_WORTH, IDENTIFIER_WORTH, ENTITY_WORTH, PRONOUN_WORTH, NOUN_WORTH, PRIORITY = 2.0, 1.5, 5.0, 3.0, 15.0, 3.0, 1.0, 2.0, 2.5
CLOSE, CLOSE_WORTH, NEAR, NEAR_WORTH, FAR_WORTH, LINK_WORTH, MOST_LINKS = 0.65, 12.0, 0.45, 6.0, 2.0, 0.1, 1.0
#: Questions that every document may be asked without naming pairs.
MOST_QUESTIONS = 1000


def question_features(queries: DataFrame) -> DataFrame:
    """query_id, query, terms, hard_identifiers, clean_words, wh_words; entities, noun_chunks and root_lemma are columns that a parser gave, else empty."""
    plain = F.regexp_extract_all("query", F.lit(WORD), F.lit(0))
    terms = F.array_sort(F.array_distinct(F.transform(F.filter(plain, lambda w: F.length(w) > 2), F.lower)))
    clean = F.regexp_extract_all(F.lower("query"), F.lit(WORD), F.lit(0))
    wh = F.array_sort(F.array_distinct(F.filter(F.transform(plain, F.lower), lambda w: w.isin(*QUESTION_WORDS))))
    none = F.array().cast("array<string>")
    hooked = [F.col(c) if c in queries.columns else none.alias(c) for c in ("entities", "noun_chunks")]
    ids = F.array_sort(F.array_distinct(F.regexp_extract_all("query", F.lit(IDENTIFIER), F.lit(0))))
    hooked.append(F.lower(F.trim("root_lemma")).alias("root_lemma") if "root_lemma" in queries.columns else F.lit("").alias("root_lemma"))
    return queries.select("query_id", "query", terms.alias("terms"), ids.alias("hard_identifiers"), clean.alias("clean_words"), wh.alias("wh_words"), *hooked)


def idf(units: DataFrame) -> DataFrame:
    """document_id, term, idf of each word of two letters or more: ln(N / (1 + df)) + 1 over a document's units."""
    each = units.select("document_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term")).where("length(term) >= 2")
    df = each.groupBy("document_id", "term").agg(F.count("*").alias("df"))
    n = units.groupBy("document_id").agg(F.count("*").alias("n"))
    return df.join(n, "document_id").select("document_id", "term", (F.log(F.col("n") / (1 + F.col("df"))) + 1).alias("idf"))


def asked_idf(units: DataFrame, features: DataFrame) -> DataFrame:
    """document_id and the weights of the terms that any question asks for, as a map: bounded by the questions."""
    asked = features.select(F.explode("terms").alias("term")).distinct()
    kept = idf(units).join(asked, "term", "left_semi")
    return kept.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("idf"))


def matched_terms(low: Column, terms: Column) -> Column:
    return F.filter(terms, lambda t: F.contains(low, t))


def lexical_score(matched: Column, weights: Column) -> Column:
    """Sum of term weights (1 if unknown), raised by half for each further term."""
    total = F.aggregate(matched, F.lit(0.0), lambda s, t: s + F.coalesce(F.try_element_at(weights, t), F.lit(1.0)))
    return total * F.pow(F.lit(FURTHER_TERM), F.greatest(F.size(matched) - 1, F.lit(0)))


def phrase_bonus(low: Column, clean: Column) -> Column:
    phrase = F.array_join(clean, " ")
    return F.when((F.length(phrase) > 4) & F.contains(low, phrase), PHRASE_WORTH).otherwise(0.0)


def dense_bonus(d: Column) -> Column:
    return F.when(d > CLOSE, d * CLOSE_WORTH).when(d > NEAR, d * NEAR_WORTH).otherwise(F.greatest(d, F.lit(0.0)) * FAR_WORTH)


def intent_bonus(kind: Column, terms: Column) -> Column:
    typed = F.when(F.arrays_overlap(F.split(kind, "_"), terms), INTENT_WORTH).otherwise(0.0)
    process = F.arrays_overlap(terms, F.array(*map(F.lit, PROCESS_WORDS)))
    return typed + F.when((kind == "workflow") & process, INTENT_WORTH).otherwise(0.0)


def identifier_boost(text: Column, low: Column, ids: Column) -> Column:
    return F.size(F.filter(ids, lambda h: F.contains(text, h) | F.contains(low, F.lower(h)))) * F.lit(IDENTIFIER_WORTH)


def entity_bonus(low: Column, entities: Column) -> Column:
    found = F.size(F.filter(entities, lambda e: F.contains(low, e))) * F.lit(ENTITY_WORTH)
    pronoun = F.arrays_overlap(F.regexp_extract_all(low, F.lit(r"(?U)\S+"), F.lit(0)), F.array(*map(F.lit, PRONOUNS)))
    return found + F.when((F.size(entities) > 0) & pronoun, PRONOUN_WORTH).otherwise(0.0)


def scored(units: DataFrame, features: DataFrame, connectivity: DataFrame | None = None, pairs: DataFrame | None = None, dense: DataFrame | Column | None = None) -> DataFrame:
    """Units with a score for each question. pairs names (document_id, query_id); without it every document is asked each of a few questions.

    dense gives (document_id, unit_pos, query_id, dense), 0 where absent, or is an expression of the unit's and the
    question's columns, which joins nothing. Units that bring their connectivity and idf (whole.units) join nothing either.
    """
    if connectivity is not None:
        units = units.join(connectivity, ["document_id", "unit_pos"]).join(asked_idf(units, features), "document_id", "left")
    rows = asked(units, features, pairs)
    if isinstance(dense, Column):
        rows = rows.withColumn("dense", F.coalesce(dense, F.lit(0.0)))
    else:
        rows = rows.join(dense, ["document_id", "unit_pos", "query_id"], "left").withColumn("dense", F.coalesce("dense", F.lit(0.0))) if dense is not None else rows.withColumn("dense", F.lit(0.0))
    rows = rows.withColumn("idf", F.coalesce("idf", F.create_map().cast("map<string,double>"))).withColumn("low", F.lower("text"))
    low, text = F.col("low"), F.col("text")
    rows = rows.withColumn("lexical", lexical_score(matched_terms(low, F.col("terms")), F.col("idf")))
    rows = rows.withColumn("hard", identifier_boost(text, low, F.col("hard_identifiers"))).withColumn("entity", entity_bonus(low, F.col("entities")))
    rows = rows.withColumn("noun", F.size(F.filter("noun_chunks", lambda n: F.contains(F.col("low"), n))) * F.lit(NOUN_WORTH))
    rows = rows.withColumn("phrase", phrase_bonus(low, F.col("clean_words"))).withColumn("intent", intent_bonus(F.col("unit_type"), F.col("terms")))
    related = (F.col("lexical") > 0) | (F.col("entity") > 0) | (F.col("noun") > 0) | (F.col("dense") > NEAR) | (F.col("hard") > 0)
    rows = rows.withColumn("priority", F.when(F.col("unit_type").isin(*PRESERVED) & related, PRIORITY).otherwise(0.0))
    near = F.least(F.col("connectivity") * F.lit(LINK_WORTH), F.lit(MOST_LINKS))
    parts = weight(F.col("unit_type")) * TYPE_WORTH + F.col("lexical") + F.col("phrase") + dense_bonus(F.col("dense")) + F.col("entity") + F.col("noun") + near + F.col("intent") + F.col("hard") + F.col("priority")
    # Rounded, so that the order in which a sum was taken decides no tie.
    return rows.withColumn("score", F.round(parts, 9))


def scored_units(units: Column, near: Column) -> Column:
    """The units of one document (choose.documents) with a score for the row's question, as scored gives it without dense scores. near has the connectivity of each."""
    terms, entities, chunks = F.col("terms"), F.col("entities"), F.col("noun_chunks")
    hits = F.flatten(F.transform(units, lambda u: F.array_intersect(u["words"], terms)))

    def idf_of(df: Column) -> Column:
        return F.when(df == 0, 1.0).otherwise(F.log(F.size(units) / (1 + df)) + 1)

    weights = let(hits, lambda own: F.transform(terms, lambda t: F.struct(t.alias("term"), let(F.size(F.filter(own, lambda h: h == t)), idf_of).alias("w"))))

    def lexical(low: Column, known: Column) -> Column:
        matched = F.filter(known, lambda x: F.contains(low, x["term"]))
        return let(matched, lambda m: F.aggregate(m, F.lit(0.0), lambda s, x: s + x["w"]) * F.pow(F.lit(FURTHER_TERM), F.greatest(F.size(m) - 1, F.lit(0))))

    def one(u: Column, k: Column, known: Column) -> Column:
        low = u["low"]
        own = F.struct(lexical(low, known).alias("lexical"), identifier_boost(u["text"], low, F.col("hard_identifiers")).alias("hard"), entity_bonus(low, entities).alias("entity"), (F.size(F.filter(chunks, lambda n: F.contains(low, n))) * F.lit(NOUN_WORTH)).alias("noun"))
        links = F.least(near[k] * F.lit(LINK_WORTH), F.lit(MOST_LINKS))

        def total(p: Column) -> Column:
            related = (p["lexical"] > 0) | (p["entity"] > 0) | (p["noun"] > 0) | (p["hard"] > 0)
            priority = F.when(u["unit_type"].isin(*PRESERVED) & related, PRIORITY).otherwise(0.0)
            return F.round(weight(u["unit_type"]) * TYPE_WORTH + p["lexical"] + phrase_bonus(low, F.col("clean_words")) + p["entity"] + p["noun"] + links + intent_bonus(u["unit_type"], terms) + p["hard"] + priority, 9)

        return F.struct(let(own, total).alias("score"), *[u[c].alias(c) for c in ("unit_pos", "sentence_index", "text", "render_text", "context_header", "same", "words", "tokens")])

    return let(weights, lambda known: F.transform(units, lambda u, k: one(u, k, known)))


def asked(rows: DataFrame, features: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Rows of documents with the questions that they are asked: those of the pairs, or else each of a few."""
    if pairs is not None:
        return rows.join(pairs.select("document_id", "query_id"), "document_id").join(features, "query_id")
    few(features.select("query_id"))
    return rows.crossJoin(F.broadcast(features))


def few(features: DataFrame) -> list:
    """The rows of questions that every document is asked."""
    rows = features.head(MOST_QUESTIONS + 1)
    if len(rows) > MOST_QUESTIONS:
        raise ValueError(f"name the pairs of documents and questions: there are more than {MOST_QUESTIONS} questions")
    return rows
