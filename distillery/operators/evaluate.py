"""Measures of how well a reduced context serves its questions, and their reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import let, normalize_text, rounded, set_cosine, strip, word_set, word_tokens

ALIKE = 0.8
# Weights of the composite score, a raw context's tokens, and the metric of each category.
COMPOSITE = {"reasoning_recall": 0.30, "constraint_recall": 0.25, "decision_traceability": 0.20, "workflow_integrity": 0.15, "general_retention": 0.10}
RAW_TOKENS = 25000 * 1.3 / 3
METRICS = {"constraint": "constraint_recall", "decision": "decision_traceability", "workflow": "workflow_integrity", "reason": "reasoning_recall"}


def phrases(section: Column) -> Column:
    """The first three pieces of a section with five words or more, list marks removed, no code fences."""
    pieces = F.transform(F.split(section, r"(?<=[.!?])\s+|\n+", -1), lambda s: strip(F.regexp_replace(strip(s), r"^[*\-\d.\s#>]+", "")))
    kept = F.filter(pieces, lambda s: (F.size(F.regexp_extract_all(s, F.lit(r"(?U)\S+"), F.lit(0))) >= 5) & ~s.startswith("```") & ~s.endswith("```"))
    return F.slice(kept, 1, 3)


def compression(original: Column, reduced: Column) -> Column:
    """Share of the words that went."""
    return share_gone(word_tokens(original), word_tokens(reduced))


def share_gone(original: Column, reduced: Column) -> Column:
    """The same, of sizes."""
    return 1 - reduced / F.greatest(original, F.lit(1e-9))


#: Vectors of a block, about.
BLOCK = 20_000


def _any_alike():
    """A function of two columns of vectors: for each of the first, whether one of the second has a cosine of ALIKE with it, as ``cosine`` computes it."""
    import pandas as pd

    limit = ALIKE

    def hits(e, f):
        import numpy as np

        def by_size(vectors):
            kept = [(k, np.asarray(v, dtype="float64")) for k, v in enumerate(() if vectors is None else vectors) if v is not None]
            sizes = {len(v) for _, v in kept}
            return {n: ([k for k, v in kept if len(v) == n], np.stack([v for _, v in kept if len(v) == n])) for n in sizes}

        def dot(a, b):
            s = 0.0
            for x, y in zip(a.tolist(), b.tolist()):
                s += x * y
            return s

        def found(ours, theirs):
            out, other = np.zeros(len(ours), dtype=bool), by_size(theirs)
            for n, (places, a) in by_size(ours).items():
                b = other.get(n, (None, a[:0]))[1]
                for i in range(0, len(a), 1024):
                    x = a[i : i + 1024]
                    for j in range(0, len(b), 4096):
                        y = b[j : j + 4096]
                        norms = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None, :]
                        c = (x @ y.T) / norms
                        # A sum in another order decides nothing at the limit.
                        for p, q in np.argwhere(np.abs(c - limit) < 1e-9):
                            c[p, q] = dot(x[p], y[q]) / (dot(x[p], x[p]) ** 0.5 * dot(y[q], y[q]) ** 0.5)
                        out[places[i : i + 1024]] |= ((norms != 0) & ~(c < limit)).any(1)
            return out

        with np.errstate(all="ignore"):
            return pd.Series([found(x, y) for x, y in zip(e, f)])

    hits.__annotations__ = {"e": pd.Series, "f": pd.Series, "return": pd.Series}
    return F.pandas_udf(hits, "array<boolean>")


def semantic_recall(expected: DataFrame, found: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """question_id, recall: share of expected vectors that some found vector of the question is like; 0 where nothing was found.

    questions names all of them: those that expect nothing get 1.
    """
    # Blocks of either side meet once, wherever a question has many of both.
    many = [max(1, rows.count() // BLOCK) for rows in (expected, found)]
    own = F.struct("phrase_no", F.col("embedding").cast("array<double>").alias("v"))
    ours = expected.groupBy("question_id", F.pmod(F.xxhash64("phrase_no"), F.lit(many[0])).alias("i")).agg(F.collect_list(own).alias("e"))
    theirs = found.groupBy("question_id", F.pmod(F.xxhash64("embedding"), F.lit(many[1])).alias("j")).agg(F.collect_list(F.col("embedding").cast("array<double>")).alias("f"))
    ours = ours.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many[1] - 1).cast("long"))))
    alike = ours.join(theirs, ["question_id", "j"], "left").withColumn("hit", _any_alike()(F.col("e.v"), "f"))
    each = alike.select("question_id", F.explode(F.arrays_zip(F.col("e.phrase_no").alias("phrase_no"), F.col("hit").alias("hit"))).alias("x"))
    best = each.groupBy("question_id", "x.phrase_no").agg(F.max("x.hit").alias("hit"))
    rows = best.groupBy("question_id").agg(F.avg(F.when(F.col("hit"), 1.0).otherwise(0.0)).alias("recall"))
    if questions is None:
        return rows
    return questions.select("question_id").join(rows, "question_id", "left").withColumn("recall", F.coalesce("recall", F.lit(1.0)))


#: How texts are likened: what stands for a text, and how two of those compare. An embedder and ``cosine`` may stand in its place.
Likeness = tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]
BY_WORDS: Likeness = (word_set, set_cosine)


def aligned(original: DataFrame, retrieved: DataFrame, keys: list[str], likeness: Likeness = BY_WORDS) -> DataFrame:
    """keys, document_id, sentence_index, mapped: the original sentence that each retrieved one is most like, if it is at all.

    retrieved has document_id and keys (a context's names beside it, such as query_id).
    """
    stands, like = likeness
    own = original.select("document_id", F.col("unit_pos").alias("place"), F.col("sentence_index").alias("mapped"), stands(F.col("text")).alias("own"))
    rows = retrieved.select("document_id", *keys, "unit_pos", "sentence_index", stands(F.col("text")).alias("v")).join(own, "document_id").withColumn("like", like(F.col("v"), F.col("own")))
    # Of equals, the earliest; a sentence of several units takes what its last one says.
    best = rows.groupBy("document_id", *keys, "unit_pos", "sentence_index").agg(F.max(F.struct("like", (-F.col("place")).alias("p"), "mapped")).alias("b"))
    best = best.where(F.col("b.like") >= ALIKE)
    return best.groupBy("document_id", *keys, "sentence_index").agg(F.max_by(F.col("b.mapped"), "unit_pos").alias("mapped"))


def _share(counted: DataFrame, contexts: DataFrame, hit: DataFrame, keys: list[str], whole: Column | None) -> DataFrame:
    """hit over n; null where a document has nothing to find, 1 for the whole document itself."""
    rows = contexts.join(counted, "document_id", "left").join(hit, ["document_id", *keys], "left")
    share = F.when(F.col("n").isNull(), None)
    if whole is not None:
        share = share.when(whole, 1.0)
    return rows.select("document_id", *keys, share.otherwise(F.coalesce("hit", F.lit(0)) / F.col("n")).alias("recall"))


def graph_recall(units: DataFrame, edges: DataFrame, contexts: DataFrame, found_units: DataFrame, found_edges: DataFrame, keys: list[str], likeness: Likeness = BY_WORDS, whole: Column | None = None) -> DataFrame:
    """document_id, keys, recall of each context: retrieved edges whose ends, mapped to original sentences, are an original edge either way, over original edges.

    found_units and found_edges are those of the contexts, ingested as documents
    of their own. Null for documents without edges; whole tells the contexts
    that are the document itself, of recall 1.
    """
    n = edges.groupBy("document_id").agg(F.count("*").alias("n"))
    to = aligned(units, found_units, keys, likeness)
    names = ["document_id", *keys]
    ends = found_edges.select(*names, "source_idx", "target_idx")
    for end in ("source", "target"):
        ends = ends.join(to.select(*names, F.col("sentence_index").alias(f"{end}_idx"), F.col("mapped").alias(end)), [*names, f"{end}_idx"])
    both = edges.select("document_id", F.col("source_idx").alias("source"), F.col("target_idx").alias("target"))
    both = both.union(both.select("document_id", "target", "source")).distinct()
    hit = ends.join(both, ["document_id", "source", "target"], "left_semi").groupBy(*names).agg(F.count("*").alias("hit"))
    return _share(n, contexts.select(*names), hit, keys, whole)


def step_pairs(units: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """document_id, keys, unit_pos, step_no, first, second: neighbouring steps of each workflow."""
    names = ["document_id", *(keys or []), "unit_pos"]
    steps = units.where("steps is not null").select(*names, F.posexplode("steps").alias("step_no", "first"))
    order = Window.partitionBy(*names).orderBy("step_no")
    return steps.withColumn("second", F.lead("first").over(order)).where("second is not null")


def dependency_recall(original: DataFrame, found: DataFrame, contexts: DataFrame, keys: list[str], likeness: Likeness = BY_WORDS, whole: Column | None = None) -> DataFrame:
    """document_id, keys, recall of each context: original step pairs of which both steps are like those of some retrieved pair, over all of them.

    Null for documents without step pairs; whole as for graph_recall.
    """
    n = original.groupBy("document_id").agg(F.count("*").alias("n"))
    names = ["document_id", *keys]
    stands, like = likeness
    theirs = found.select(*names, *[stands(strip(F.col(c))).alias(k) for c, k in (("first", "x"), ("second", "y"))])
    ours = original.select("document_id", "unit_pos", "step_no", *[stands(strip(F.col(c))).alias(k) for c, k in (("first", "a"), ("second", "b"))])
    rows = ours.join(theirs, "document_id").where((like(F.col("a"), F.col("x")) >= ALIKE) & (like(F.col("b"), F.col("y")) >= ALIKE))
    hit = rows.select(*names, "unit_pos", "step_no").distinct().groupBy(*names).agg(F.count("*").alias("hit"))
    return _share(n, contexts.select(*names), hit, keys, whole)


def category_metrics(rows: DataFrame) -> DataFrame:
    """The category's own metric takes the recall, the other three 1; general retention always takes it."""
    own = [F.when(F.col("category") == c, F.col("recall")).otherwise(1.0).alias(m) for c, m in METRICS.items()]
    return rows.select("*", *own, F.col("recall").alias("general_retention"))


def averages(rows: DataFrame, metrics: list[str]) -> DataFrame:
    return rows.groupBy("strategy").agg(*[F.round(F.coalesce(F.avg(m), F.lit(0.0)), 4).alias(m) for m in metrics])


def composite(row=None) -> Column:
    return sum((F.col(m) * (100 * w) for m, w in COMPOSITE.items()), F.lit(0.0))


def efficiency(score: Column, context_tokens: Column) -> Column:
    return score / F.greatest(context_tokens / RAW_TOKENS, F.lit(0.01))


def meaning_retention(answer: Column, question: Column, context: Column) -> Column:
    """0.7 if the answer stands in the context, and 0.3 times the share of the question's longer words that do."""
    low = F.lower(context)
    asked = F.filter(F.regexp_extract_all(F.lower(question), F.lit(r"(?U)\S+"), F.lit(0)), lambda w: F.length(w) > 3)
    share = F.when(F.size(asked) > 0, 0.3 * F.size(F.filter(asked, lambda w: F.contains(low, w))) / F.size(asked)).otherwise(0.0)
    return F.when(F.contains(low, F.lower(answer)), 0.7).otherwise(0.0) + share


def exact_match(a: Column, b: Column) -> Column:
    x, y = F.lower(normalize_text(a)), F.lower(normalize_text(b))
    return F.contains(x, y) | F.contains(y, x)


def unpivoted(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """strategy, metric, value in percent."""
    return rows.unpivot(["strategy"], metrics, "metric", "value").withColumn("value", F.col("value") * 100)


def display_name(strategy: Column) -> Column:
    """What follows the first underscore, with spaces for those that are left."""
    return F.replace(F.regexp_replace(strategy, "^[^_]*_", ""), F.lit("_"), F.lit(" "))


def percent(c: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", rounded(c.cast("double") * (100 * 10**digits), 0) / 10**digits)


def results_table(rows: DataFrame, plain: list[str], percents: list[str]) -> DataFrame:
    """name, the plain metrics as they are, the others as percentages."""
    return rows.select(display_name(F.col("strategy")).alias("name"), *plain, *[percent(F.col(m)).alias(m) for m in percents])


def markdown_report(rows: DataFrame, plain: list[str], percents: list[str], title: str = "Evaluation") -> DataFrame:
    """One row: a section with a table that has a line for each strategy, by name."""
    shown = results_table(rows.select("strategy", *[F.round(m, 2).alias(m) for m in plain], *percents), plain, percents)
    cells = [F.format_string("%.2f", F.col(m).cast("double")) for m in plain] + [F.col(m) for m in percents]
    line = F.concat(F.lit("| **"), F.col("name"), F.lit("** | "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = f"## {title}\n\n| Strategy | {' | '.join([*plain, *percents])} |\n|{'---|' * (len(plain) + len(percents) + 1)}\n"
    return shown.agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list(line)), "\n"), F.lit("\n")).alias("report"))


def with_section(report: Column, section: Column, title: str = "Evaluation") -> Column:
    """A report whose section of that title, and all that follows, is replaced."""
    before = strip(F.substring_index(report, f"## {title}", 1))
    return F.concat(before, F.lit("\n\n"), section)


#: Classes of highlighted tags by their prefix; others are generic.
TAG_CLASSES = {"DEC": "dec", "CON": "con", "REA": "rea", "REASON": "rea", "FACT": "fact", "FCT": "fact", "WRK": "wrk", "WRKFLOW": "wrk"}
TAG = r"\[([A-Z]+)-(\d+)\]"


def highlighted(text: Column) -> Column:
    """HTML of a text: its marks escaped, each tag in a span of its class, lines broken."""
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    for kind in sorted(set(TAG_CLASSES.values())):
        names = "|".join(k for k, v in TAG_CLASSES.items() if v == kind)
        text = F.regexp_replace(text, rf"\[((?:{names})-\d+)\]", f'<span class="tag-{kind}">\ue000$1\ue001</span>')
    text = F.regexp_replace(text, r"\[([A-Z]+-\d+)\]", '<span class="tag-generic">[$1]</span>')
    return F.replace(F.translate(text, "\ue000\ue001", "[]"), F.lit("\n"), F.lit("<br>"))


def tag_counts(docs: DataFrame) -> DataFrame:
    """document_id, tag, n: how often each tag prefix occurs."""
    tags = F.regexp_extract_all("text", F.lit(TAG), F.lit(1))
    return docs.select("document_id", F.explode(tags).alias("tag")).groupBy("document_id", "tag").agg(F.count("*").alias("n"))


def banner(reduced: DataFrame) -> DataFrame:
    """document_id, query_id, banner of what a reduction saved, for documents that have tokens at all."""
    def arrow(a: str, b: str) -> Column:
        return F.concat(F.format_number(a, 0), F.lit(" \u2192 "), F.format_number(b, 0))

    text = F.concat(
        F.lit("Tokens: "), arrow("original_estimated_tokens", "reduced_estimated_tokens"), F.lit(" | Sentences: "), F.concat_ws(" \u2192 ", F.col("original_sentences").cast("string"), F.col("reduced_sentences").cast("string")),
        F.lit(" | Reduction: "), percent(F.col("reduction_ratio"), 1),
    )
    return reduced.where("original_estimated_tokens > 0").select("document_id", "query_id", text.alias("banner"))


def token_f1(answer: Column, expected: Column) -> Column:
    """Harmonic mean of precision and recall of an answer's distinct words; 0 where none is shared."""
    def f1(a: Column, b: Column) -> Column:
        both = F.size(F.array_intersect(a, b))
        return F.when(both == 0, F.lit(0.0)).otherwise(2 * both / (F.size(a) + F.size(b)))

    return let(word_set(answer), lambda a: let(word_set(expected), lambda b: f1(a, b)))


def consistency(answers: DataFrame, likeness: Likeness = BY_WORDS) -> DataFrame:
    """question_id, consistency: mean likeness of the answers of neighbouring runs; 1 for a single one."""
    order = Window.partitionBy("question_id").orderBy("run")
    rows = answers.withColumn("v", likeness[0](F.col("answer")))
    rows = rows.withColumn("like", likeness[1](F.lag("v").over(order), F.col("v")))
    return rows.groupBy("question_id").agg(F.coalesce(F.avg("like"), F.lit(1.0)).alias("consistency"))
