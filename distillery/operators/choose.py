"""Choosing units for a question and building the context: greedy choice, expansion, assembly.

All of a document's units for one question lie in one array, in order; each
step is an expression over it, so nothing is shuffled after the units were
gathered by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import estimate_tokens, let, more_alike_than, strip, word_set

#: Similarity above which a unit repeats one that is already chosen.
REPEATS = 0.85


def top_units(scored: DataFrame, k: int) -> DataFrame:
    """The k units of highest score for each document and question; ties by position."""
    order = Window.partitionBy("document_id", "query_id").orderBy(F.desc("score"), "unit_pos")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def identity(u: Column) -> Column:
    """Units of the same type, subject, relation and object are the same, whatever their text."""
    return F.concat_ws("\x1f", u["unit_type"], F.lower(u["subject"]), F.lower(u["relation"]), F.lower(u["object"]))


def gathered(scored: DataFrame) -> DataFrame:
    """document_id, query_id, units: all units in order, with what the later steps need of each."""
    columns = F.struct(
        "unit_pos", "sentence_index", "score", "text", "render_text", "context_header", identity({c: F.col(c) for c in ("unit_type", "subject", "relation", "object")}).alias("same"),
        word_set(F.col("text")).alias("words"), estimate_tokens(F.col("render_text")).alias("tokens"),
    )
    return scored.groupBy("document_id", "query_id").agg(F.sort_array(F.collect_list(columns)).alias("units"))


def documents(units: DataFrame) -> DataFrame:
    """document_id, units: all units in order. What stands in a unit's text already is not gathered again."""
    def unless_text(c: str) -> Column:
        return F.when(F.col(c) != F.col("text"), F.col(c)).alias(c)

    columns = F.struct("unit_pos", "sentence_index", "text", unless_text("render_text"), "context_header", "unit_type", "subject", "relation", unless_text("object"))
    rows = units.groupBy("document_id").agg(F.sort_array(F.collect_list(columns)).alias("units"))

    def whole(u: Column) -> Column:
        render, subject, object_ = F.coalesce(u["render_text"], u["text"]), F.lower(u["subject"]), F.lower(F.coalesce(u["object"], u["text"]))
        own = {"unit_type": u["unit_type"], "subject": subject, "relation": u["relation"], "object": object_}
        return F.struct(
            u["unit_pos"].alias("unit_pos"), u["sentence_index"].alias("sentence_index"), u["text"].alias("text"), F.lower(u["text"]).alias("low"), render.alias("render_text"), u["context_header"].alias("context_header"), u["unit_type"].alias("unit_type"),
            subject.alias("subject"), object_.alias("object"), identity(own).alias("same"), word_set(u["text"]).alias("words"), estimate_tokens(render).alias("tokens"),
        )

    return rows.select("document_id", F.transform("units", whole).alias("units"))


def greedy(units: Column, max_sentences: int, max_tokens: int | None = None, min_tokens: int = 250) -> Column:
    """unit_pos of the chosen units, best first.

    Repeats are skipped. Choosing ends when there are enough sentences and the
    token floor is met; a unit beyond max_tokens ends it too.
    """
    ranked = F.sort_array(F.transform(units, lambda u: F.struct((-u["score"]).alias("minus"), u["unit_pos"].alias("pos"), u["words"].alias("words"), u["same"].alias("same"), u["tokens"].alias("tokens"))))
    none = F.array().cast("array<struct<pos:int,words:array<string>,same:string>>")
    start = F.struct(none.alias("chosen"), F.lit(0).alias("tokens"), F.lit(False).alias("done"))

    def step(acc: Column, u: Column) -> Column:
        repeat = F.exists(acc["chosen"], lambda s: (s["same"] == u["same"]) | more_alike_than(s["words"], u["words"], REPEATS))
        total = acc["tokens"] + u["tokens"]
        over = (total > max_tokens) if max_tokens else F.lit(False)
        chosen = F.concat(acc["chosen"], F.array(F.struct(u["pos"].alias("pos"), u["words"].alias("words"), u["same"].alias("same"))))
        enough = total >= min_tokens
        if max_tokens:
            enough = enough | (total >= max_tokens)
        taken = F.struct(chosen.alias("chosen"), total.alias("tokens"), ((F.size(chosen) >= max_sentences) & enough).alias("done"))
        stopped = F.struct(acc["chosen"].alias("chosen"), acc["tokens"].alias("tokens"), F.lit(True).alias("done"))
        return F.when(acc["done"], acc).when(repeat, acc).when(over, stopped).otherwise(taken)

    return F.aggregate(ranked, start, step, lambda acc: F.transform(acc["chosen"], lambda s: s["pos"]))


def among(units: Column, chosen: Column) -> Column:
    """The units at the chosen positions. An optimizer may put the expression for chosen in its place: it is computed once."""
    return let(chosen, lambda own: F.filter(units, lambda u: F.array_contains(own, u["unit_pos"])))


def adjacent(units: Column, chosen: Column, window: int) -> Column:
    """unit_pos of the chosen units and of those within window sentences that are the same as none kept so far."""
    def expanded(own: Column) -> Column:
        start = F.struct(F.transform(own, lambda u: u["unit_pos"]).alias("pos"), F.transform(own, lambda u: u["same"]).alias("same"))

        def step(acc: Column, u: Column) -> Column:
            near = F.exists(own, lambda o: F.abs(o["sentence_index"] - u["sentence_index"]) <= window)
            new = F.struct(F.concat(acc["pos"], F.array(u["unit_pos"])).alias("pos"), F.concat(acc["same"], F.array(u["same"])).alias("same"))
            return F.when(near, F.when(F.array_contains(acc["same"], u["same"]), acc).otherwise(new)).otherwise(acc)

        return F.aggregate(units, start, step, lambda acc: F.array_sort(acc["pos"]))

    slim = F.transform(among(units, chosen), lambda u: F.struct(u["unit_pos"].alias("unit_pos"), u["sentence_index"].alias("sentence_index"), u["same"].alias("same")))
    return let(slim, expanded)


def reasoned(units: Column, chosen: Column, edges: Column) -> Column:
    """unit_pos after two hops along the edges; of units that are the same, the first stays."""
    def hop(indices: Column) -> Column:
        return F.array_union(indices, F.transform(F.filter(edges, lambda e: F.array_contains(indices, e["source_idx"])), lambda e: e["target_idx"]))

    own = F.array_distinct(F.transform(among(units, chosen), lambda u: u["sentence_index"]))
    inside = let(let(let(own, hop), hop), lambda reached: F.filter(units, lambda u: F.array_contains(reached, u["sentence_index"])))
    start = F.struct(F.array().cast("array<int>").alias("pos"), F.array().cast("array<string>").alias("same"))

    def step(acc: Column, u: Column) -> Column:
        new = ~F.array_contains(acc["same"], u["same"])
        return F.when(new, F.struct(F.concat(acc["pos"], F.array(u["unit_pos"])).alias("pos"), F.concat(acc["same"], F.array(u["same"])).alias("same"))).otherwise(acc)

    return F.aggregate(inside, start, step, lambda acc: acc["pos"])


def assembled(units: Column, chosen: Column) -> Column:
    """The context: a sentence's first unit, in order, with its header in brackets where that changes."""
    own = F.sort_array(F.transform(among(units, chosen), lambda u: F.struct(u["sentence_index"].alias("i"), u["unit_pos"].alias("pos"), u["text"].alias("text"), u["render_text"].alias("render"), u["context_header"].alias("header"))))
    start = F.struct(F.lit(-1).alias("i"), F.lit("").alias("last"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, u: Column) -> Column:
        headed = (u["header"] != "") & ~u["text"].startswith("#") & (u["header"] != acc["last"])
        line = F.when(headed, F.concat(F.lit("["), u["header"], F.lit("]\n"), u["render"])).otherwise(u["render"])
        added = F.struct(u["i"].alias("i"), F.when(headed, u["header"]).otherwise(acc["last"]).alias("last"), F.concat(acc["out"], F.array(line)).alias("out"))
        return F.when(u["i"] == acc["i"], acc).otherwise(added)

    return strip(F.aggregate(own, start, step, lambda acc: F.array_join(acc["out"], "\n")))
