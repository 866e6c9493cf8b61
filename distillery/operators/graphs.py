"""Graphs over units: who shares an entity with whom, and what reasons from what."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import let
from .classify import WEIGHTS

# Which earlier types a type links back to, how far, and the causal markers.
LOOKS_BACK = {
    "reason": ("decision",), "decision": ("constraint", "requirement", "goal"),
    "implementation": ("decision", "reason", "goal"), "requirement": ("decision", "reason", "goal"), "task": ("decision", "reason", "goal"),
}
FARTHEST = 15
MARKERS = ("because", "due to", "causes", "results in", "enables", "requires", "depends on", "implements", "satisfies", "violates", "fulfills", "supports", "selected because", "chosen because")
NEAR_UNITS, NEAR_SENTENCES = 5, 2


def _nodes():
    return F.filter(F.array_distinct(F.array(F.lower("subject"), F.lower("object"))), lambda n: n != "")


def knowledge_edges(units: DataFrame) -> DataFrame:
    """document_id, node, sentence_idx; workflows name no nodes."""
    return units.where("unit_type <> 'workflow'").select("document_id", F.explode(_nodes()).alias("node"), F.col("sentence_index").alias("sentence_idx")).distinct()


def connectivity(units: DataFrame) -> DataFrame:
    """document_id, unit_pos, connectivity: sentences that share the unit's nodes, its own included."""
    own = F.struct("unit_pos", "sentence_index", "unit_type", F.lower("subject").alias("subject"), F.lower("object").alias("object"))
    rows = units.groupBy("document_id").agg(F.sort_array(F.collect_list(own)).alias("units"))
    rows = rows.select("document_id", F.explode(F.arrays_zip(F.transform("units", lambda u: u["unit_pos"]).alias("unit_pos"), connected(F.col("units")).alias("connectivity"))).alias("c"))
    return rows.select("document_id", "c.unit_pos", "c.connectivity")


def connected(units: Column) -> Column:
    """The connectivity of each unit of one document, in order; units have subject and object in lower case.

    Every unit gives two nodes, blank ones among them, which are sorted, counted in their runs and sorted back.
    """
    def nodes(u: Column, k: Column) -> Column:
        at = F.when(u["unit_type"] != "workflow", u["sentence_index"])
        second = F.when(u["subject"] == u["object"], F.lit("")).otherwise(u["object"])
        return F.array(*[F.struct(n.alias("node"), at.alias("at"), k.alias("k")) for n in (u["subject"], second)])

    def counted(own: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(own) - 1)
        begins = F.filter(places, lambda i: (i == 0) | (own[i]["node"] != own[F.greatest(i - 1, F.lit(0))]["node"]))

        def run(first: Column, end: Column) -> Column:
            inside = F.slice(own, first + 1, end - first)
            sentences = F.size(F.array_distinct(F.filter(F.transform(inside, lambda x: x["at"]), lambda at: at.isNotNull())))
            n = F.when(own[first]["node"] == "", 0).otherwise(sentences).cast("long")
            return let(n, lambda n: F.transform(inside, lambda x: F.struct(x["k"].alias("k"), n.alias("n"))))

        return let(begins, lambda b: F.flatten(F.transform(b, lambda first, j: run(first, F.coalesce(F.get(b, j + 1), F.size(own))))))

    every = F.sort_array(F.flatten(F.transform(units, nodes)))
    return let(F.sort_array(let(every, counted)), lambda c: F.transform(units, lambda u, k: c[2 * k]["n"] + c[2 * k + 1]["n"]))


def structural_edges(units: DataFrame) -> DataFrame:
    """Both directions of links to the last earlier unit of each type that a unit's type looks back to."""
    before = Window.partitionBy("document_id").orderBy("unit_pos").rowsBetween(Window.unboundedPreceding, -1)
    kinds = sorted({k for v in LOOKS_BACK.values() for k in v})
    last = {k: F.last(F.when(F.col("unit_type") == k, F.col("sentence_index")), ignorenulls=True).over(before) for k in kinds}
    rows = units.select("document_id", "unit_type", "sentence_index", *[c.alias(f"last_{k}") for k, c in last.items()])
    none = F.array().cast("array<int>")
    targets = none
    for kind, back in LOOKS_BACK.items():
        targets = F.when(F.col("unit_type") == kind, F.array(*[F.col(f"last_{k}") for k in back])).otherwise(targets)
    links = rows.select("document_id", F.col("sentence_index").alias("source_idx"), F.explode(targets).alias("target_idx"))
    links = links.where(F.abs(F.col("source_idx") - F.col("target_idx")) <= FARTHEST)
    return links.union(links.select("document_id", "target_idx", "source_idx")).distinct()


def lexical_edges(units: DataFrame) -> DataFrame:
    """Both directions of links from units with a causal marker to near ones; no join, a window of positions."""
    near = Window.partitionBy("document_id").orderBy("unit_pos").rowsBetween(-NEAR_UNITS, NEAR_UNITS)
    rows = units.withColumn("near", F.collect_list(F.struct("unit_pos", "sentence_index")).over(near))
    rows = rows.where(F.lower("text").rlike("|".join(MARKERS))).select("document_id", "unit_pos", F.col("sentence_index").alias("source_idx"), F.explode("near").alias("o"))
    links = rows.where((F.col("o.unit_pos") != F.col("unit_pos")) & (F.abs(F.col("o.sentence_index") - F.col("source_idx")) <= NEAR_SENTENCES))
    links = links.select("document_id", "source_idx", F.col("o.sentence_index").alias("target_idx"))
    return links.union(links.select("document_id", "target_idx", "source_idx")).distinct()


def reasoning_edges(units: DataFrame) -> DataFrame:
    """document_id, source_idx, target_idx, symmetric."""
    return structural_edges(units).union(lexical_edges(units)).distinct()


def edges_of(units: Column) -> Column:
    """The edges of one document's units, in order, as reasoning_edges has them, some more than once."""
    def edge(a: Column, b: Column) -> Column:
        return F.struct(a.alias("source_idx"), b.alias("target_idx"))

    # How many units a sentence has at most: those of FARTHEST sentences lie within so many places.
    start = F.struct(F.lit(-1).alias("at"), F.lit(0).alias("n"), F.lit(1).alias("most"))

    def count(acc: Column, u: Column) -> Column:
        n = F.when(acc["at"] == u["sentence_index"], acc["n"] + 1).otherwise(1)
        return F.struct(u["sentence_index"].alias("at"), n.alias("n"), F.greatest(acc["most"], n).alias("most"))

    most = F.aggregate(units, start, count, lambda acc: acc["most"])
    none = F.array().cast("array<int>")

    def targets(u: Column, k: Column, far: Column) -> Column:
        before = F.slice(units, F.greatest(k - far, F.lit(0)) + 1, F.least(k, far))

        def last(window: Column, kind: str) -> Column:
            return F.try_element_at(F.filter(window, lambda x: x["unit_type"] == kind), F.lit(-1))["sentence_index"]

        def lasts(back: tuple[str, ...], window: Column) -> Column:
            return F.array(*[last(window, b) for b in back])

        found = none
        for kind, back in LOOKS_BACK.items():
            found = F.when(u["unit_type"] == kind, let(before, functools.partial(lasts, back))).otherwise(found)
        found = F.filter(found, lambda t: F.abs(t - u["sentence_index"]) <= FARTHEST)
        near = F.slice(units, F.greatest(k - NEAR_UNITS, F.lit(0)) + 1, F.least(k, F.lit(NEAR_UNITS)) + NEAR_UNITS + 1)
        close = F.transform(F.filter(near, lambda x: (x["unit_pos"] != u["unit_pos"]) & (F.abs(x["sentence_index"] - u["sentence_index"]) <= NEAR_SENTENCES)), lambda x: x["sentence_index"])
        return F.concat(found, F.when(F.lower(u["text"]).rlike("|".join(MARKERS)), close).otherwise(none))

    def both(u: Column, k: Column, far: Column) -> Column:
        return F.flatten(F.transform(targets(u, k, far), lambda t: F.array(edge(u["sentence_index"], t), edge(t, u["sentence_index"]))))

    return let(most * FARTHEST + most, lambda far: F.flatten(F.transform(units, lambda u, k: both(u, k, far))))


def graph_nodes(units: DataFrame, edges: DataFrame) -> DataFrame:
    """Sentences at the end of an edge, with a label of at most 120 characters."""
    label = F.when(F.length("text") > 120, F.concat(F.substring("text", 1, 120), F.lit("..."))).otherwise(F.col("text"))
    ends = edges.select("document_id", F.explode(F.array("source_idx", "target_idx")).alias("sentence_index")).distinct()
    return units.join(ends, ["document_id", "sentence_index"], "left_semi").select("document_id", "sentence_index", "unit_type", label.alias("label"))


def graph_layout(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """document_id, sentence_index, layer, slot: a drawing in layers. A node's layer is its type's, in order of weight; its slot counts in the layer by place."""
    degree = edges.groupBy("document_id", F.col("source_idx").alias("sentence_index")).agg(F.count("*").alias("degree"))
    layer = F.lit(len(WEIGHTS))
    for k, kind in reversed(list(enumerate(sorted(WEIGHTS, key=lambda t: (-WEIGHTS[t], t))))):
        layer = F.when(F.col("unit_type") == kind, k).otherwise(layer)
    rows = nodes.groupBy("document_id", "sentence_index").agg(F.min(layer).alias("layer")).join(degree, ["document_id", "sentence_index"], "left")
    slot = F.row_number().over(Window.partitionBy("document_id", "layer").orderBy("sentence_index")) - 1
    return rows.select("document_id", "sentence_index", "layer", slot.alias("slot"), F.coalesce("degree", F.lit(0)).alias("degree"))
