"""From sentences to typed units: workflows from lists, then a chain of extractors."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import LIST_ITEM, let, normalize_text, strip

# Weights of the unit types, and the weight of any other.
WEIGHTS = {
    "constraint": 1.0, "decision": 1.0, "reason": 1.0, "implementation": 1.0, "requirement": 1.0, "goal": 0.95,
    "workflow": 0.95, "task": 0.90, "outcome": 0.85, "comparison": 0.80, "question": 0.80, "fact": 0.70,
}
OTHER_WEIGHT = 0.5
# Tag prefixes, label names that stand for another type, and the substrings of each type in order.
TAGS = {"FACT": "fact", "DEC": "decision", "CON": "constraint", "TSK": "task", "WRK": "workflow", "REA": "reason", "STC": "state"}
LABELS = {"requirement": "constraint", "rule": "constraint", "future_action": "task", "action": "task", "open_question": "question", "reason": "fact"}
CUES = (
    ("decision", ("chose", "decided", "selected", "opted", "resolved")),
    ("goal", ("goal", "protect", "preserve", "mission", "purpose", "aim")),
    ("outcome", ("because", "resulted", "caused", "benefits", "outcome", "consequence")),
    ("constraint", ("must", "cannot", "required", "limited", "never")),
    ("comparison", ("compare", "vs", "versus", "better than", "faster", "lighter")),
    ("task", ("task", "implement", "benchmark", "create", "generate")),
)
TAG_PATTERN = r"^(?:-\s*)?\[([A-Z]+)-\d+\]\s*([^:]+):\s*(.*)"
LABEL_PATTERN = r"^(?:#+\s*)?([\p{L}\p{N}_\s-]+):\s*(.*)"
TAG_START = r"^(?:-\s*)?\[[A-Z]+-\d+\]"
RULE = r"^[-*=_\s]{3,}$"

UNIT = "struct<unit_type:string,subject:string,relation:string,object:string>"
Extractor = Callable[[Column], Column]


def unit(kind: Column, subject: Column, relation: Column, obj: Column) -> Column:
    return F.struct(kind.alias("unit_type"), subject.alias("subject"), relation.alias("relation"), obj.alias("object"))


def _mapped(pairs: dict[str, str], key: Column, default: Column) -> Column:
    """The value of the key, which is computed once."""
    def chain(own: Column) -> Column:
        out = default
        for k, v in pairs.items():
            out = F.when(own == k, F.lit(v)).otherwise(out)
        return out

    return let(key, chain) if pairs else default


def pattern_unit(pattern: str, types: dict[str, str] | None = None, default: str = "fact") -> Extractor:
    """An extractor from an expression (any case) with three groups, tag, title and value, or with two, label and value.

    A tag's type is looked up in ``types``; a label is its own type where that is known, and needs a value.
    """
    pattern = f"(?i){pattern}"
    three = re.compile(pattern.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9")).groups == 3

    def tagged(text: Column) -> Column:
        kind = _mapped(types or {}, F.upper(F.regexp_extract(text, pattern, 1)), F.lit(default))
        return F.when(text.rlike(pattern), unit(kind, strip(F.regexp_extract(text, pattern, 2)), F.lit(""), strip(F.regexp_extract(text, pattern, 3))))

    def labelled(text: Column) -> Column:
        label = F.lower(F.replace(normalize_text(F.regexp_extract(text, pattern, 1)), F.lit(" "), F.lit("_")))
        value = F.regexp_extract(text, pattern, 2)
        kind = let(label, lambda own: _mapped(LABELS, own, F.when(own.isin(*WEIGHTS), own).otherwise(F.lit("fact"))))
        return F.when(text.rlike(pattern) & (value != ""), unit(kind, F.lit(""), F.lit(""), value))

    return tagged if three else labelled


#: [TAG-n] title: value, and label: value.
tag_unit = pattern_unit(TAG_PATTERN, TAGS)
label_unit = pattern_unit(LABEL_PATTERN)


def cue_type(text: Column) -> Column:
    """The first type of which a cue is a substring."""
    def typed(low: Column) -> Column:
        out = F.when(low.endswith("?") | low.contains("open question"), "question").otherwise("fact")
        for kind, cues in reversed(CUES):
            out = F.when(low.rlike("|".join(cues)), kind).otherwise(out)
        return out

    return let(F.lower(text), typed)


def cue_unit(text: Column) -> Column:
    """Any sentence, typed by its cues, with itself as the object."""
    return unit(cue_type(text), F.lit(""), F.lit(""), text)


PARSE = "struct<subject:string,relation:string,object:string,purposes:array<struct<verb:string,object:string>>,causes:array<struct<subject:string,verb:string,clause:string>>>"


def parsed_units(parse: Callable[[Column], Column]) -> Extractor:
    """An extractor from a parser that a caller brings: a function of a column that gives a PARSE struct (a pandas UDF, say).

    The main unit has the sentence's subject, root and object (a fact of the
    sentence itself without any). Each purpose clause adds a goal, each cause an
    outcome, so a sentence may give several units.
    """

    def units_of(text: Column) -> Column:
        def typed(kind: str, subject: Column, relation: Column, obj: Column) -> Column:
            return unit(F.lit(kind), *[F.coalesce(c, F.lit("")) for c in (subject, relation, obj)])

        def all_of(p: Column) -> Column:
            some = F.concat_ws("", p["subject"], p["relation"], p["object"]) != ""
            main = F.when(some, unit(cue_type(text), *[F.coalesce(p[c], F.lit("")) for c in ("subject", "relation", "object")])).otherwise(unit(F.lit("fact"), F.lit(""), F.lit(""), text))
            none = F.array().cast(f"array<{UNIT}>")
            goals = F.transform(F.filter(p["purposes"], lambda x: (x["verb"] != "") & (x["object"] != "")), lambda x: typed("goal", p["subject"], x["verb"], x["object"]))
            outcomes = F.transform(F.filter(p["causes"], lambda x: x["subject"] != ""), lambda x: typed("outcome", x["subject"], x["verb"], x["clause"]))
            return F.concat(F.array(main), F.coalesce(goals, none), F.coalesce(outcomes, none))

        return let(parse(text), all_of)

    units_of.several = True
    return units_of


#: STRICT leaves sentences without tag or label untyped; LEXICAL types every sentence.
STRICT: tuple[Extractor, ...] = (tag_unit, label_unit)
LEXICAL: tuple[Extractor, ...] = (tag_unit, label_unit, cue_unit)


def _json_text(c: Column) -> Column:
    """A JSON string of printable ASCII: escapes for quotes, backslashes and control characters, code units for all else."""
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r"), ("\b", "\\b"), ("\f", "\\f")):
        c = F.replace(c, F.lit(raw), F.lit(escaped))

    def escape(ch: Column) -> Column:
        units = F.hex(F.encode(ch, "UTF-16BE"))
        four = F.concat(F.lit("\\u"), F.lower(F.substring(units, 1, 4)))
        return F.when((ch >= " ") & (ch <= "~"), ch).when(F.length(units) > 4, F.concat(four, F.lit("\\u"), F.lower(F.substring(units, 5, 4)))).otherwise(four)

    each = F.array_join(F.transform(F.filter(F.split(c, ""), lambda ch: ch != ""), escape), "")
    return F.concat(F.lit('"'), F.when(c.rlike("[^ -~]"), each).otherwise(c), F.lit('"'))


def rendered_workflow(name: Column, steps: Column) -> Column:
    """JSON of a workflow, indented by two."""
    listed = F.array_join(F.transform(steps, lambda s: F.concat(F.lit("    "), _json_text(s))), ",\n")
    return F.concat(F.lit('{\n  "type": "workflow",\n  "name": '), _json_text(name), F.lit(',\n  "steps": [\n'), listed, F.lit("\n  ]\n}"))


def decoded_workflow(rendered: Column) -> Column:
    """Type, name and steps of a rendered workflow; null where it is none."""
    return F.from_json(rendered, "type string, name string, steps array<string>")


def shortened_workflow(name: Column, steps: Column) -> Column:
    return F.format_string("[Workflow '%s' containing %d steps omitted for brevity]", name, F.size(steps))


def with_headers(sentences: DataFrame) -> DataFrame:
    """Adds context_header: the last first-level header; neighbouring ones are joined."""
    order = Window.partitionBy("document_id").orderBy("sentence_index")
    rows = sentences.withColumn("text", strip(F.col("text"))).withColumn("is_h1", F.col("text").startswith("# "))
    begins = F.col("is_h1") & ~F.coalesce(F.lag("is_h1").over(order), F.lit(False))
    rows = rows.withColumn("island", F.sum(begins.cast("int")).over(order))
    own = Window.partitionBy("document_id", "island").orderBy("sentence_index").rowsBetween(Window.unboundedPreceding, 0)
    clean = F.when(F.col("is_h1"), F.regexp_replace("text", r"^[# \t]+|[# \t]+$", ""))
    return rows.withColumn("context_header", F.array_join(F.collect_list(clean).over(own), " | ")).drop("island", "is_h1")


def units(sentences: DataFrame, extractors: Sequence[Extractor] = LEXICAL) -> DataFrame:
    """document_id, unit_pos, sentence_index, text, unit_type, subject, relation, object, context_header, render_text, steps, workflow_name.

    A run of list items and the sentence right before it, unless that is a rule, are one group; every other sentence is its own.
    """
    order = Window.partitionBy("document_id").orderBy("sentence_index")
    item = F.col("text").rlike(LIST_ITEM) & ~F.col("text").rlike(TAG_START)
    rows = with_headers(sentences).withColumn("item", item)
    starts = F.col("item") & ~F.coalesce(F.lag("item").over(order), F.lit(False))
    rows = rows.withColumn("run", F.sum(starts.cast("int")).over(order)).withColumn("leads", ~F.col("text").rlike(RULE) & F.coalesce(F.lead("item").over(order), F.lit(False)))
    rows = rows.withColumn("group", F.when(F.col("item"), F.col("run")).when(F.col("leads"), F.col("run") + 1).otherwise(-F.col("sentence_index") - 1))
    # Dealt by document already: groups are gathered without a shuffle.
    place = F.struct("sentence_index", "context_header", "text")
    rows = rows.groupBy("document_id", "group").agg(
        F.min(F.when(~F.col("item"), place)).alias("head"), F.min(F.when(F.col("item"), place)).alias("first"),
        F.array_sort(F.collect_list(F.when(F.col("item"), F.struct("sentence_index", "text")))).alias("items"),
    ).withColumn("listed", F.transform("items", lambda x: x["text"])).withColumn("own", F.coalesce("head", "first"))
    listed = F.size("listed") > 0
    name = F.when(listed & F.col("head").isNotNull(), strip(F.regexp_replace("head.text", ":+$", ""))).when(listed, F.lit("Unnamed Workflow"))
    steps = F.when(listed, F.col("listed"))
    text = F.when(listed, F.concat_ws("\n", "head.text", F.array_join("listed", "\n"))).otherwise(F.col("head.text"))
    rows = rows.select("document_id", "own.sentence_index", "own.context_header", name.alias("workflow_name"), steps.alias("steps"), text.alias("text"))
    none = F.lit("")
    # The first extractor that says anything; some say several things.
    found = [e(F.col("text")) if getattr(e, "several", False) else let(e(F.col("text")), lambda u: F.when(u.isNotNull(), F.array(u))) for e in extractors]
    typed = F.when(F.col("workflow_name").isNotNull(), F.array(unit(F.lit("workflow"), none, none, none))).otherwise(F.coalesce(*found))
    rows = rows.select("*", F.posexplode(typed).alias("part", "u"))
    render = F.when(F.col("workflow_name").isNotNull(), rendered_workflow(F.col("workflow_name"), F.col("steps"))).otherwise(F.col("text"))
    return rows.select(
        "document_id", (F.row_number().over(Window.partitionBy("document_id").orderBy("sentence_index", "part")) - 1).alias("unit_pos"), "sentence_index", "text", "u.unit_type", "u.subject", "u.relation", "u.object", "context_header",
        render.alias("render_text"), "steps", "workflow_name",
    )


def weight(kind: Column) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for k, v in WEIGHTS.items():
        out = F.when(kind == k, F.lit(v)).otherwise(out)
    return out
