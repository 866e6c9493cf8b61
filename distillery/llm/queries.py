"""The contract queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, common, decontaminate, edits, neardup, neighbours, packing, pii, secrets, store, toxicity


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = common.shared_dir(spark, "op1")
    store.write(common.table(spark, sf_dir, "documents"), root, end_id=2)
    return store.read_digests(spark, root)


def op2_tree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(common.table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, k=20)


def op3_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_columns(pii.find(common.table(spark, sf_dir, "documents")))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.write_pieces(common.table(spark, sf_dir, "documents"), common.shared_dir(spark, "op4"), end_id=0)
    light = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(light).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_owned_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_columns(secrets.judge(common.table(spark, sf_dir, "documents")))


def op6_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = edits.build(common.table(spark, sf_dir, "documents"), common.shared_dir(spark, "op6"))
    return edits.report(edits.apply(edits.stated_edits(trees)))


def op7_setsketch_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(common.table(spark, sf_dir, "documents"))


def op8_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest_columns(decontaminate.find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    turns = common.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat.read_back(common.stored(chat.format_conversations(turns.unionByName(extra)), common.shared_dir(spark, "op9")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return toxicity.toxic_or_not(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_store": op1_token_store,
        "op2_tree_neighbours": op2_tree_neighbours,
        "op3_anchor_pii": op3_anchor_pii,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_owned_secrets": op5_owned_secrets,
        "op6_edit_aware_counts": op6_edit_aware_counts,
        "op7_setsketch_neardup": op7_setsketch_neardup,
        "op8_positional_decontamination": op8_positional_decontamination,
        "op9_chat_formatting": op9_chat_formatting,
        "op10_toxicity": op10_toxicity,
    }


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOW}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"

#: Every run of a document's words, as long as a window, against every window.
OP8_SQL = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, w[j : j + 12] AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS j FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS k FROM windows),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
ahead AS (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS l FROM each),
runs AS (SELECT doc_id, i, k, l[1:k] AS g FROM ahead, sizes WHERE len(l) >= k),
hits AS (SELECT doc_id, i, k, item_id FROM runs JOIN windows USING (g)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
asked AS (SELECT item_id, len(w) + {decontaminate.SLACK} AS l, (len(list_distinct(w)) * {decontaminate.NEAR} + 99) // 100 AS need, unnest(list_distinct(w)) AS word FROM items WHERE len(list_distinct(w)) >= {decontaminate.LEAST_NEAR}),
held AS (SELECT doc_id, item_id, need, count(DISTINCT word) OVER (PARTITION BY doc_id, item_id ORDER BY i RANGE BETWEEN CURRENT ROW AND l - 1 FOLLOWING) AS n FROM each JOIN asked USING (word)),
close AS (SELECT doc_id, count(*) AS n_near, string_agg(item, ',' ORDER BY item) AS near FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM held WHERE n >= need) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
    CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, sha256(coalesce(near, '')) AS near_sha256
FROM docs LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN close USING (doc_id)"""


_T = chat.Template()


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_CONTROLS = "|".join(re.escape(m) for m in _T.controls)
_FOLLOWS = " OR ".join(f"(before = {_quoted(a)} AND role IN ({', '.join(map(_quoted, sorted(b)))}))" for a, b in _T.follows.items())
_LEARNED = ", ".join(map(_quoted, sorted(_T.learned)))


def _escaped(x: str) -> str:
    """Length of an escaped text: a character more for each backslash and each control string."""
    return f"(length(replace({x}, chr(92), chr(92) || chr(92))) + len(regexp_extract_all({x}, {_quoted(_CONTROLS)})))"


_MARKED = "CASE " + " ".join(f"WHEN role = {_quoted(r)} THEN {len(a) + len(b)}" for r, (a, b) in _T.marks.items()) + f" ELSE {sum(map(len, _T.other))} + {_escaped('role')} END"

#: Turns in the formatter's order, digests of what they say, and the formatted size by the template.
OP9_SQL = f"""
WITH turns AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, k, CASE WHEN k = 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(k)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM turns),
seen AS (SELECT *, lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY p) AS before FROM placed)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY p)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role IN ({_LEARNED})), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY p) FILTER (role IN ({_LEARNED})), '')) AS loss_sha256,
    CAST(sum({_MARKED} + {_escaped('text')}) AS BIGINT) AS formatted_chars,
    bool_and({_FOLLOWS}) AND arg_max(role, p) IN ({', '.join(map(_quoted, sorted(_T.accepting)))}) AS valid
FROM seen GROUP BY conv_id"""


def oracle_sql() -> dict[str, str]:
    return {"op8_positional_decontamination": OP8_SQL, "op9_chat_formatting": OP9_SQL}
