"""Quirks of segmentation, units, graphs and choice, on rows made by hand."""

import json
import random

import pytest
from pyspark.sql import functions as F

from distillery.operators import answers, baselines, choose, classify, evaluate, graphs, score, segment
from distillery.plans import engine
from distillery.sources import tables
from distillery.streaming import ingest as ingest_module
from distillery.streaming.ingest import SCHEMA, ingest_stream


def docs(spark, *texts):
    return spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "document_id string, text string")


def said(spark, text):
    return [r.text for r in segment.sentences(docs(spark, text)).orderBy("sentence_index").collect()]


def typed(spark, text, extractors=classify.LEXICAL):
    rows = classify.units(segment.sentences(docs(spark, text)), extractors).orderBy("unit_pos").collect()
    return [(r.sentence_index, r.unit_type, r.subject, r.object) for r in rows]


def test_labels_merge_without_overlap(spark):
    lines = [r.line for r in segment.merged_lines(docs(spark, "A:\nB:\nc")).orderBy("pos").collect()]
    assert lines == ["A: B:", "c"]


@pytest.mark.parametrize("text, want", [
    ("A:\n\nb", ["A:", "b"]), ("A:\n- b", ["A:", "- b"]), ("a: b:\nc", ["a: b:\nc"]), ("", []), (" \n ", []),
    ("One. Two? three! Four.", ["One.", "Two? three!", "Four."]), ("- x. Y\nOne. Two", ["- x. Y", "One.", "Two"]),
])
def test_segmentation(spark, text, want):
    assert said(spark, text) == want


def test_workflows(spark):
    rows = classify.units(segment.sentences(docs(spark, "# Top\n\nDo:\n- a\n- b\n\n---\n1. c"))).orderBy("unit_pos").collect()
    assert [(r.unit_type, r.workflow_name, r.steps, r.context_header) for r in rows] == [
        ("fact", None, None, "Top"), ("workflow", "Do", ["- a", "- b"], "Top"), ("fact", None, None, "Top"), ("workflow", "Unnamed Workflow", ["1. c"], "Top"),
    ]


def test_headers_of_neighbours_join(spark):
    rows = classify.with_headers(segment.sentences(docs(spark, "# A\n\n# B\n\nx\n\n# C"))).orderBy("sentence_index").collect()
    assert [r.context_header for r in rows] == ["A", "A | B", "A | B", "C"]


@pytest.mark.parametrize("text, want", [
    ("[dec-1] T: v", ("decision", "T", "v")), ("- [STC-1] T: v", ("state", "T", "v")), ("[ZZ-1] T: v", ("fact", "T", "v")), ("Requirement: v", ("constraint", "", "v")),
    ("Reason: v", ("fact", "", "v")), ("Goal: v", ("goal", "", "v")), ("# ADR-7: Title", ("fact", "", "Title")), ("They claim it", ("goal", "", "They claim it")),
    ("We must because", ("outcome", "", "We must because")),
])
def test_types(spark, text, want):
    assert typed(spark, text)[0][1:] == want


def test_parsed_sentences_give_several_units(spark):
    """What a parser says: purposes are goals, causes outcomes; a sentence of which it says nothing is a fact."""
    def parse(text):
        said = F.struct(
            F.lit("the team").alias("subject"), F.lit("chose").alias("relation"), F.lit("rust").alias("object"), F.array(F.struct(F.lit("gain").alias("verb"), F.lit("speed").alias("object"))).alias("purposes"),
            F.array(F.struct(F.lit("go").alias("subject"), F.lit("was").alias("verb"), F.lit("go was slow").alias("clause"))).alias("causes"),
        ).cast(classify.PARSE)
        return F.when(text.startswith("The team"), said).otherwise(F.lit(None).cast(classify.PARSE))

    rows = typed(spark, "The team chose it.\n\nOther words.", (classify.tag_unit, classify.label_unit, classify.parsed_units(parse)))
    assert rows == [(0, "decision", "the team", "rust"), (0, "goal", "the team", "speed"), (0, "outcome", "go", "go was slow"), (1, "fact", "", "Other words.")]


def test_workflow_json_is_ascii_and_read_back(spark):
    steps = ["- a\x08b\x0c\"q\" \\ /", "- é 日本 👍 \u2028", "- \x00\x1f\x7f"]
    row = spark.createDataFrame([("n\u00e9", steps)], "name string, steps array<string>").select(classify.rendered_workflow(F.col("name"), F.col("steps")).alias("r"))
    text = row.first().r
    assert text == json.dumps({"type": "workflow", "name": "n\u00e9", "steps": steps}, indent=2).replace("\x7f", "\\u007f") and text.isascii()
    back = row.select(classify.decoded_workflow(F.col("r")).alias("w")).first().w
    assert (back.type, back.name, back.steps) == ("workflow", "n\u00e9", steps)


def test_long_lists_take_linear_time(spark):
    rows = classify.units(segment.sentences(docs(spark, "Do:\n" + "\n".join(f"- step {k}" for k in range(20_000))))).collect()
    assert len(rows) == 1 and len(rows[0].steps) == 20_000


def test_questions_without_pairs_are_few(spark):
    units = classify.units(segment.sentences(docs(spark, "One thing.")))
    many = score.question_features(spark.range(score.MOST_QUESTIONS + 1).select(F.col("id").cast("string").alias("query_id"), F.lit("what").alias("query")))
    with pytest.raises(ValueError):
        score.scored(units, many, graphs.connectivity(units))


def test_strict_leaves_plain_sentences_out(spark):
    assert typed(spark, "Plain text here.", classify.STRICT) == []


def test_edges_are_symmetric_and_look_back_fifteen(spark):
    text = "\n\n".join(["Decision: a"] + ["filler words"] * 14 + ["Task: b"])
    units = classify.units(segment.sentences(docs(spark, text)))
    assert {(r.source_idx, r.target_idx) for r in graphs.structural_edges(units).collect()} == {(0, 15), (15, 0)}
    far = classify.units(segment.sentences(docs(spark, "\n\n".join(["Decision: a"] + ["filler words"] * 15 + ["Task: b"]))))
    assert graphs.structural_edges(far).count() == 0


def chosen_by_hand(units, most, max_tokens, floor):
    """The greedy rule, plainly: units are (pos, score, words, same, tokens)."""
    kept, total = [], 0
    for pos, _, words, same, tokens in sorted(units, key=lambda u: (-u[1], u[0])):
        if any(same == k[1] or (words and k[2] and len(words & k[2]) / len(words | k[2]) > 0.85) for k in kept):
            continue
        if max_tokens and total + tokens > max_tokens:
            break
        kept.append((pos, same, words))
        total += tokens
        if len(kept) >= most and (total >= floor or (max_tokens and total >= max_tokens)):
            break
    return [k[0] for k in kept]


def test_greedy_choice(spark):
    rng = random.Random(3)
    schema = "id int, units array<struct<unit_pos:int,sentence_index:int,score:double,text:string,render_text:string,context_header:string,same:string,words:array<string>,tokens:int>>"
    rows, plain = [], {}
    for k in range(60):
        units = []
        for pos in range(rng.randint(0, 12)):
            words = sorted(set(rng.choices("abcdefgh", k=rng.randint(0, 8))))
            units.append((pos, pos, float(rng.randint(0, 4)), "", "", "", rng.choice("pqrstuvwxyz"), words, rng.randint(1, 90)))
        rows.append((k, units))
        plain[k] = [(u[0], u[2], set(u[7]), u[6], u[8]) for u in units]
    df = spark.createDataFrame(rows, schema)
    for most, tokens, floor in ((2, None, 0), (3, None, 100), (3, 150, 250), (1, 5, 0)):
        got = df.select("id", choose.greedy(F.col("units"), most, tokens, floor).alias("c")).collect()
        assert {r.id: r.c for r in got} == {k: chosen_by_hand(u, most, tokens, floor) for k, u in plain.items()}


def test_reduction_of_a_small_document(spark):
    text = "# Cache\n\nDecision: use Redis because it is fast\n\nThe weather is nice.\n\n[REA-01] Why: latency budget\n\nWhat about AGENT-INT-03?"
    memory = engine.ingest(docs(spark, text))
    asked = spark.createDataFrame([("q", "What is AGENT-INT-03?")], "query_id string, query string")
    row = engine.retrieve(memory, asked, engine.Settings(max_sentences=1, min_tokens=0, context_window=0)).collect()[0]
    assert "AGENT-INT-03" in row.context and row.selected_sentence_count == 1 and row.context.startswith("[Cache]")
    tight = engine.retrieve(memory, asked, engine.Settings(max_tokens=1)).collect()[0]
    assert (tight.context, tight.reduction_ratio) == ("", 1.0)


def test_ingest_keeps_what_is_known(spark, tmp_path):
    memory = engine.ingest(docs(spark, "One thing. Another thing.")).save(str(tmp_path / "m"))
    again = engine.ingest(docs(spark, "Other text", "New text"), known=memory.meta)
    assert [r.document_id for r in again.meta.collect()] == ["1"]


def test_settings_are_checked():
    with pytest.raises(ValueError):
        engine.Settings(max_sentences=0)
    assert engine.Settings.offered(context_window=3).max_sentences == 6
    for wrong in ({"max_sentences": 2}, {"context_window": 4}, {"min_tokens": 99}):
        with pytest.raises(ValueError):
            engine.Settings.offered(**wrong)


def test_a_batch_that_failed_is_written_again(spark, tmp_path, monkeypatch):
    path, real = str(tmp_path / "m"), graphs.reasoning_edges

    def fails(units):
        raise RuntimeError("lost")

    monkeypatch.setattr(graphs, "reasoning_edges", lambda units: real(units))
    memory = engine.ingest(docs(spark, "One thing. Another thing."))
    monkeypatch.setattr(graphs, "reasoning_edges", fails)
    with pytest.raises(RuntimeError):
        memory.save(path, "0")
    monkeypatch.setattr(graphs, "reasoning_edges", real)
    assert ingest_module._known(spark, path) is None
    memory.save(path, "0")
    engine.ingest(docs(spark, "One thing. Another thing.", "New."), known=ingest_module._known(spark, path)).save(path, "1")
    loaded = engine.Memory.load(spark, path)
    assert sorted((r.document_id, r.text) for r in loaded.units.collect()) == [("0", "Another thing."), ("0", "One thing."), ("1", "New.")]
    assert [r.document_id for r in loaded.of("1").meta.collect()] == ["1"]


def test_stream_ingests_each_document_once(spark, tmp_path):
    source = str(tmp_path / "in")
    for part in (docs(spark, "First text."), docs(spark, "Changed.", "Second text.")):
        part.write.mode("append").json(source)
        ingest_stream(spark.readStream.schema(SCHEMA).json(source), str(tmp_path / "m"), str(tmp_path / "c")).awaitTermination()
    units = engine.Memory.load(spark, str(tmp_path / "m")).units
    assert sorted(r.text for r in units.collect()) == ["First text.", "Second text."]


def test_why_answer_and_unknown(spark):
    contexts = spark.createDataFrame([("d", "q", "Redis was chosen because it is fast, and cheap.\nother"), ("e", "q", "")], "document_id string, query_id string, context string")
    asked = spark.createDataFrame([("q", "Why was Redis chosen?")], "query_id string, query string")
    assert {r.document_id: r.answer for r in answers.extractive(contexts, asked).collect()} == {"d": "it is fast", "e": answers.UNKNOWN}


def test_answers_from_parsed_lines(spark):
    contexts = spark.createDataFrame([("d", "who", "It rains.\nAnna wrote the parser."), ("d", "what", "It rains.\nAnna wrote the parser."), ("d", "where", "It rains.")], "document_id string, query_id string, context string")
    asked = spark.createDataFrame([("who", "Who wrote the parser?", "write"), ("what", "What was written?", "write"), ("where", "Where does it rain?", "rain")], "query_id string, query string, root string")
    parsed = spark.createDataFrame([("d", q, 1, ["write", "parser"], ["Anna"], "write", None, ["Anna"], "the parser") for q in ("who", "what")], "document_id string, query_id string, line_no int, terms array<string>, entities array<string>, root string, subject string, names array<string>, object string")
    assert {r.query_id: r.answer for r in answers.extractive(contexts, asked, parsed).collect()} == {"who": "Anna", "what": "the parser", "where": "It rains."}
    scores = {(r.query_id, r.line_no): r.score for r in answers.line_scores(answers.context_lines(contexts), asked, parsed).collect()}
    # A shared term and the same root; Anna is not in the question.
    assert scores["who", 1] == 1 + 3.0


def test_recall_of_nothing_and_of_everything(spark):
    memory = engine.ingest(docs(spark, "Plain words."))
    contexts = spark.createDataFrame([("0", "q", "Plain words.")], "document_id string, query_id string, context string")
    found = [df.withColumn("query_id", F.lit("q")) for df in (memory.units, memory.reasoning)]
    assert [r.recall for r in evaluate.graph_recall(memory.units, memory.reasoning, contexts, *found, ["query_id"]).collect()] == [None]
    pairs = evaluate.step_pairs(memory.units)
    assert [r.recall for r in evaluate.dependency_recall(pairs, pairs.withColumn("query_id", F.lit("q")), contexts, ["query_id"]).collect()] == [None]


def test_exact_match_with_an_empty_side(spark):
    row = spark.range(1).select(evaluate.exact_match(F.lit(""), F.lit("x")).alias("m")).first()
    assert row.m


def test_question_bank(spark, tmp_path):
    (tmp_path / "q.txt").write_text("Bank\n\n[Q-01] What?\n[Q-02] Why?\n")
    (tmp_path / "a.txt").write_text("Keys\n\n[Q-01] ANSWER KEY:\n  This\n  and that.\n\n[Q-02] ANSWER KEY:\n  So.\n")
    rows = tables.question_bank(spark, str(tmp_path / "q.txt"), str(tmp_path / "a.txt")).orderBy("question_id").collect()
    assert [(r.question, r.answer) for r in rows] == [("What?", "This and that."), ("Why?", "So.")]


def test_vector_top_is_capped_at_ten(spark):
    rows = spark.createDataFrame([("q", k, float(-k)) for k in range(20)], "query_id string, vec_id long, score double")
    assert baselines.top_vectors(rows, 15).count() == 10


def test_partitions_do_not_matter(spark):
    results = []
    for n in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        units = classify.units(segment.sentences(tables.structured_documents(spark, "/root/testdata/sf0.001")))
        results.append(sorted(map(str, units.select("document_id", "unit_pos", "unit_type", "text").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]
