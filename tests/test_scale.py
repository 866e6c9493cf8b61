"""What failed on larger tables: each test fails on the code before."""

import math

import duckdb
from pyspark.sql import functions as F

from distillery import catalog
from distillery.operators import answers, baselines, choose, classify, evaluate, graphs, score, segment, whole
from distillery.plans import engine


def test_shares_are_rounded_as_in_sql(spark):
    """Contexts a little longer than their documents, and shares half-way between two roundings."""
    sized = [(2992, 2993), (2992, 2992), (160, 83), (160, 227), (40000, 40001), (1000, 10), (0, 0)]
    rows = spark.createDataFrame([(str(k), "q", "x" * b, a, 5, 7) for k, (a, b) in enumerate(sized)], "document_id string, query_id string, context string, original_chars int, original_sentences int, original_estimated_tokens int")
    rows = engine.sizes(rows.withColumn("kept", F.array(F.lit(1))).withColumn("selected", F.array(F.lit(1))))
    got = [(r.reduction_ratio, r.banner.rsplit(" ", 1)[1]) for r in rows.join(evaluate.banner(rows), ["document_id", "query_id"]).orderBy("document_id").collect()]
    ratio = "round(1 - b / greatest(a, 1), 4)"
    want = [duckdb.sql(f"SELECT {ratio}, printf('%.1f%%', round({ratio} * 1000) / 10) FROM (SELECT {a} AS a, {b} AS b)").fetchall()[0] for a, b in sized]
    assert [(repr(r), p) for r, p in got] == [(repr(r), p) for r, p in want]
    assert got[0][1] == "-0.0%"


def shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def plain_bm25(lines: list[str], query: str) -> dict[int, float]:
    words = [x.split() for x in lines]
    n, mean = len(words), sum(map(len, words)) / len(words)
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t in set(sum(words, [])) for d in [sum(t in w for w in words)]}
    floor = sum(raw.values()) / len(raw) * baselines.EPSILON
    idf = {t: floor if r < 0 else r for t, r in raw.items()}
    part = lambda t, w: idf[t] * w.count(t) * (baselines.K1 + 1) / (w.count(t) + baselines.K1 * (1 - baselines.B + baselines.B * len(w) / mean))
    return {k: round(sum(part(t, w) for t in query.split() if t in w), 9) for k, w in enumerate(words) if set(query.split()) & set(w)}


def test_keyword_scores_shuffle_lines_once(spark):
    """A word in most lines, one twice in a question, one line alone, words that no line has; and no shuffle but that of lines and of pairs."""
    texts = {"a": ["the river the town", "the town", "a mill the mill", "nothing here"], "b": ["the only line"]}
    asked = {"q": "the mill the river", "r": "absent mill"}
    lines = spark.createDataFrame([(d, k, x) for d, own in texts.items() for k, x in enumerate(own)], "document_id string, line_no int, line string")
    queries = spark.createDataFrame(list(asked.items()), "query_id string, query string")
    pairs = lines.select("document_id").distinct().crossJoin(queries.select("query_id"))
    want = {(d, q, k): s for d, own in texts.items() for q, x in asked.items() for k, s in plain_bm25(own, x).items()}
    for named in (None, pairs):
        got = {(r.document_id, r.query_id, r.line_no): round(r.score, 9) for r in baselines.bm25(lines, queries, named).collect()}
        assert got == want
    assert shuffles(baselines.bm25(lines, queries)) == 1
    top = {(r.document_id, r.query_id): [x.line_no for x in r.lines] for r in baselines.best_lines(baselines.scored_lines(lines, queries), 3, 6).collect()}
    assert top[("a", "r")] == [2, 0, 1] and top[("b", "r")] == [0]


def test_reduction_gathers_documents_once(spark):
    """Connectivity and edges in place are those of the tables, and a reduction shuffles no unit for each question."""
    texts = ["# A\nGoal: the mill\n- one\n- two\nDecision: the mill\nWe chose it because it requires water. The mill must never stop.\nReason: Speed\nTask: the mill\n" * k for k in (1, 2, 9)]
    memory = engine.ingest(spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "document_id string, text string"))
    units = memory.units.cache()
    rows = choose.documents(units)
    edges = rows.select("document_id", F.explode(graphs.edges_of(F.col("units"))).alias("e")).select("document_id", "e.*").distinct()
    assert sorted(edges.collect()) == sorted(graphs.reasoning_edges(units).collect()) and edges.count() > 100
    sizes = graphs.knowledge_edges(units).groupBy("document_id", "node").agg(F.count("*").alias("n"))
    own = units.select("document_id", "unit_pos", F.explode_outer(graphs._nodes()).alias("node")).join(sizes, ["document_id", "node"], "left")
    want = own.groupBy("document_id", "unit_pos").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    assert sorted(map(tuple, graphs.connectivity(units).collect())) == sorted(map(tuple, want.collect()))
    asked = spark.createDataFrame([("q", "Why the mill?"), ("r", "Which task?")], "query_id string, query string")
    assert shuffles(engine.reduce(spark.createDataFrame([(t,) for t in texts], "text string"), asked)) <= 3


def test_semantic_recall_compares_blocks(spark, monkeypatch):
    """One question with several blocks on both sides, vectors at the limit, zero and missing ones, and no row for each pair."""
    monkeypatch.setattr(evaluate, "BLOCK", 7, raising=False)
    expected = [(1, k, [1.0, k / 10.0]) for k in range(30)] + [(1, 30, [0.0, 0.0]), (1, 31, None), (2, 32, [1.0, 0.0]), (2, 33, [0.0, 1.0]), (3, 34, [1.0, 1.0])]
    found = [(1, [1.0, 0.0])] * 20 + [(1, [0.0, 0.0]), (2, [4.0, 3.0])]
    rows = evaluate.semantic_recall(spark.createDataFrame(expected, "question_id int, phrase_no int, embedding array<double>"), spark.createDataFrame(found, "question_id int, embedding array<double>"))
    like = lambda a, b: a and any(a) and any(b) and (a[0] * b[0] + a[1] * b[1]) / (math.sqrt(a[0] * a[0] + a[1] * a[1]) * math.sqrt(b[0] * b[0] + b[1] * b[1])) >= 0.8
    want = {q: sum(bool(any(like(v, f) for n, f in found if n == q)) for p, _, v in expected if p == q) / sum(p == q for p, _, _ in expected) for q in (1, 2, 3)}
    assert {r.question_id: r.recall for r in rows.collect()} == want
    assert "phrase_no" in rows.columns or "ArrowEvalPython" in rows._jdf.queryExecution().executedPlan().toString()


ODD = [
    "", "   ", ":", "A:\nB:\nC\nD:\n\nE:\n- one\n- two\n---\n- three\n1. four\nLast. Then more. and so", "# H\n# I #\nGoal:\u3000the mill\n# J\nReason : x\u2028y because it is. So",
    "Label:\u00a0\nvalue here\n\n[con-01] Limit : must never\n- [DEC-02] Why: we chose it\n-\tnot a tag\n\n\n12.\tstep\nOpen question: is it\u0130 v2.1?", "\u212aelvin: 5\r\nNext:\r\nline\u0085end. \u0085Then\u2003It's \u00dcber_wort 1\u00b2.\x1c",
    "Head:\n- \"a\" \\ \u00e9 \U0001f600\n- b\x7f\t.\n* c\n\nTask: the mill\nRequirement: the mill requires water. The mill must never stop.\nDecision: the mill\n[REA-01] Why: the mill\n" * 3,
    "\n\n".join(f"Line {k} tells of the river and town{k % 7} because SOC2 compares. Why the mill?" for k in range(40)),
]


def _by_expressions(docs):
    sentences = segment.sentences(docs)
    units = classify.units(sentences).cache()
    return engine.Memory(engine.document_meta(docs, sentences), units, graphs.knowledge_edges(units), graphs.reasoning_edges(units))


def _odd(spark):
    return spark.createDataFrame([(str(k), t) for k, t in enumerate(ODD)], "document_id string, text string")


def _asked(spark):
    return spark.createDataFrame([("q", "Why the mill and SOC2?"), ("r", "Which task of the workflow, v2.1?"), ("s", "town3 because")], "query_id string, query string")


def test_documents_in_their_rows_are_those_of_the_expressions(spark):
    """Units, sizes, edges, connectivity and reductions of odd texts, and no shuffle but that which finds the first text of an id."""
    docs, asked = _odd(spark), _asked(spark)
    memory, plain = engine.ingest(docs), _by_expressions(docs)
    assert sorted(map(repr, memory.units.collect())) == sorted(map(repr, plain.units.select(*memory.units.columns).collect()))
    for name in ("meta", "knowledge", "reasoning"):
        assert sorted(getattr(memory, name).collect()) == sorted(getattr(plain, name).collect())
    own = whole.units(docs).select("document_id", "unit_pos", "connectivity")
    assert sorted(own.collect()) == sorted(graphs.connectivity(plain.units).select(*own.columns).collect())
    for settings in (engine.Settings(), engine.Settings(2, 60, 0, 20), engine.Settings(6, None, 2, 0)):
        got = engine.retrieve(memory, asked, settings)
        assert shuffles(got) <= 1
        assert sorted(got.collect()) == sorted(engine.retrieve(plain, asked, settings).select(*got.columns).collect())


def test_run_reduces_once(spark):
    """One shuffle of texts, and answers as they are from contexts dealt out by line."""
    texts, asked = _odd(spark).select("text"), _asked(spark)
    rows = engine.run(texts, asked)
    assert shuffles(rows) <= 1 and set(rows.columns) == {"document_id", "query_id", "question", "reduced_context", "answer", "metadata"}
    nothing = spark.createDataFrame([], "document_id string, query_id string, line_no int, subject string")
    want = answers.extractive(engine.reduce(texts, asked), asked, nothing)
    assert sorted(rows.select("document_id", "query_id", "answer.answer").collect()) == sorted(want.collect())


def _recalled(spark, kind):
    """Recalls in place, and by all pairs of units from memories of the contexts."""
    docs, asked = _odd(spark), _asked(spark)
    plain = _by_expressions(docs)
    half = docs.select("document_id", F.lit("half").alias("query_id"), F.expr("substring(text, 1, cast(floor(length(text) / 2) as int))").alias("context"))
    contexts = engine.retrieve(plain, asked).select("document_id", "query_id", "context").union(half).union(docs.select("document_id", F.lit("whole"), "text"))
    again = _by_expressions(contexts.select(F.concat_ws("/", "document_id", "query_id").alias("document_id"), F.col("context").alias("text")))
    named = [x.withColumn("query_id", F.split("document_id", "/")[1]).withColumn("document_id", F.split("document_id", "/")[0]) for x in (again.units, again.reasoning)]
    whole_ = F.col("query_id") == "whole"
    if kind == "graph":
        want = evaluate.graph_recall(plain.units, plain.reasoning, contexts, *named, ["query_id"], whole=whole_)
    else:
        want = evaluate.dependency_recall(evaluate.step_pairs(plain.units), evaluate.step_pairs(named[0], ["query_id"]), contexts, ["query_id"], whole=whole_)
    got = engine.recalls(docs, asked, kind)
    assert shuffles(got) <= 1
    return [sorted((r.document_id, r.query_id, repr(r.recall)) for r in rows.collect()) for rows in (got, want)]


def test_graph_recall_in_place(spark):
    got, want = _recalled(spark, "graph")
    assert got == want and len({r for _, _, r in got}) > 3


def test_dependency_recall_in_place(spark):
    got, want = _recalled(spark, "dependency")
    assert got == want and {r for _, _, r in got} > {"None", "1.0"}


def test_dependency_recall_reduces_where_steps_can_come_back(spark, monkeypatch):
    """A text is reduced only if its contexts can have list items; where headers bring some, the recall is that of all contexts, measured one by one."""
    no_steps, steps = ["", " \n", "The mill. No list", "- one step\n\nThe mill", "- [CON-01] Limit: x\n- [CON-02] Limit: y"], "Head:\n- the mill\n- B\n- C\n\n"
    plain = [steps, f"# A\n\n{steps}Why the mill?\n\n- [CON-01] Limit: the mill", f"# A\n-b\n\n{steps}It is\n-5 or 1.5"]
    back = [f"# A\n-\n\n# B\n-\n\n# C\n\nWhy the mill?\n\n{steps}", f"# A\n*\n\n# B\n*\n\n# C\n\n{steps}Why the mill?"]
    asked, s = score.few(score.question_features(_asked(spark))), engine.Settings()
    monkeypatch.setattr(whole, "mapped", lambda rows, each, schema: each)
    each, reductions, reduced = whole.recalls(_odd(spark), asked, s, "dependency"), whole.reductions, []
    monkeypatch.setattr(whole, "reductions", lambda doc, *more: reduced.append(doc) or reductions(doc, *more))
    words = lambda x: frozenset(whole._words(x.lower()))
    like = lambda a, b: bool(a and b) and len(a & b) / math.sqrt(len(a) * len(b)) >= evaluate.ALIKE
    pairs = lambda text: [(words(a), words(b)) for u in whole.Document(text).units if u.steps for a, b in zip(u.steps, u.steps[1:])]
    for text in [*no_steps, *plain, *back, *ODD]:
        own = pairs(text)
        contexts = [*((q, c) for q, c, *_ in reductions(whole.Document(text), whole.Asked([r.asDict() for r in asked]), s)), ("half", text[: len(text) // 2])]
        want = [(q, sum(any(like(a, x) and like(b, y) for x, y in pairs(c)) for a, b in own) / len(own) if own else None) for q, c in contexts]
        before = len(reduced)
        got = list(each("d", text))
        assert got == [("d", *x) for x in want] + [("d", "whole", 1.0 if own else None)]
        assert text not in [*no_steps, *plain] or len(reduced) == before
        assert text not in back or (len(reduced) > before and got[0][2] == 0.5)


def test_likest_finds_what_all_pairs_find():
    """Sets at the limit among them, and equal and empty ones."""
    sets = [frozenset(f"w{(k * j) % 11}" for j in range(k % 9)) for k in range(200)] + [frozenset("abcde"), frozenset("abcd"), frozenset("abcdefghij"), frozenset("abcdefgh")]
    like = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b)) if a and b else 0.0
    found = whole.Likest(sets)
    for v in [*sets, frozenset("abcdefg"), frozenset("xyz"), *(frozenset("abcdefghijklmnop"[:n]) for n in range(16))]:
        score, k = max((like(v, b), -k) for k, b in enumerate(sets))
        assert found.best(v) == (-k if score >= evaluate.ALIKE else None)


def test_keyword_search_shuffles_no_lines(spark, sf):
    assert shuffles(catalog.bm25_topn(spark, sf)) == 0


def test_strategies_shuffle_texts_once(spark, sf):
    """To find the first text of an id; else digests and sizes alone."""
    assert shuffles(catalog._strategies(spark, sf)) <= 1


def test_strategies_are_compared_by_sizes(spark, sf):
    """Texts are dealt out once, to find the first of an id; the rest are two sizes that meet, and their means."""
    assert shuffles(catalog.strategy_compare(spark, sf)) <= 4


def test_hooked_scores_shuffle_nothing(spark, sf):
    assert shuffles(catalog.score_hooks(spark, sf)) == 0
