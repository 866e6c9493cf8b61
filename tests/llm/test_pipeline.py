"""The pipeline's rows against plain versions of its stages."""

import zlib
from types import SimpleNamespace

import corpus_pipeline
import pyarrow as pa
from distillery.llm import neardup, packing, pii, tokens, toxicity
from test_operators import encoded, plain_groups, plain_hits
from pyspark.sql import functions as F
from tokenizers import Tokenizer


def test_rows(spark, sf):
    import numpy as np

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    machine = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {k: t for k, t in texts.items() if machine.scores([t or ""])[0] < toxicity.THRESHOLD}
    groups = plain_groups(texts)
    texts = {k: t for k, t in texts.items() if groups[k][1] == k}
    hits = plain_hits(texts, [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    # All items of this table have a window's length or more.
    texts = {k: pii.masked(t or "") for k, t in texts.items() if not hits[k][1]}
    tokenizer = Tokenizer.from_file(tokens.default_vocabulary())
    want = set()
    for k, t in texts.items():
        ids = encoded(tokenizer, t, 0)
        for n, start in enumerate(range(0, len(ids), packing.CAPACITY)):
            part = ids[start : start + packing.CAPACITY]
            want.add((k, n, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
        assert stage(spark, docs.limit(0), sf).columns == docs.columns


def test_stages_on_odd_rows(spark, sf):
    """Null texts and ids, repeated rows and ids, a long text, and columns of the names that operators use."""
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    texts = [None, "", "one two three four five six", "one two three four five six", "mail me@example.com", "x " * 200_000 + item, "y " * 100_000]
    rows = [(k, t, "en", "s", len(t or ""), 0.25, 7, b"r") for k, t in [*enumerate(texts), (2, "another text of id two"), (None, "no id"), (None, "no id")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, uid int, registers binary").withColumn("kept_id", F.lit(1)).withColumn("bad_id", F.lit(2))
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        counts[name] = sorted(r.doc_id if r.doc_id is not None else -1 for r in out.select("doc_id").collect())
        if name != "packing":
            assert out.columns == docs.columns and {r.score for r in out.collect()} == {0.25}
    assert counts["near_duplicates"] == [-1, 0, 1, 2, 2, 4, 5, 6]
    assert counts["decontamination"] == [-1, -1, 0, 1, 2, 2, 3, 4, 6] and counts["personal_data"] == sorted([-1, -1, 0, 1, 2, 2, 3, 4, 5, 6])
    assert set(counts["packing"]) == {-1, 0, 1, 2, 3, 4, 5, 6}


def test_stages_give_back_the_encoder():
    """Workers go from packing to the other stages, as those of a session that runs the pipeline again do; the encoder must not stay in them."""
    rows = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["one two three four five six", ""], "toxic": pa.array([0, 1], pa.int32()), "registers": [bytes(2 * neardup.REGISTERS)] * 2, "cid": [1, 2]})
    pairs = pa.RecordBatch.from_pydict({"a": [1], "b": [2], "t_a": ["a b c d e"], "t_b": ["a b c d e"], "n_a": [1], "n_b": [1], "r_a": [bytes(2 * neardup.REGISTERS)], "r_b": [bytes(2 * neardup.REGISTERS)]})
    redact = pii.redact(SimpleNamespace(mapInArrow=lambda run, schema: run, schema=None))
    path = tokens.default_vocabulary()
    before = [list(x) for x in tokens.encoder(path).encode([b"one two three four five six"])]
    for stage, batch in ((toxicity._placed, rows), (neardup._sketcher("text"), rows), (neardup._banded, rows), (neardup._likely(0.72), pairs), (neardup._confirmed(85), pairs), (neardup._counted, rows), (pii._finder, rows), (redact, rows)):
        tokens.encoder(path)
        assert tokens._ENCODERS
        assert list(stage(iter([batch])))
        assert not tokens._ENCODERS
    assert [list(x) for x in tokens.encoder(path).encode([b"one two three four five six"])] == before
