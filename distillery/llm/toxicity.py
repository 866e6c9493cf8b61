"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct lower-case words, hashed to 2**18 places. A
second-order factorization machine learns a weight for every place that occurs
in the labelled rows and a weight for each pair of them, as products of
factors; decay keeps the weights of places that tell nothing near 0.

Labels are learned from at most SAMPLE labelled rows (those of least hash), of
which none is held out. Everything else, scores above all, covers every row.

Cases: null and empty texts get the score of no terms. With no positive or no
negative label to learn from, every score is 0. Repeated rows score alike; a
doc_id that is labelled twice counts as toxic if either label is. Rows with a
null doc_id are scored and never learned from. Other columns are kept, also one
that is called ``score``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PLACES = 1 << 18
#: Labelled rows to learn from, factors a term.
SAMPLE, FACTORS = 20_000, 8
THRESHOLD = 0.7
_WORDS = re.compile(r"[^\W\d_]+")


def places(text: str) -> list[int]:
    """Distinct hashed places of a text's words."""
    return list({zlib.crc32(w.encode()) % PLACES for w in set(_WORDS.findall(text.lower()))})


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Machine:
    """w0 + sum of weights + half of (square of summed factors - summed squares)."""

    def __init__(self, chosen: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.chosen, self.w0, self.w, self.v = chosen, w0, w, v
        self.own = w - 0.5 * (v * v).sum(1)
        self.slot = {int(p): k for k, p in enumerate(chosen)}
        self.cache: dict[str, int] = {}

    def __getstate__(self):
        return self.chosen, self.w0, self.w, self.v

    def __setstate__(self, state):
        self.__init__(*state)

    def slots(self, text: str) -> list[int]:
        """Distinct chosen slots of a text's words; the worker remembers a bounded number of words."""
        out, cache = set(), self.cache
        for word in set(_WORDS.findall(text.lower())):
            k = cache.get(word)
            if k is None:
                if len(cache) > 200_000:
                    cache.clear()
                k = cache[word] = self.slot.get(zlib.crc32(word.encode()) % PLACES, -1)
            if k >= 0:
                out.add(k)
        return sorted(out)

    def logits(self, rows: list[list[int]]) -> np.ndarray:
        n = np.array([len(r) for r in rows])
        flat = np.array([k for r in rows for k in r], np.int64)
        doc = np.repeat(np.arange(len(rows)), n)
        out = np.bincount(doc, self.own[flat], len(rows)) + self.w0
        for f in range(self.v.shape[1]):
            out += 0.5 * np.bincount(doc, self.v[flat, f], len(rows)) ** 2
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits([self.slots(t) for t in texts]), -60, 60)))


def learn(flat: np.ndarray, count: np.ndarray, labels: np.ndarray, n_terms: int, epochs: int = 200, rate: float = 0.05, lasso: float = 3.5, decay: float = 0.05, spared: float = 0.1, seed: int = 7):
    """Full-batch Adam on the logistic loss; flat holds the slots of all rows, each below n_terms and used, and count the slots of each.

    Weights have an L1 penalty of lasso deviations of their gradient, factors an L2 penalty; both fall where a weight is larger than about spared.
    """
    rng, n = np.random.default_rng(seed), len(count)
    used = np.flatnonzero(count)
    starts = (np.cumsum(count) - count)[used]
    order = np.argsort(flat, kind="stable")
    doc = np.repeat(np.arange(n, dtype=np.int32), count)[order]
    heads = np.searchsorted(flat[order], np.arange(n_terms))
    del order

    def by_row(x: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        if len(used):
            out[used] = np.add.reduceat(x[flat], starts)
        return out

    def by_term(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x[doc], heads) if n_terms else np.zeros(0)

    base = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    p = {"w0": np.array([np.log(base / (1 - base))]), "w": np.zeros(n_terms), "v": rng.normal(0, 0.02, (FACTORS, n_terms))}
    m, s = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    # By chance alone a term's gradient has this deviation; a weight below some of them stays 0.
    least = lasso * np.sqrt(by_term(np.ones(n)) * base * (1 - base)) / n
    for t in range(1, epochs + 1):
        sums = np.stack([by_row(x) for x in p["v"]])
        z = p["w0"][0] + by_row(p["w"] - 0.5 * (p["v"] ** 2).sum(0)) + 0.5 * (sums**2).sum(0)
        err = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels) / n
        each = by_term(err)
        w = p["w"]
        g = {"w0": np.array([err.sum()]), "w": np.where(w != 0, each + least * np.sign(w) / (1 + np.abs(w) / spared), np.sign(each) * np.maximum(np.abs(each) - least, 0))}
        g["v"] = np.stack([by_term(err * x) for x in sums]) - each * p["v"] + decay * p["v"] / (1 + (p["v"] ** 2).sum(0) / spared)
        side = np.where(w != 0, np.sign(w), -np.sign(g["w"]))
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-9)
        p["w"] = np.where(np.sign(p["w"]) == side, p["w"], 0)
    return float(p["w0"][0]), p["w"], p["v"].T.copy()


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.give_back()
    for batch in common.slices(batches):
        rows = pa.array([places(t) for t in batch["text"].to_pylist()], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch["toxic"], rows], ["toxic", "places"])


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    # At most SAMPLE ids: bounded, so sent to every executor.
    rows = common.doc_texts(docs).join(F.broadcast(known), "doc_id").mapInArrow(_placed, "toxic int, places array<int>")
    path = common.shared_dir(spark, "toxicity")
    rows = common.stored(rows, path)
    total, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < toxic < total:
        return Machine(np.zeros(0, np.int64), -60.0, np.zeros(0), np.zeros((0, FACTORS)))
    # At most SAMPLE rows, each with its distinct places.
    found = rows.toArrow()
    common.drop_path(spark, path)
    lists = found["places"].combine_chunks()
    chosen, flat = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    w0, w, v = learn(flat.astype(np.int32), lists.value_lengths().to_numpy().astype(np.int64), found["toxic"].to_numpy().astype(float), len(chosen))
    return Machine(chosen, w0, w, v)


def score(docs: DataFrame, machine: Machine, column: str = "score") -> DataFrame:
    """The rows of docs, all columns, and a score; underscores are put after its name while docs has one of that name.

    The machine has at most PLACES weights and their factors.
    """
    while column.lower() in (c.lower() for c in docs.columns):
        column += "_"
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    rows, names = common.numbered(docs)
    text = next(c for c, name in names.items() if name.lower() == "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.give_back()
        for batch in common.slices(batches):
            texts = [t or "" for t in batch[text].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.scores(texts), pa.float64())], [*batch.schema.names, "score"])
        sent.value.cache.clear()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, score double").toDF(*docs.columns, column)


def fit(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of docs, all columns, that are not predicted to be toxic."""
    scored = score(docs, machine)
    return scored.where(F.col(f"`{scored.columns[-1]}`") < THRESHOLD).drop(scored.columns[-1])


def toxic_or_not(docs: DataFrame, machine: Machine) -> DataFrame:
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), machine)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
