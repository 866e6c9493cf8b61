"""Token counts that survive edits: a segment tree of pre-tokens per document.

A document's pre-tokens are cut at white space into leaves that encode alone,
and a segment tree sums their characters and tokens. Trees are stored with
their texts, so a document is encoded once. An edit finds its leaves by
descending the tree, re-encodes them with the boundary context that their words
need, and updates the sums above them; the rest is not encoded again. The edits
of many documents are encoded together, round by round.

Cases: a null text is the empty one, with no tokens. Edits apply one after
another to the text as it then is, and are clipped to it; a null or empty list
of edits changes nothing. Repeated rows, also of one doc_id, have trees of
their own. Texts of any length have as many leaves as they need. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, tokens

#: Least characters of a leaf: some ten pre-tokens.
LEAF = 64
#: White space at which every reader of the text agrees that a word ends.
_CUT = re.compile("[ \t\n\r]+")
EDITS = "array<struct<at:int,removed:int,inserted:string>>"
TREES = "doc_id long, text string, chars array<int>, tokens array<int>"


def cut(text: str) -> list[str]:
    """Leaves that end in white space, but perhaps for the last."""
    out, start = [], 0
    while start < len(text):
        m = _CUT.search(text, start + LEAF)
        end = m.end() if m else len(text)
        out.append(text[start:end])
        start = end
    return out or [""]


class CountTree:
    """Characters and tokens of a document's leaves, summed in a binary tree over their places."""

    def __init__(self, leaves: list[str], counts):
        self.leaves = leaves
        n = len(leaves)
        self.size = 1 << (n - 1).bit_length()
        self.chars, self.sums = np.zeros(2 * self.size, np.int64), np.zeros(2 * self.size, np.int64)
        self.chars[self.size : self.size + n] = [len(s) for s in leaves]
        self.sums[self.size : self.size + n] = counts
        for tree in (self.chars, self.sums):
            level = self.size
            while level > 1:
                half = level // 2
                tree[half:level] = tree[level : 2 * level : 2] + tree[level + 1 : 2 * level : 2]
                level = half
        self.encoded_chars = 0

    @classmethod
    def stored(cls, text: str, chars: list[int], counts: list[int]) -> CountTree:
        """The tree of a stored document, without encoding anything."""
        ends = np.cumsum(chars).tolist()
        return cls([text[e - n : e] for e, n in zip(ends, chars, strict=True)], counts)

    def total(self) -> int:
        return int(self.sums[1])

    def text(self) -> str:
        return "".join(self.leaves)

    def held(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of the leaves that are not empty."""
        a, b = self.size, self.size + len(self.leaves)
        full = self.chars[a:b] > 0
        # A text without characters has one leaf without any.
        return self.chars[a:b][full].tolist() or [0], self.sums[a:b][full].tolist() or [0]

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds this character, and how far into it the character is."""
        node = 1
        while node < self.size:
            node *= 2
            if at >= self.chars[node] and self.chars[node + 1]:
                at -= int(self.chars[node])
                node += 1
        return node - self.size, at

    def _put(self, place: int, text: str, count: int) -> None:
        self.leaves[place] = text
        node = place + self.size
        dc, dt = len(text) - int(self.chars[node]), count - int(self.sums[node])
        while node and (dc or dt):
            self.chars[node] += dc
            self.sums[node] += dt
            node //= 2

    def begin(self, at: int, removed: int, inserted: str) -> tuple[int, int, str]:
        """First and last leaf that an edit touches, with their context, and what is to be encoded in their place."""
        length = int(self.chars[1])
        at = min(max(at, 0), length)
        removed = min(max(removed, 0), length - at)
        first, inside = self._find(at)
        last, _ = self._find(at + removed)
        text = "".join(self.leaves[first : last + 1])
        text = text[:inside] + inserted + text[inside + removed :]
        # Context on the left: what precedes must end in white space. A leaf that was emptied is a place of no characters.
        before = first - 1
        while before >= 0 and not self.leaves[before]:
            before -= 1
        if before >= 0 and not _CUT.match(self.leaves[before][-1]):
            text, first = self.leaves[before] + text, before
        # Context on the right: words run on until this leaf ends in white space.
        while last + 1 < len(self.leaves) and (not text or not _CUT.match(text[-1])):
            last += 1
            text += self.leaves[last]
        return first, last, text

    def finish(self, first: int, last: int, text: str, count: int) -> None:
        self._put(first, text, count)
        self.encoded_chars += len(text)
        for place in range(first + 1, last + 1):
            if self.leaves[place]:
                self._put(place, "", 0)

    def edit(self, at: int, removed: int, inserted: str, counts) -> None:
        first, last, text = self.begin(at, removed, inserted)
        self.finish(first, last, text, counts([text])[0])


def counter(vocabulary: str):
    """Token counts of texts, by the cached encoder."""
    encode = tokens.encoder(vocabulary)
    return lambda texts: encode.counts([t.encode() for t in texts]).tolist()


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= tokens.GROUP_BYTES or k == len(texts) - 1:
            yield start, k + 1
            start, size = k + 1, 0


def build(docs: DataFrame, path: str, vocabulary: str | None = None) -> DataFrame:
    """Encodes every document once and stores its tree: doc_id, text, and characters and tokens of its leaves."""
    vocabulary = vocabulary or tokens.default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(vocabulary)
        for batch in common.slices(batches):
            texts = batch["text"].to_pylist()
            for a, b in _groups(texts):
                leaves = [cut(t) for t in texts[a:b]]
                flat = pa.array(counts([s for each in leaves for s in each]), pa.int32())
                chars = pa.array([len(s) for each in leaves for s in each], pa.int32())
                at = pa.array(np.cumsum([0] + [len(each) for each in leaves]), pa.int32())
                yield pa.RecordBatch.from_arrays([batch["doc_id"][a:b], batch["text"][a:b], pa.ListArray.from_arrays(at, chars), pa.ListArray.from_arrays(at, flat)], ["doc_id", "text", "chars", "tokens"])

    return common.stored(common.doc_texts(docs).mapInArrow(run, TREES), path)


def apply(trees: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """trees: stored ones with a column of edits. The trees after them, with n_tokens before and n_encoded, the characters that were encoded again.

    Its first columns are trees again, to store and edit further.
    """
    vocabulary = vocabulary or tokens.default_vocabulary()
    rows = trees.select("doc_id", "text", "chars", "tokens", F.col("edits").cast(EDITS).alias("edits"))
    kinds = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(vocabulary)
        for batch in common.slices(batches, 256):
            ids, texts, chars, tokens_, edits = (batch[c].to_pylist() for c in ("doc_id", "text", "chars", "tokens", "edits"))
            made = [CountTree.stored(*x) for x in zip(texts, chars, tokens_, strict=True)]
            before = [t.total() for t in made]
            for k in range(max((len(e or ()) for e in edits), default=0)):
                now = [(t, e[k]) for t, e in zip(made, edits, strict=True) if e and k < len(e) and e[k]]
                begun = [(t, *t.begin(e["at"] or 0, e["removed"] or 0, e["inserted"] or "")) for t, e in now]
                for (t, first, last, text), n in zip(begun, counts([x[3] for x in begun]), strict=True):
                    t.finish(first, last, text, n)
            held = [t.held() for t in made]
            columns = [ids, [t.text() for t in made], [h[0] for h in held], [h[1] for h in held], before, [t.encoded_chars for t in made]]
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, kinds, strict=True)], ["doc_id", "text", "chars", "tokens", "n_before", "n_encoded"])

    return rows.mapInArrow(run, f"{TREES}, n_before long, n_encoded long")


def total(counts: str) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)


def report(edited: DataFrame) -> DataFrame:
    """Per document: leaves and tokens, tokens before its edits, and characters in all and encoded again."""
    return edited.select(
        "doc_id", F.size("tokens").alias("n_segments"), F.col("n_before").alias("n_tokens"), total("tokens").alias("n_tokens_edited"),
        total("chars").alias("n_chars_edited"), F.col("n_encoded").alias("n_chars_encoded_again"),
    )


def stated_edits(trees: DataFrame) -> DataFrame:
    """Three edits of every text: a word inserted at a quarter, ten characters replaced in the middle, twenty removed at three quarters."""
    n = F.length("text")
    edits = F.array(
        F.struct(F.floor(n / 4).cast("int").alias("at"), F.lit(0).alias("removed"), F.lit(" amended ").alias("inserted")),
        F.struct(F.floor(n / 2).cast("int").alias("at"), F.lit(10).alias("removed"), F.lit("revised text").alias("inserted")),
        F.struct(F.floor(n * 3 / 4).cast("int").alias("at"), F.lit(20).alias("removed"), F.lit("").alias("inserted")),
    )
    return trees.withColumn("edits", edits)
