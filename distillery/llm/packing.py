"""Best-fit packing by exact complements over a histogram of piece lengths.

Lengths are at most the capacity, so the histogram and the plan made from it
are bounded however many pieces there are. Sums of one, two and three available
lengths are indexed. The plan takes the longest length, looks its gap up there
for a combination that exactly fills it and that the counts allow, and uses it
as often as they do; what has no exact complement is packed best-fit
decreasing. Pieces find their slot by their rank
within their length.

Cases: a null text is the empty one (a piece of the end id alone). Repeated
rows are pieces of their own. An empty table gives no pieces. Rows with a null
doc_id are packed too. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, tokens

CAPACITY = 2048
PIECES = "task int, local long, doc_id long, piece int, start long, length long, ids binary"


def _sums(available: int, other: int, limit: int) -> int:
    """Bit s is set if an available length and one of other add up to s. Bit n: there is a length n."""
    out, rest = 0, available
    while rest:
        low = rest & -rest
        out |= other << (low.bit_length() - 1)
        rest ^= low
    return out & ((1 << limit + 1) - 1)


class Complements:
    """Available lengths with their counts, and which sums one, two and three of them have."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.left, self.capacity = Counter(histogram), capacity
        self._index()

    def _index(self) -> None:
        self.one = sum(1 << k for k in self.left)
        self.two = _sums(self.one, self.one, self.capacity)
        self.three = _sums(self.one, self.two, self.capacity)

    def uses(self, lengths: tuple[int, ...]) -> int:
        """How often the counts allow this combination."""
        return min(self.left[k] // v for k, v in Counter(lengths).items())

    def fill(self, first: int) -> tuple[int, ...] | None:
        """The available length first with none, one, two or three others that fill the rest exactly; of two, the pair that can be used most."""
        gap, one = self.capacity - first, self.one
        if gap == 0:
            return (first,)
        if one >> gap & 1 and self.uses((first, gap)):
            return (first, gap)
        if self.two >> gap & 1 and (best := self._pair((first,), gap)):
            return best
        rest = one & ((1 << gap) - 1) if self.three >> gap & 1 else 0
        while rest:
            a = rest.bit_length() - 1
            rest ^= 1 << a
            if self.two >> gap - a & 1 and self.uses((first, a)) and (best := self._pair((first, a), gap - a)):
                return best
        return None

    def _pair(self, held: tuple[int, ...], gap: int) -> tuple[int, ...] | None:
        best, most = None, 0
        for a in range(gap // 2, 0, -1):
            if self.one >> a & 1 and self.one >> gap - a & 1 and (n := self.uses((*held, a, gap - a))) > most:
                best, most = (*held, a, gap - a), n
        return best

    def take(self, lengths: tuple[int, ...]) -> tuple[dict[int, int], int]:
        """Consumes a combination as often as the counts allow."""
        need, n = Counter(lengths), self.uses(lengths)
        for k, v in need.items():
            self.left[k] -= n * v
            if not self.left[k]:
                del self.left[k]
        if any(k not in self.left for k in need):
            self._index()
        return dict(need), n

    def drop(self, length: int) -> int:
        n = self.left.pop(length)
        self._index()
        return n


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(lengths in a bin with their counts, number of such bins)."""
    wanted = {k: int(v) for k, v in histogram.items() if v > 0}
    if any(not 0 < k <= capacity for k in wanted):
        raise ValueError("lengths must be from 1 to the capacity")
    index, bins = Complements(wanted, capacity), []
    residual: Counter = Counter()
    for length in sorted(wanted, reverse=True):
        while index.left[length]:
            found = index.fill(length)
            if found is None:
                residual[length] = index.drop(length)
                break
            bins.append(index.take(found))
    left, bits = residual, sum(1 << k for k in residual)
    while bits:
        spare, need, gap = left.copy(), Counter(), capacity
        while rest := sum(1 << k for k in spare if spare[k]) & ((1 << gap + 1) - 1):
            k = rest.bit_length() - 1
            n = min(spare[k], gap // k)
            need[k] += n
            spare[k] -= n
            gap -= n * k
        n = min(left[k] // v for k, v in need.items())
        for k, v in need.items():
            left[k] -= n * v
            if not left[k]:
                del left[k]
                bits ^= 1 << k
        bins.append((dict(need), n))
    return bins


def slots(bins: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By length, rows (first rank, first sequence, pieces of this length in a bin, first offset), ascending."""
    taken: Counter = Counter()
    rows: dict[int, list] = defaultdict(list)
    sequence = 0
    for need, n in bins:
        offset = 0
        for length, k in sorted(need.items(), reverse=True):
            rows[length].append((taken[length], sequence, k, offset))
            taken[length] += n * k
            offset += length * k
        sequence += n
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def _cutter(vocabulary: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary)
        end, task = np.array([end_id], encode.dtype), common.task_number()
        ranks: Counter = Counter()
        names = ["task", "local", "doc_id", "piece", "start", "length", "ids"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        rows: list[tuple] = []
        held = 0
        for batch in common.slices(batches):
            for doc_id, raw in encode.groups(batch["doc_id"].to_pylist(), common.utf8(batch["text"])):
                ids = np.concatenate([raw, end]).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((task, ranks[len(part)], doc_id, piece, start, len(part), part.tobytes()))
                    ranks[len(part)] += 1
                    held += part.nbytes
                if held > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def write_pieces(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Encodes and cuts every document, and stores the pieces with their ids (unsigned 32-bit, little-endian)."""
    run = _cutter(vocabulary or tokens.default_vocabulary(), end_id, capacity)
    return common.stored(common.doc_texts(docs).mapInArrow(run, PIECES), path)


def _placed(table, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for n in np.unique(length).tolist():
                at, rows = np.flatnonzero(length == n), table.value[n]
                row = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                bin_no, in_bin = np.divmod(rank[at] - row[:, 0], row[:, 2])
                sequence[at], offset[at] = row[:, 1] + bin_no, row[:, 3] + in_bin * n
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to stored pieces (task, local, length and any other columns)."""
    spark = pieces.sparkSession
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    # At most as many rows as the capacity reach the driver.
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # The plan has at most two patterns for each length, and a pattern at most 63 lengths: some MB whatever the input.
    table = spark.sparkContext.broadcast(slots(plan(histogram, capacity)))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = by_task.select("task", "length", earlier.alias("base"))
    names = [c for c in pieces.columns if c not in ("task", "local")]
    ranked = pieces.join(offsets, ["task", "length"]).select(*names, (F.col("base") + F.col("local")).alias("rank"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name in names)
    return ranked.mapInArrow(_placed(table, names), f"{kinds}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """One row a sequence: its ids in place. Needs pieces packed with their ids; a sequence is at most the capacity."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("length"))
    return parts.select("sequence_id", "length", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")).alias("ids"))
