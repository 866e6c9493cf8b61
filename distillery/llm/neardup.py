"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct five-word shingles (the whole sequence where
there are fewer words). Each register of a sketch keeps the least of
exponentially distributed values, on a scale of powers of BASE and truncated to
16 bits; sketches merge by maximum. Documents of equal sets form a class and are
sketched once. Bands of registers propose classes that may be alike, a joint
likelihood of the registers and set sizes estimates their similarity, and the
full sets, compared by the words' bytes, decide: linked if
``100 * intersection >= 85 * union``.

In a band's bucket, members are first held against one leader, and confirmed
links join classes into components. A bucket whose members are then in one
component has nothing left to tell. Of two sets that are alike, one of the 15 %
rarest shingles of either is in both, whereas texts that fill one template
differ in them: classes of which no such shingle is in another component are
done. Those that are left are compared, bucket by bucket and in blocks, with
classes of other components, so that no link is lost to the choice of leader.

Cases: null, empty and blank texts have no set and are linked with nothing.
Rows of equal sets are linked, however many. Every row is known by a number of
its own, so rows that repeat a doc_id, or have none, are told apart. A null
doc_id never names a component while there is another. A text of any length is
one set. An empty table gives an empty result. ``groups`` does not read other
columns; ``distinct`` keeps them, whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import GOLDEN as _GOLD
from .words import MIX_1 as _M1
from .words import Words, mix

_U = np.uint64

#: Words in a shingle.
SHINGLE = 5
#: Bands and registers in a band: two sets of similarity 0.85 miss each other with a chance of 3e-7.
BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
#: Scale of the registers.
BASE, SHIFT = 1.001, 10_000.0
#: Bytes of text that are hashed at a time, and rows of a bucket in a block.
GROUP_BYTES, BLOCK = 1_000_000, 1024
#: Counters that approximate how often a shingle occurs, to tell rare ones: any order of them gives the same links.
COUNTERS = 1 << 18


@dataclass(frozen=True)
class Limits:
    """alike: the similarity that links, in hundredths.

    estimate and agree: estimated similarity and share of equal registers below
    which a pair of one bucket is not held set against set: five and almost six
    standard errors under 0.85, a loss of fewer than one pair in a million. At
    0, every pair of a bucket is.
    """

    alike: int = 85
    estimate: float = 0.72
    agree: float = 0.7


def shingles(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each UTF-8 text."""
    words = Words([t.lower() for t in texts])
    word, first = words.hashes(), words.first
    five = np.zeros(0, _U)
    if len(word) >= SHINGLE:
        five = word[: len(word) - SHINGLE + 1].copy()
        for k in range(1, SHINGLE):
            five = mix(five * _GOLD + word[k : len(word) - SHINGLE + 1 + k])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(five[a : b - SHINGLE + 1]))
        elif b > a:
            short = np.array([b - a], _U)
            for k in range(a, b):
                short = mix(short * _GOLD + word[k : k + 1])
            out.append(short)
        else:
            out.append(five[:0])
    return out


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """REGISTERS 16-bit registers for each set that is not empty (zeros for an empty one)."""
    n, m = len(sets), REGISTERS
    h = np.concatenate(sets) if n else np.zeros(0, _U)
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    least = np.full(n * m, np.inf)
    x, step = np.zeros(len(h)), 0
    while len(h):
        # The next value of each element's ascending sequence, in a register of its own choice.
        u = mix(h + _U((step * 0xA0761D6478BD642F + 0xE7037ED1A0B428DB) & (2**64 - 1)))
        x = x - np.log(((u >> _U(11)).astype(np.float64) + 1) * 2.0**-53)
        register = ((mix(u ^ _GOLD) >> _U(32)) * _U(m)) >> _U(32)
        np.minimum.at(least, doc * m + register.astype(np.int64), x)
        limit = least.reshape(n, m).max(1)
        go = x < limit[doc]
        h, doc, x, step = h[go], doc[go], x[go], step + 1
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(least / m) / np.log(BASE) + SHIFT)
    return np.where(np.isfinite(least), np.clip(k, 1, 65535), 0).astype("<u2").reshape(n, m)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity of greatest joint likelihood, given which registers are larger, equal or smaller, and the sizes."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.minimum(np.linspace(0.3, 1, 141)[None, :], np.minimum(u / v, v / u))

    def p(x):
        return -np.log1p(-np.clip(x, 0, None) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = np.maximum(p(u - v * j), 1e-9), np.maximum(p(v - u * j), 1e-9)
    fit = more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-9))
    return np.take_along_axis(j, fit.argmax(1)[:, None], 1)[:, 0]


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each sketch."""
    parts = registers.astype(_U).reshape(len(registers), BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=_U)[None, :] * _GOLD
    for r in range(ROWS):
        key = mix(key * _M1 + parts[:, :, r])
    return key.astype(np.int64)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two sums that do not depend on order: equal for equal sets."""
    return int(mix(s + _GOLD).sum(dtype=_U).astype(np.int64)), int(mix(s ^ _M1).sum(dtype=_U).astype(np.int64))


def by_band(rows: DataFrame, facts: DataFrame, total: int) -> DataFrame:
    """rows with the facts of their bucket, of total rows that hold whole buckets; hot buckets stay where they are."""
    hot = F.col("size") * common.HOT > total
    cold = rows.where(~hot).join(facts.where(~hot).drop("size"), "band")
    return cold.unionByName(rows.where(hot).join(F.broadcast(facts.where(hot).drop("size")), "band"))


def _groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t) + 1
        if size >= GROUP_BYTES or k == len(texts) - 1:
            yield start, k + 1
            start, size = k + 1, 0


def _sketcher(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.give_back()
        uid = common.task_number() << 33
        for batch in common.slices(batches):
            texts = [t or b"" for t in common.utf8(batch[text])]
            for a, b in _groups(texts):
                sets = shingles(texts[a:b])
                prints = [fingerprint(s) for s in sets]
                part = batch.slice(a, b - a)
                columns = [
                    pa.array(np.arange(uid, uid + b - a)), pa.array([len(s) for s in sets], pa.int64()), pa.array([p for p, _ in prints], pa.int64()), pa.array([p for _, p in prints], pa.int64()),
                    pa.array([r.tobytes() for r in sketch(sets)], pa.binary()),
                ]
                uid += b - a
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, "uid", "n", "k1", "k2", "registers"])

    return run


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.give_back()
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(_registers(batch["registers"]))
            cid = np.repeat(batch["cid"].to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(cid)], ["band", "cid"])


def _registers(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)


def _likely(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.give_back()
        for batch in batches:
            if batch.num_rows:
                n = [batch[c].to_numpy(zero_copy_only=False).astype(float) for c in ("n_a", "n_b")]
                good = estimate(_registers(batch["r_a"]), _registers(batch["r_b"]), *n) >= least
                yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


class WordIds:
    """A number for each word by its bytes, and for each shingle by its words' numbers."""

    def __init__(self):
        self.words: dict[bytes, int] = {}

    def shingles(self, text: bytes) -> set[tuple[int, ...]]:
        words = self.words
        ids = [words.setdefault(w, len(words)) for w in text.lower().split()]
        if len(ids) < SHINGLE:
            return {tuple(ids)} if ids else set()
        return set(zip(*(ids[k:] for k in range(SHINGLE)), strict=False))


def alike(a: set, b: set, limit: int = 85) -> bool:
    both = len(a & b)
    return 100 * both >= limit * (len(a) + len(b) - both)


def _confirmed(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of a, whose set is kept until the next one."""
        common.give_back()
        held = own = ids = None
        for batch in common.slices(batches, 64):
            good = []
            for a, x, y in zip(batch["a"].to_pylist(), common.utf8(batch["t_a"]), common.utf8(batch["t_b"]), strict=True):
                if held != a or len(ids.words) > 1_000_000:
                    held, ids = a, WordIds()
                    own = ids.shingles(x)
                good.append(alike(own, ids.shingles(y), limit))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of a task fall on each counter."""
    common.give_back()
    total = np.zeros(COUNTERS, np.int64)
    for batch in common.slices(batches):
        texts = common.utf8(batch["text"])
        for a, b in _groups(texts):
            total += np.bincount((np.concatenate(shingles(texts[a:b])) % _U(COUNTERS)).astype(np.int64), minlength=COUNTERS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["counter", "seen"])


def rarest(s: np.ndarray, seen: np.ndarray, limit: int) -> np.ndarray:
    """So many of a set's rarest shingles that a set that is alike has one of them among its own."""
    n = len(s) - math.ceil(limit * len(s) / 100) + 1
    return s[np.lexsort((s, seen[(s % _U(COUNTERS)).astype(np.int64)]))[:n]]


class Links:
    """Classes of equal sets, and the links between them. A class is known by the least number of its rows."""

    def __init__(self, docs: DataFrame, limits: Limits | None = None):
        self.spark, self.limits = docs.sparkSession, limits or Limits()
        self.root = common.shared_dir(docs.sparkSession, "neardup")
        rows, self.names = common.numbered(docs)
        own = {name.lower(): c for c, name in self.names.items()}
        self.doc_id, text = F.col(own["doc_id"]).cast("long"), own["text"]
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", uid long, n long, k1 long, k2 long, registers binary"
        self.rows = common.stored(rows.mapInArrow(_sketcher(text), schema), f"{self.root}/rows")
        sets = self.rows.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("uid").alias("cid"), F.min(self.doc_id).alias("name"), F.first("registers").alias("registers"))
        self.classes = common.stored(sets, f"{self.root}/classes")
        # Equal sets: any row's text will do.
        self.texts = self.rows.select(F.col("uid").alias("cid"), F.coalesce(text, F.lit("")).alias("text"))
        bands = self.classes.select("cid", "registers").mapInArrow(_banded, "band long, cid long")
        # Only buckets of two classes or more say anything.
        size = bands.groupBy("band").agg(F.min("cid").alias("leader"), F.count("*").alias("size")).where("size > 1")
        self.bands = common.stored(bands.join(size, "band"), f"{self.root}/bands")
        self.round = 0

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """Those of distinct pairs (a, b) of classes whose sets are alike: first by estimate, then on the full sets."""
        self.round += 1
        root = f"{self.root}/round{self.round}"
        c = self.classes
        a = c.select(F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("registers").alias("r_a"))
        b = c.select(F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("registers").alias("r_b"))
        size = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.limits.alike
        likely = pairs.join(a, "a").join(b, "b").where(size).mapInArrow(_likely(self.limits.estimate), "a long, b long")
        likely = common.stored(likely, f"{root}/likely")
        named = common.stored(likely.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), f"{root}/named")
        texts = common.stored(self.texts.join(common.few(named), "cid", "left_semi"), f"{root}/texts")
        full = likely.join(texts.select(F.col("cid").alias("b"), F.col("text").alias("t_b")), "b").join(texts.select(F.col("cid").alias("a"), F.col("text").alias("t_a")), "a")
        links = common.stored(full.mapInArrow(_confirmed(self.limits.alike), "a long, b long"), f"{root}/links")
        for name in ("likely", "named", "texts"):
            common.drop_path(self.spark, f"{root}/{name}")
        return links

    def components(self, links: DataFrame) -> DataFrame:
        """cid and component (its least cid) of every class that has a link: least labels, with pointer jumping."""
        both = links.union(links.select("b", "a")).toDF("cid", "other")
        labels, step = both.groupBy("cid").agg(F.min("other").alias("o")).select("cid", F.least("cid", "o").alias("component")), 0
        self.round += 1
        labels = common.stored(labels, f"{self.root}/labels{self.round}-0")
        while True:
            step += 1
            near = both.join(labels.withColumnRenamed("cid", "other"), "other").groupBy("cid").agg(F.min("component").alias("near"))
            jump = labels.select(F.col("cid").alias("component"), F.col("component").alias("far"))
            new = labels.join(near, "cid").join(jump, "component", "left")
            new = new.select("cid", F.least("component", "near", "far").alias("component"), (F.least("component", "near", "far") < F.col("component")).alias("moved"))
            new = common.stored(new, f"{self.root}/labels{self.round}-{step}")
            labels = new.select("cid", "component")
            if not new.where("moved").take(1):
                return labels

    def led(self) -> DataFrame:
        """Each class with the leader of each of its buckets."""
        return self.bands.where("leader <> cid").select(F.col("leader").alias("a"), F.col("cid").alias("b")).distinct()

    def unresolved(self, labels: DataFrame) -> DataFrame:
        """band, cid, component of buckets of three classes or more that are not in one component."""
        own = self.bands.where("size > 2").join(labels, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        own = common.stored(own.select("band", "cid", "leader", "size", "component"), f"{self.root}/own{self.round}")
        parts = own.groupBy("band", "size").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
        return by_band(own, parts.select("band", "size"), own.count())

    def led_anew(self, open_rows: DataFrame) -> DataFrame:
        """Members of unresolved buckets with another leader: each bucket draws its own, so a class meets as many as it has buckets."""
        draw = F.struct(F.xxhash64("cid", "band").alias("h"), F.col("cid").alias("a"), F.col("component").alias("ca"))
        leaders = open_rows.groupBy("band", "size").agg(F.min(draw).alias("l"))
        pairs = by_band(open_rows, leaders, open_rows.count()).where("component <> l.ca and leader <> l.a and leader <> cid")
        return pairs.select(F.least("cid", "l.a").alias("a"), F.greatest("cid", "l.a").alias("b")).distinct()

    def suspects(self, open_rows: DataFrame) -> DataFrame:
        """The classes of unresolved buckets of which one of the rarest shingles is in a class of another component; with component and text."""
        self.round += 1
        root, limit = f"{self.root}/round{self.round}", self.limits.alike
        named = common.stored(open_rows.select("cid", "component").distinct(), f"{root}/named")
        own = common.stored(self.texts.join(common.few(named), "cid"), f"{root}/texts")
        # COUNTERS rows at most reach the driver, whatever the input.
        seen = np.zeros(COUNTERS, np.int64)
        for r in own.select("text").mapInArrow(_counted, "counter int, seen long").groupBy("counter").agg(F.sum("seen").alias("seen")).toLocalIterator():
            seen[r["counter"]] = r["seen"]
        sent = self.spark.sparkContext.broadcast(seen)

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            common.give_back()
            for batch in common.slices(batches, 64):
                if not batch.num_rows:
                    continue
                keys = [rarest(s, sent.value, limit).astype(np.int64) for s in shingles(common.utf8(batch["text"]))]
                n = [len(k) for k in keys]
                cid, component = (np.repeat(batch[c].to_numpy(zero_copy_only=False), n) for c in ("cid", "component"))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(cid), pa.array(component)], ["shingle", "cid", "component"])

        keys = common.stored(own.mapInArrow(keyed, "shingle long, cid long, component long"), f"{root}/keys")
        shared = keys.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo < hi")
        met = common.hot_join(keys.select("shingle", "cid"), shared.select("shingle", "size"), ["shingle"], "size", keys.count()).select("cid").distinct()
        return common.stored(own.join(met, "cid"), f"{root}/suspects")

    def in_blocks(self, open_rows: DataFrame) -> DataFrame:
        """Links between different components, from pairs of blocks of each unresolved bucket's suspects.

        The largest component of a bucket is not held against itself. Pairs are
        compared within a task, the likeliest first, and only a link that joins
        two parts is returned.
        """
        suspects = self.suspects(open_rows)
        rows = common.stored(open_rows.select("band", "cid").join(suspects.select("cid", "component"), "cid"), f"{self.root}/suspected{self.round}")
        each = rows.groupBy("band", "component").agg(F.count("*").alias("n")).groupBy("band").agg(F.max_by("component", "n").alias("main"), F.max("n").alias("in_main"), F.sum("n").alias("size"))
        parts = each.where("size > in_main").select("band", "size", "main", F.ceil(F.col("in_main") / BLOCK).cast("int").alias("mains"), F.ceil((F.col("size") - F.col("in_main")) / BLOCK).cast("int").alias("others"))
        rows = common.hot_join(rows, parts, ["band"], "size", rows.count())
        hashed, main = F.xxhash64("cid"), F.col("component") == F.col("main")
        # Blocks of the main component count on from those of the others.
        rows = rows.withColumn("own", F.when(main, F.col("others") + F.pmod(hashed, F.col("mains"))).otherwise(F.pmod(hashed, F.col("others"))).cast("int"))
        met = F.sequence(F.lit(0), F.when(main, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1)
        rows = rows.withColumn("other", F.explode(met)).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
        rows = rows.join(self.classes.select("cid", "registers"), "cid").join(suspects.select("cid", "text"), "cid")
        return rows.select("band", "i", "j", "own", "cid", "component", "registers", "text").groupBy("band", "i", "j").applyInPandas(_linked(self.limits), "a long, b long").distinct()

    def resolve(self) -> DataFrame:
        """cid and component of every class that has a link."""
        links = self.confirm(self.led())
        labels = self.components(links)
        for search in (self.led_anew, self.in_blocks):
            open_rows = common.stored(self.unresolved(labels), f"{self.root}/open{self.round}")
            if not open_rows.take(1):
                break
            more = self.confirm(search(open_rows))
            if more.take(1):
                links = links.union(more)
                labels = self.components(links)
        labels = common.stored(labels, f"{self.root}/components")
        common.drop_others(self.spark, self.root, {"rows", "classes", "components"})
        return labels

    def assigned(self) -> DataFrame:
        """The rows, with their set's component (null without words) and the component's least doc_id."""
        own = self.classes.select("k1", "k2", "n", "cid", "name").join(self.resolve(), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        names = own.groupBy("component").agg(F.min("name").alias("component_id"))
        return self.rows.join(own.join(names, "component").select("k1", "k2", "n", "component", "component_id"), ["k1", "k2", "n"], "left")

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id, kept for every document."""
        name = F.when(F.col("component").isNull(), self.doc_id).otherwise(F.col("component_id"))
        rows = self.assigned().select(self.doc_id.alias("doc_id"), F.col("n").alias("n_shingles"), name.alias("component_id"))
        return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

    def kept(self) -> DataFrame:
        """All columns of the rows that stay: of each component the one of least doc_id (nulls last), and all without words."""
        order = F.struct(self.doc_id.isNull().alias("none"), self.doc_id.alias("doc_id"), "uid")
        first = self.assigned().select("uid", "component", order.alias("o")).groupBy(F.coalesce("component", -F.col("uid") - 1).alias("g")).agg(F.min("o").alias("o"))
        return self.rows.join(first.select(F.col("o.uid").alias("uid")), "uid", "left_semi").select(*[F.col(c).alias(name) for c, name in self.names.items()])


def _linked(limits: Limits):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        registers = np.frombuffer(b"".join(rows["registers"]), "<u2").reshape(-1, REGISTERS)
        cid, component, own = (rows[c].to_numpy() for c in ("cid", "component", "own"))
        crossing = rows["i"].iloc[0] != rows["j"].iloc[0]
        sets = shingles([t.encode() for t in rows["text"]])
        size = np.array([len(s) for s in sets])
        parent = {c: c for c in component.tolist()}

        def top(c):
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        pairs = []
        for k in range(len(cid) - 1):
            at = np.arange(k + 1, len(cid))
            fits = (component[at] != component[k]) & (100 * np.minimum(size[at], size[k]) >= limits.alike * np.maximum(size[at], size[k]))
            at = at[fits & (own[at] != own[k])] if crossing else at[fits]
            same = (registers[at] == registers[k]).sum(1)
            good = same >= limits.agree * REGISTERS
            pairs.append(np.stack([same[good], np.full(good.sum(), k), at[good]], 1))
        pairs = np.concatenate(pairs) if pairs else np.zeros((0, 3), np.int64)
        out = []
        for _, k, l in pairs[np.argsort(-pairs[:, 0], kind="stable")].tolist():
            x, y = top(component[k]), top(component[l])
            if x != y:
                both = len(np.intersect1d(sets[k], sets[l], assume_unique=True))
                if 100 * both >= limits.alike * (size[k] + size[l] - both):
                    parent[x] = y
                    out.append((min(cid[k], cid[l]), max(cid[k], cid[l])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def groups(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document of docs."""
    return Links(docs.select("doc_id", "text"), limits).result()


def distinct(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """The rows of docs, all columns, that stay: one document of each group, and every document without words."""
    return Links(docs, limits).kept()
