"""Token-id output: a content-addressed store of token chunks.

A rolling hash over the ids cuts each document's stream into chunks; a chunk is
kept once under the digest of its bytes. Recipes list each document's chunk
digests in ascending doc_id order. A document's root is the Merkle root of its
digests and lengths, with its id; roots of documents are hashed by blocks,
blocks by segments of the file, and segments to one root of the corpus. What is
read back is verified on all levels: bytes against digests, recipes against
their roots, and those against the manifest.

Tables under ``root``: ``chunks`` (digest, n, data: one row for each distinct
chunk), ``recipes`` (seg, doc_id, uid, digests, lengths, n_tokens, root),
``manifest`` (level, seg, block, root; the corpus root has level -1).

Cases: a null text is the empty one, a document of the end id alone. Rows that
repeat a doc_id are documents of their own, next to one another. A null doc_id
comes first. A very long text is many chunks and one recipe. An empty table
gives an empty store. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, tokens

#: Window of the rolling hash, and the least, usual and largest ids in a chunk. The mask has log2(usual) bits.
ROLL, LEAST, USUAL, LARGEST = 16, 128, 512, 2048
#: Digests of chunks that a task has already emitted with their bytes; it does not emit those again.
SEEN = 200_000
#: Documents, then roots, under one node of the corpus manifest.
FAN_OUT = 1024
DIGEST = 16
#: What a task cuts: a row for each document, and one for each chunk that it has not emitted yet.
CUT = "uid long, doc_id long, digests array<binary>, lengths array<int>, n_tokens long, root binary, digest binary, n int, data binary"


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def gear(size: int) -> np.ndarray:
    """A fixed 64-bit value for each id."""
    with np.errstate(over="ignore"):
        x = np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def marked(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Ends of the runs of ROLL ids whose hash has its top bits zero."""
    h, width = table[ids], 1
    with np.errstate(over="ignore"):
        while width < ROLL:
            h[width:] = h[width:] + (h[:-width] << np.uint64(width))
            width *= 2
    return np.flatnonzero((h >> np.uint64(64 - USUAL.bit_length() + 1)) == 0) + 1


def limited(n: int, at: list[int]) -> list[int]:
    """Ends of the chunks of n ids: the marked places within the limits, and those that the limits make."""
    ends, start = [], 0
    for end in at:
        if end - start < LEAST:
            continue
        while end - start > LARGEST:
            start += LARGEST
            ends.append(start)
        if end - start >= LEAST:
            ends.append(end)
            start = end
    while n - start > LARGEST:
        start += LARGEST
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def cuts(ids: np.ndarray, table: np.ndarray) -> list[int]:
    """Ends of the chunks: where the hash of the last ROLL ids has its top bits zero, within the limits."""
    return limited(len(ids), marked(ids, table).tolist())


def merkle(leaves: list[bytes]) -> bytes:
    level = [digest(b"\0" + x) for x in leaves] or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + b"".join(level[k : k + 2])) for k in range(0, len(level), 2)]
    return level[0]


def _cutter(vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary)
        table = gear(max(len(encode.ends), end_id + 1))
        uid, seen = common.task_number() << 33, set()
        kinds = {
            "uid": pa.int64(), "doc_id": pa.int64(), "digests": pa.list_(pa.binary()), "lengths": pa.list_(pa.int32()), "n_tokens": pa.int64(), "root": pa.binary(),
            "digest": pa.binary(), "n": pa.int32(), "data": pa.binary(),
        }
        chunks: list[tuple] = []
        docs: list[tuple] = []
        held = 0

        def flush():
            """A row for each document, then one for each chunk."""
            n_docs, n_chunks = len(docs), len(chunks)
            columns = [[*c, *[None] * n_chunks] for c in zip(*docs, strict=True)] if docs else [[None] * n_chunks] * 6
            columns += [[*[None] * n_docs, *c] for c in zip(*chunks, strict=True)] if chunks else [[None] * n_docs] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))

        for batch in common.slices(batches):
            doc_ids, texts = batch["doc_id"].to_pylist(), common.utf8(batch["text"])
            for some in tokens.spans(texts):
                raw, bounds = encode.joined(texts[some])
                ids, bounds = np.insert(raw, bounds[1:], end_id), bounds + np.arange(len(bounds))
                # A hash over another document's ids stands within LEAST of this one's beginning, where no chunk ends.
                at = marked(ids, table)
                of = np.searchsorted(at, bounds, "right").tolist()
                bounds = bounds.tolist()
                for k, doc_id in enumerate(doc_ids[some]):
                    base, n, start = bounds[k], bounds[k + 1] - bounds[k], 0
                    digests, lengths = [], []
                    for stop in limited(n, (at[of[k] : of[k + 1]] - base).tolist()):
                        data = ids[base + start : base + stop].tobytes()
                        key = digest(data)
                        digests.append(key)
                        lengths.append(stop - start)
                        if key not in seen:
                            chunks.append((key, stop - start, data))
                            held += len(data)
                            if len(seen) < SEEN:
                                seen.add(key)
                        start = stop
                    docs.append((uid, doc_id, digests, lengths, n, recipe_root(doc_id, digests, lengths)))
                    uid += 1
                    held += 16 * len(digests) + 64
                    if held > 8_000_000:
                        yield flush()
                        docs, chunks, held = [], [], 0
        if docs:
            yield flush()

    return run


def write(docs: DataFrame, root: str, vocabulary: str | None = None, end_id: int = 2) -> None:
    """Encodes every document and writes the store's tables under ``root``."""
    spark, vocabulary = docs.sparkSession, vocabulary or tokens.default_vocabulary()
    cut = common.stored(common.doc_texts(docs).mapInArrow(_cutter(vocabulary, end_id), CUT), f"{root}/cut")
    # A task has each chunk's bytes about once, and keeps one of them before anything is shuffled.
    whole = cut.where(F.col("data").isNotNull()).groupBy("digest").agg(F.first("n").alias("n"), F.first("data").alias("data"))
    whole.write.option("compression", "zstd").parquet(f"{root}/chunks")
    by_doc = cut.where(F.col("uid").isNotNull()).select("doc_id", "uid", "digests", "lengths", "n_tokens", "root")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = by_doc.repartitionByRange(n, "doc_id", "uid").sortWithinPartitions("doc_id", "uid")
    ranged.select(F.spark_partition_id().alias("seg"), "*").write.option("compression", "zstd").parquet(f"{root}/recipes")
    common.drop_path(spark, f"{root}/cut")
    level, k = nodes(_placed(spark.read.parquet(f"{root}/recipes")).select("seg", "pos", "root"), "pos", 0), 0
    while True:
        level.write.mode("append").parquet(f"{root}/manifest")
        done = spark.read.parquet(f"{root}/manifest").where(F.col("level") == k)
        if not done.where("block > 0").take(1):
            break
        k += 1
        level = nodes(done.select("seg", (F.col("block") + 1).alias("pos"), "root"), "pos", k)
    corpus_root(done.select("seg", "root")).write.mode("append").parquet(f"{root}/manifest")


def recipe_root(doc_id: int | None, digests: list[bytes], lengths: list[int]) -> bytes:
    leaves = [d + int(n).to_bytes(4, "little") for d, n in zip(digests, lengths, strict=True)] if len(digests) == len(lengths) else []
    return digest(b"\2" + (b"" if doc_id is None else int(doc_id).to_bytes(8, "little", signed=True)) + merkle(leaves))


def _roots(batch: pa.RecordBatch) -> pa.Array:
    return pa.array([recipe_root(*x) for x in zip(*(batch[c].to_pylist() for c in ("doc_id", "digests", "lengths")), strict=True)], pa.binary())


def _hashed(roots: Column) -> Column:
    return F.sha2(F.array_join(F.transform(roots, lambda x: F.hex(x["root"])), "").cast("binary"), 256).cast("binary")


def nodes(rows: DataFrame, place: str, level: int) -> DataFrame:
    """The manifest's nodes over rows (seg, place from 1, root): FAN_OUT neighbours of a segment each."""
    block = F.floor((F.col(place) - 1) / FAN_OUT)
    grouped = rows.groupBy("seg", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct(place, "root"))).alias("leaves"))
    return grouped.select(F.lit(level).alias("level"), "seg", "block", _hashed(F.col("leaves")).alias("root"))


def corpus_root(segments: DataFrame) -> DataFrame:
    """The node over the roots of all segments, as many as the file has partitions."""
    leaves = F.array_sort(F.collect_list(F.struct("seg", "root")))
    return segments.agg(leaves.alias("leaves")).select(F.lit(-1).alias("level"), F.lit(-1).alias("seg"), F.lit(-1).cast("long").alias("block"), _hashed(F.col("leaves")).alias("root"))


def _in_file():
    return Window.partitionBy("seg").orderBy("doc_id", "uid")


def _placed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("pos", F.row_number().over(_in_file()))


def recipes(spark: SparkSession, root: str, rows: DataFrame | None = None) -> DataFrame:
    """Recipes, or rows made of them, in the file's order: pos counts from 1 within a segment, start counts all ids before the document."""
    kept = spark.read.parquet(f"{root}/recipes")
    rows = kept if rows is None else rows
    # One row a segment: as many as the file has partitions.
    totals = kept.groupBy("seg").agg(F.sum("n_tokens").alias("in_seg"))
    before = totals.select("seg", (F.sum("in_seg").over(Window.orderBy("seg")) - F.col("in_seg")).alias("before"))
    rows = _placed(rows).withColumn("within", F.sum("n_tokens").over(_in_file()) - F.col("n_tokens"))
    return rows.join(before, "seg").withColumn("start", F.col("before") + F.col("within")).drop("before", "within")


#: x**(8 * 2**b) modulo the CRC-32 polynomial, as four tables of 256 for each b.
_SHIFTS: list[np.ndarray] = []


def shift_crc(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """CRC-32 values as if so many bytes followed; the CRC of a whole is the xor of its parts' shifted ones."""
    if not _SHIFTS:
        byte = np.array([1 << i for i in range(32)], np.uint64)
        for _ in range(8):
            byte = np.where(byte & 1, (byte >> np.uint64(1)) ^ np.uint64(0xEDB88320), byte >> np.uint64(1))
        columns = byte
        for _ in range(48):
            tables = np.zeros((4, 256), np.uint64)
            for t in range(4):
                for bit in range(8):
                    tables[t] ^= np.where(np.arange(256) >> bit & 1, columns[8 * t + bit], np.uint64(0)).astype(np.uint64)
            _SHIFTS.append(tables)
            columns = _apply(tables, columns)
    out, n = crc.astype(np.uint64), n_bytes.astype(np.int64)
    for b in range(int(n.max()).bit_length() if len(n) else 0):
        at = np.flatnonzero(n >> b & 1)
        out[at] = _apply(_SHIFTS[b], out[at])
    return out


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16 & 255] ^ tables[3][x >> 24 & 255]


def _verified(dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, data = batch["digest"].to_pylist(), batch["data"].to_pylist()
            crc = [zlib.crc32(np.frombuffer(x, dtype).astype("<u4").tobytes()) for x in data]
            good = [digest(x) == k for k, x in zip(keys, data, strict=True)]
            size = [len(x) // np.dtype(dtype).itemsize for x in data]
            yield pa.RecordBatch.from_arrays([batch["digest"], pa.array(crc, pa.int64()), pa.array(size, pa.int32()), pa.array(good, pa.bool_())], ["digest", "crc", "size", "good"])

    return run


def _shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc, after = batch["crc"].to_numpy(zero_copy_only=False), batch["after"].to_numpy(zero_copy_only=False)
        moved = pa.array(shift_crc(crc, 4 * after).astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch["uid"], moved, batch["good"]], ["uid", "part", "good"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of each recipe, with its length and that of all that follows it."""
    for batch in batches:
        uids, digests, lengths = batch["uid"], batch["digests"], batch["lengths"]
        n = digests.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        size = lengths.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if not digests.value_lengths().equals(lengths.value_lengths()):
            # Lists that were changed: as many lengths as digests.
            size = np.concatenate([np.resize(np.array(x or [0], np.int64), k) for x, k in zip(lengths.to_pylist(), n.tolist(), strict=True)])
        end = np.cumsum(n)
        upto = np.concatenate([[0], np.cumsum(size)])
        after = np.repeat(upto[end], n) - upto[1:]
        yield pa.RecordBatch.from_arrays([uids.take(pa.array(np.repeat(np.arange(len(n)), n))), digests.flatten(), pa.array(size.astype(np.int32)), pa.array(after)], ["uid", "digest", "length", "after"])


_CHECKED = "seg int, doc_id long, uid long, n_tokens long, n_chunks long, said binary, found_root binary"


def _rooted_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch["digests"].value_lengths().fill_null(0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([batch["seg"], batch["doc_id"], batch["uid"], batch["n_tokens"], n, batch["root"], _roots(batch)], ["seg", "doc_id", "uid", "n_tokens", "n_chunks", "said", "found_root"])


def verified(spark: SparkSession, root: str) -> DataFrame:
    """Recipes in order, without their digests. sound: whether one is as written, and so are those of its block; whole_store: whether all are."""
    again = spark.read.parquet(f"{root}/recipes").select("seg", "doc_id", "uid", "n_tokens", "digests", "lengths", "root").mapInArrow(_rooted_again, _CHECKED)
    # Hashed and ordered once, and read by all that follows.
    rows = common.stored(recipes(spark, root, again), common.shared_dir(spark, "verified"))
    manifest = spark.read.parquet(f"{root}/manifest")
    found = nodes(rows.select("seg", "pos", F.col("found_root").alias("root")), "pos", 0)
    said = manifest.where("level = 0").select("seg", "block", F.col("root").alias("node"))
    same = found.join(said, ["seg", "block"], "full").select("seg", "block", F.coalesce(F.col("root") == F.col("node"), F.lit(False)).alias("fits"))
    # The levels above are recomputed from the manifest's own first level.
    top, k = manifest.where("level = 0").select("seg", "block", "root"), 0
    while top.where("block > 0").take(1):
        k += 1
        top = nodes(top.select("seg", (F.col("block") + 1).alias("pos"), "root"), "pos", k).select("seg", "block", "root")
    last = manifest.where("level = -1").select(F.col("root").alias("kept_root"))
    upper = corpus_root(top.select("seg", "root")).join(last, F.lit(True), "left").agg(F.coalesce(F.bool_and(F.coalesce(F.col("root") == F.col("kept_root"), F.lit(False))), F.lit(False)).alias("upper"))
    # One row.
    whole = same.agg(F.coalesce(F.bool_and("fits"), F.lit(True)).alias("lower")).join(upper, F.lit(True)).select((F.col("lower") & F.col("upper")).alias("whole_store"))
    each = rows.withColumn("block", F.floor((F.col("pos") - 1) / FAN_OUT)).join(same, ["seg", "block"], "left")
    sound = F.coalesce((F.col("said") == F.col("found_root")) & F.col("fits"), F.lit(False))
    return each.select("doc_id", "uid", "start", "n_tokens", "n_chunks", sound.alias("sound")).join(F.broadcast(whole), F.lit(True))


def read_digests(spark: SparkSession, root: str, vocabulary: str | None = None) -> DataFrame:
    """Reads the store back: per document its place, length, CRC-32, whether it is intact, and whether the whole store is.

    Each chunk's bytes are read and checked against its digest once; documents
    combine their chunks' checksums, so no bytes move.
    """
    dtype = tokens.encoder(vocabulary or tokens.default_vocabulary()).dtype
    kept = spark.read.parquet(f"{root}/chunks").select("digest", "data").mapInArrow(_verified(dtype), "digest binary, crc long, size int, good boolean")
    parts = spark.read.parquet(f"{root}/recipes").select("uid", "digests", "lengths").mapInArrow(_listed, "uid long, digest binary, length int, after long").join(kept, "digest")
    parts = parts.withColumn("good", F.col("good") & (F.col("length") == F.col("size")))
    sums = parts.select("uid", "crc", "after", "good").mapInArrow(_shifted, "uid long, part long, good boolean").groupBy("uid").agg(
        F.bit_xor("part").alias("ids_crc32"), F.count("*").alias("found"), F.bool_and("good").alias("good")
    )
    whole = F.coalesce(F.col("good") & (F.col("found") == F.col("n_chunks")) & F.col("sound"), F.lit(False))
    rows = verified(spark, root).join(sums, "uid", "left")
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32", "n_chunks", whole.alias("intact"), F.coalesce("whole_store", F.lit(False)).alias("store_intact"))


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """doc_id and the bytes of its ids, rebuilt from the store."""
    kept = spark.read.parquet(f"{root}/chunks").select("digest", "data")
    parts = spark.read.parquet(f"{root}/recipes").select("uid", "doc_id", F.posexplode("digests").alias("k", "digest")).join(kept, "digest")
    whole = parts.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("k", "data"))).alias("parts"))
    joined = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["data"])), ""))
    return whole.select("doc_id", joined.alias("ids"))
