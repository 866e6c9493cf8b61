"""Approximate nearest neighbours: a hierarchical k-means tree with best-bin-first search.

The tree is fitted on at most SAMPLE vectors; every vector is then placed in a
leaf. A query walks the tree through a priority queue of unvisited branches,
best first, and visits as many leaves as calibration needs for the wanted
recall: the number widens until sampled queries find enough of their true
neighbours. Leaves and their queries meet in blocks of bounded size.

Equal vectors are searched once. Of those with the same vector only the k + 1
of smallest id can be among the k nearest of any query, so the others need not
be candidates; all are placed and all may be queries.

Cases: vectors that are null, zero, of another length than most, or hold null
or non-finite components take no part. Rows that repeat a vec_id count once for
each distinct vector. Ties go to the smaller vec_id. With no vectors, or no
other ones, there are no neighbours. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Vectors to fit on, usual vectors in a leaf of those, branches of a node, and vectors or queries in a block.
SAMPLE, LEAF, BRANCHES, BLOCK = 20_000, 64, 8, 4096
#: Recall to reach in calibration and the sampled queries that measure it.
RECALL, PROBES = 0.97, 200


class Tree:
    """Nodes by number: a node's centre, and its children or its leaf's number."""

    def __init__(self, sample: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.centres: list[np.ndarray] = [sample.mean(0)]
        self.children: list[list[int]] = [[]]
        self.leaf: list[int] = [-1]
        self.n_leaves = 0
        todo = [(0, np.arange(len(sample)))]
        while todo:
            node, rows = todo.pop()
            parts = self._split(sample[rows], rng) if len(rows) > LEAF else None
            if parts is None:
                self.leaf[node] = self.n_leaves
                self.n_leaves += 1
                continue
            for c in np.unique(parts):
                own = rows[parts == c]
                self.children[node].append(len(self.centres))
                todo.append((len(self.centres), own))
                self.centres.append(sample[own].mean(0))
                self.children.append([])
                self.leaf.append(-1)
        self.centre = np.stack(self.centres)

    @staticmethod
    def _split(x: np.ndarray, rng) -> np.ndarray | None:
        centres = x[rng.choice(len(x), min(BRANCHES, len(x)), replace=False)].copy()
        parts = None
        for _ in range(8):
            gap = (centres**2).sum(1) - 2 * (x @ centres.T)
            new = gap.argmin(1)
            if parts is not None and (new == parts).all():
                break
            parts = new
            for c in range(len(centres)):
                if (own := parts == c).any():
                    centres[c] = x[own].mean(0)
        return parts if len(np.unique(parts)) > 1 else None

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: from the root, the child of nearest centre."""
        node = np.zeros(len(x), np.int64)
        out = np.full(len(x), -1, np.int64)
        active = np.arange(len(x))
        while len(active):
            rest = []
            for n in np.unique(node[active]).tolist():
                at = active[node[active] == n]
                if not self.children[n]:
                    out[at] = self.leaf[n]
                    continue
                kids = np.array(self.children[n])
                c = self.centre[kids]
                node[at] = kids[((c**2).sum(1) - 2 * (x[at] @ c.T)).argmin(1)]
                rest.append(at)
            active = np.concatenate(rest) if rest else active[:0]
        return out

    def visit(self, q: np.ndarray, n: int) -> list[int]:
        """The first n leaves of a best-bin-first walk: the branch of largest inner product with its centre comes next."""
        queue, found = [(0.0, 0)], []
        like = self.centre @ q
        while queue and len(found) < n:
            _, node = heapq.heappop(queue)
            while self.children[node]:
                best, *others = sorted(self.children[node], key=lambda c: -like[c])
                for c in others:
                    heapq.heappush(queue, (-like[c], c))
                node = best
            found.append(self.leaf[node])
        return found

    def calibrate(self, sample: np.ndarray, k: int, recall: float = RECALL, probes: int = PROBES, seed: int = 5) -> int:
        """Leaves to visit, widened by a quarter at a time until probes find the wanted share of their k nearest."""
        rng = np.random.default_rng(seed)
        leaf = self.place(sample)
        asked = rng.choice(len(sample), min(probes, len(sample)), replace=False)
        near, walk = [], []
        for i in asked:
            score = sample @ sample[i]
            score[i] = -np.inf
            near.append(leaf[np.argsort(-score, kind="stable")[: min(k, len(sample) - 1)]])
            walk.append({l: r for r, l in enumerate(self.visit(sample[i], self.n_leaves))})
        ranks = np.array([walk[i][l] for i, found in enumerate(near) for l in found.tolist()] or [0])
        n = 1
        while n < self.n_leaves and (ranks < n).mean() < recall:
            n = max(n + 1, n * 5 // 4)
        return min(n, self.n_leaves)


def valid_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["n"] if sizes else 0)).dropDuplicates(["vec_id", "v"])


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def search(vectors: DataFrame, is_query, k: int = 20, tree_seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: the k found of largest inner product for each row that is_query picks."""
    spark = vectors.sparkSession
    root = common.shared_dir(spark, "neighbours")
    rows = common.stored(valid_vectors(vectors), f"{root}/rows")
    # Members that can be among the k nearest: the k + 1 smallest ids of a vector.
    least = Window.partitionBy("v").orderBy("vec_id")
    members = rows.withColumn("rn", F.row_number().over(least)).where(F.col("rn") <= k + 1)
    uses = rows.groupBy("v").agg(F.count("*").alias("uses"))
    members = members.groupBy("v").agg(F.min("vec_id").alias("rep"), F.array_sort(F.collect_list("vec_id")).alias("ids")).join(uses, "v")
    members = common.stored(members, f"{root}/members")
    sample = members.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = _matrix(sample)
    tree = Tree(sample, tree_seed)
    n_visits = tree.calibrate(sample, k)
    # The tree has at most as many nodes as the sample has vectors.
    sent = spark.sparkContext.broadcast(tree)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = sent.value.place(_matrix(batch["v"])) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), batch["rep"], batch["v"]], ["leaf", "rep", "v"])

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaves = pa.array([sent.value.visit(q, n_visits) for q in _matrix(batch["v"])], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([leaves, batch["rep"], batch["v"]], ["leaves", "rep", "v"])

    bins = common.stored(members.select("rep", "v").mapInArrow(placed, "leaf long, rep long, v array<double>"), f"{root}/leaves")
    # A vector that is everywhere takes its representative from a broadcast.
    queries = common.hot_join(rows.where(is_query(F.col("vec_id"))), members.select("v", "rep", "uses"), ["v"], "uses", rows.count()).select(F.col("vec_id").alias("query_id"), "rep")
    queries = common.stored(queries, f"{root}/queries")
    asked = members.join(queries.select("rep").distinct(), "rep", "left_semi").select("rep", "v")
    walks = common.stored(asked.mapInArrow(walked, "leaves array<long>, rep long, v array<double>"), f"{root}/walks")
    walks = walks.select(F.explode("leaves").alias("leaf"), "rep", "v")
    # Blocks of a leaf's vectors and of its queries, from the counts of each leaf.
    def blocks(df):
        return df.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))

    counts = blocks(bins).withColumnRenamed("n", "mn").join(blocks(walks).withColumnRenamed("n", "qn"), "leaf")
    number = F.pmod(F.xxhash64("rep"), F.lit(1 << 30))
    m = bins.join(F.broadcast(counts), "leaf").withColumn("mb", F.pmod(number, F.col("mn")).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qn") - 1)))
    q = walks.join(F.broadcast(counts), "leaf").withColumn("qb", F.pmod(number, F.col("qn")).cast("int")).withColumn("mb", F.explode(F.sequence(F.lit(0), F.col("mn") - 1)))

    def meet(qs: pd.DataFrame, ms: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(ms):
            return pd.DataFrame({"rep": [], "found": [], "score": []}).astype({"rep": "int64", "found": "int64"})
        x, asked = np.stack(ms["v"].to_numpy()), np.stack(qs["v"].to_numpy())
        ids, reps, out = ms["rep"].to_numpy(), qs["rep"].to_numpy(), []
        keep = min(k + 1, len(ids))
        for a in range(0, len(asked), 256):
            some = asked[a : a + 256]
            rough = some @ x.T
            # A product of matrices may differ in its last bits: what comes that near to the last is measured anew.
            slack = 1e-9 * np.sqrt((some**2).sum(1) * (x**2).sum(1).max())
            least = np.partition(rough, len(ids) - keep, 1)[:, len(ids) - keep] - slack
            q, at = np.nonzero(rough >= least[:, None])
            score = (x[at] * some[q]).sum(1)
            order = np.lexsort((ids[at], -score, q))
            q, at, score = q[order], at[order], score[order]
            first = np.searchsorted(q, np.arange(len(some)))
            best = np.arange(len(q)) - first[q] < keep
            out.append(pd.DataFrame({"rep": reps[a + q[best]], "found": ids[at[best]], "score": score[best]}))
        return pd.concat(out)

    keys = ["leaf", "mb", "qb"]
    met = q.select(*keys, "rep", "v").groupBy(*keys).cogroup(m.select(*keys, "rep", "v").groupBy(*keys)).applyInPandas(meet, "rep long, found long, score double")
    order = Window.partitionBy("rep").orderBy(F.desc("score"), "found")
    best = met.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k + 1).select("rep", "found", "score")
    # Each found vector stands for its members; the query itself is none of its own neighbours.
    found = best.join(members.select(F.col("rep").alias("found"), "ids"), "found").join(queries, "rep")
    found = found.select("query_id", "score", F.explode("ids").alias("vec_id")).where("query_id <> vec_id").dropDuplicates(["query_id", "vec_id", "score"])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
