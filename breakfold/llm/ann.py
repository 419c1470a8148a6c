"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample, which grows with the table up to ``most_sample`` rows, and so do its leaves; every
row is dealt to the leaf that greedy descent finds.  Beyond that bound leaves no longer get more but larger.  A query visits leaves in best-bin-first order, from a priority queue of nodes by the
distance of their centres.  How many leaves it visits is calibrated: for a bounded number of
calibration queries the true neighbours among all rows are found block by block, and the
visits widen until the share of them that lies in visited leaves reaches the target.  A query goes on until its leaves
hold enough rows, however few they hold each.

Scoring is a join by leaf of queries and rows.  Leaves with many rows or many queries are cut
into blocks on both sides, so that no task gets an unbounded block, and each block gives a
query's k best only.
"""

from __future__ import annotations

from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, small_batches


@dataclass(frozen=True)
class Params:
    sample: int = 8192  # rows that the tree is fitted on, in the order of a hash of their id, or one row in ``share`` if these are more
    share: int = 64
    most_sample: int = 131_072
    branch: int = 8
    leaf_rows: int = 512  # rows aimed at in a leaf
    calibration: int = 128  # queries that the visits are calibrated on
    recall: float = 0.97  # aimed at on the calibration queries
    block: int = 4096  # rows or queries in a block
    seed: int = 3


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centres and each row's centre; fewer than k centres if there are fewer distinct rows."""
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    centres = distinct[rng.choice(len(distinct), k, replace=False)]
    at = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        at = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres, at


class Tree:
    """nodes: (centres, children); a child is ("leaf", number) or ("node", number)."""

    def __init__(self, x: np.ndarray, leaves: int, branch: int, seed: int):
        rng = np.random.default_rng(seed)
        self.nodes: list[tuple[np.ndarray, list]] = []
        self.n_leaves = 0
        self._grow(x, max(1.0, len(x) / max(1, leaves)), branch, rng, 0)

    def _grow(self, x: np.ndarray, rows: float, branch: int, rng, depth: int):
        if depth and (len(x) <= rows * 1.5 or depth > 12):
            self.n_leaves += 1
            return ("leaf", self.n_leaves - 1)
        own = len(self.nodes)
        self.nodes.append((x[:0], []))
        k = int(min(branch, max(1, np.ceil(len(x) / rows))))
        centres, at = kmeans(x, k, rng) if len(x) else (np.zeros((1, x.shape[1])), np.zeros(0, np.int64))
        if len(centres) == 1:  # equal rows
            children = [("leaf", self.n_leaves)]
            self.n_leaves += 1
        else:
            children = [self._grow(x[at == c], rows, branch, rng, depth + 1) for c in range(len(centres))]
        self.nodes[own] = (centres, children)
        return ("node", own)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row by greedy descent."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            centres, children = self.nodes[node]
            at = np.argmax(x[rows] @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
            for c, (kind, number) in enumerate(children):
                own = rows[at == c]
                if kind == "leaf":
                    out[own] = number
                else:
                    todo.append((number, own))
        return out

    def leaves(self, q: np.ndarray, most: int, rows: np.ndarray | None = None, need: int = 0) -> list[int]:
        """The first ``most`` leaves of a query in best-bin-first order, and more until they hold ``need`` rows."""
        queue, out, held = [(0.0, 0, "node", 0)], [], 0
        while queue and (len(out) < most or held < need):
            _, _, kind, number = heappop(queue)
            if kind == "leaf":
                out.append(number)
                held += int(rows[number]) if rows is not None else 0
                continue
            centres, children = self.nodes[number]
            for d, (kind, child) in zip(((centres - q) ** 2).sum(1), children, strict=True):
                heappush(queue, (float(d), child, kind, child))
        return out


def _matrix(vectors, dims: int) -> np.ndarray:
    """Vectors as rows, scaled by powers of two so that squares neither overflow nor vanish; short ones end in zeros.

    Scaling by a power of two changes no digit, so cosines are those of the vectors as they are.
    """
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))
    lens = np.diff(ends, prepend=0)
    if (lens == dims).all():
        x = flat.reshape(-1, dims)
    else:
        x = np.zeros((len(lens), dims))
        x[np.repeat(np.arange(len(lens)), lens), np.arange(len(flat)) - np.repeat(ends - lens, lens)] = flat
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def top_pairs(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int):
    """For each query its k largest cosines among the rows but itself, ties to the smaller id: (query, id, score).

    A matrix product preselects all rows within 1e-9 of the k-th best; those are scored again
    one by one in double precision on the original vectors, so equal vectors score equally.
    """
    qn, xn = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
    out_q, out_x, out_s = [], [], []
    for at in range(0, len(q), 256):
        rough = (q[at : at + 256] / qn[at : at + 256, None]) @ (x / xn[:, None]).T
        rough[q_ids[at : at + 256, None] == x_ids[None, :]] = -np.inf
        kth = np.partition(rough, -min(k, len(x)), axis=1)[:, -min(k, len(x))]
        for r in range(len(rough)):
            c = np.nonzero((rough[r] >= kth[r] - 1e-9) & (rough[r] > -np.inf))[0]
            s = (x[c] * q[at + r]).sum(axis=1) / (qn[at + r] * xn[c])
            best = np.lexsort((x_ids[c], -s))[:k]
            out_q += [q_ids[at + r]] * len(best)
            out_x += x_ids[c][best].tolist()
            out_s += s[best].tolist()
    return out_q, out_x, out_s


TOP = "query_id long, vec_id long, score double"


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, params: Params = Params(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k nearest found: query_id, rank (from 1), vec_id, score (cosine).

    Queries are the rows whose id is divisible by ``every``; candidates are all rows with another id.
    Rows take no part whose id or vector is null, or whose vector is zero or holds a null or non-finite
    component.  Vectors of another length than the longest count as if they ended in zeros.  Repeated rows are candidates
    each; with equal scores the smaller id comes first.  An empty table gives an empty result.
    """
    spark, p = vectors.sparkSession, params
    small_batches(spark)
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null and size(v) > 0")
    v = v.where(F.expr("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)"))
    dims, n = v.agg(F.max(F.size("v")), F.count(F.lit(1))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = min(max(p.sample, n // p.share), max(p.sample, p.most_sample))
    sample = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(size).toArrow().combine_chunks()
    raw = _matrix(pa.concat_arrays(sample["v"].chunks), dims)
    tree = Tree(_unit(raw), min(max(1, n // p.leaf_rows), max(1, len(raw) // 16)), p.branch, p.seed)
    visits = _calibrate(v, tree, sample["vec_id"].to_numpy()[: p.calibration], raw[: p.calibration], k, p)
    sent = spark.sparkContext.broadcast(tree)  # the sample bounds it

    def place(batches):
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v"), dims)
                yield batch_of(["vec_id", "leaf", "x"], [pa.int64(), pa.int32(), pa.binary()], [b.column("vec_id"), sent.value.assign(_unit(x)).astype(np.int32), [r.tobytes() for r in x]])

    placed = v.mapInArrow(place, "vec_id long, leaf int, x binary")
    # Blocks: the leaves' counts are a table bounded by the number of leaves.
    row_counts = {r.leaf: r["count"] for r in placed.groupBy("leaf").count().collect()}
    held = np.array([row_counts.get(leaf, 0) for leaf in range(tree.n_leaves)], np.int64)

    def visit(batches):
        for b in batches:
            rows: list[tuple] = []
            if b.num_rows:
                x = _matrix(b.column("v"), dims)
                for i, r, unit in zip(b.column("vec_id").to_pylist(), x, _unit(x), strict=True):
                    rows += [(i, leaf, r.tobytes()) for leaf in sent.value.leaves(unit, visits, held, k + 1)]
            yield batch_of(["query_id", "leaf", "q"], [pa.int64(), pa.int32(), pa.binary()], [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], []])

    asked = v.where(F.col("vec_id") % every == 0).mapInArrow(visit, "query_id long, leaf int, q binary")
    ask_counts = {r.leaf: r["count"] for r in asked.groupBy("leaf").count().collect()}
    cuts = [(leaf, -(-row_counts.get(leaf, 1) // p.block), -(-ask_counts.get(leaf, 1) // p.block)) for leaf in range(tree.n_leaves)]
    cuts_table = F.broadcast(spark.createDataFrame(cuts, "leaf int, row_cuts int, ask_cuts int"))
    salt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = placed.join(cuts_table, "leaf").withColumn("r", salt("vec_id", "row_cuts")).withColumn("a", F.explode(F.expr("sequence(0, ask_cuts - 1)"))).select("leaf", "r", "a", "vec_id", "x")
    right = asked.join(cuts_table, "leaf").withColumn("a", salt("query_id", "ask_cuts")).withColumn("r", F.explode(F.expr("sequence(0, row_cuts - 1)"))).select("leaf", "r", "a", "query_id", "q")

    def score(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asks):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        m = np.frombuffer(b"".join(rows.x), np.float64).reshape(len(rows), dims)
        q = np.frombuffer(b"".join(asks.q), np.float64).reshape(len(asks), dims)
        a, b, s = top_pairs(q, asks.query_id.to_numpy(), m, rows.vec_id.to_numpy(), k)
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": s}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["leaf", "r", "a"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, TOP)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _calibrate(v: DataFrame, tree: Tree, q_ids: np.ndarray, q: np.ndarray, k: int, p: Params) -> int:
    """The least number of leaves by which the calibration queries reach the recall aimed at."""
    spark = v.sparkSession
    dims = q.shape[1]
    sent = spark.sparkContext.broadcast((q_ids, q, tree))

    def run(batches):
        ids, qs, t = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            x_ids = np.array(b.column("vec_id").to_pylist(), np.int64)
            x = _matrix(b.column("v"), dims)
            leaf_of = dict(zip(x_ids.tolist(), t.assign(_unit(x)).tolist(), strict=True))
            a, c, s = top_pairs(qs, ids, x, x_ids, k)
            yield batch_of(["query_id", "vec_id", "score", "leaf"], [pa.int64(), pa.int64(), pa.float64(), pa.int32()], [a, c, s, [leaf_of[i] for i in c]])

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = v.mapInArrow(run, TOP + ", leaf int").withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).collect()  # calibration * k rows
    order = {int(i): {leaf: n for n, leaf in enumerate(tree.leaves(u, tree.n_leaves), 1)} for i, u in zip(q_ids, _unit(q), strict=True)}
    needed = sorted(order[r.query_id][r.leaf] for r in best)
    return needed[min(len(needed) - 1, int(np.ceil(p.recall * len(needed))) - 1)] if needed else tree.n_leaves
