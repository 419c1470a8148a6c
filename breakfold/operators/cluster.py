"""Clustering of calls: runs along one coordinate, greedy star covers and greedy merging."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breakfold.operators.staging import in_chunks, running_count, staged

PART = ["var", "chrA", "chrB"]


def run_labels(df: DataFrame, part: list[str], order: list[str], pos: str, epsilon, min_pts: int, label: str, chunk: int = 1 << 16) -> DataFrame:
    """df with a run number (from 1 in each part), null for noise.

    A row is core if the row min_pts - 1 further on is nearer than epsilon; consecutive cores are a run,
    and a run's last core takes the min_pts - 1 rows behind it along.  Where two runs claim a row the later wins.

    Rows are counted through and taken in chunks that overlap by what a label depends on, so a part's size is no matter.
    """
    if min_pts < 2:
        raise ValueError("min_pts must be 2 or more")
    # A row's label depends on cores up to min_pts - 1 rows before it, these on the row before and on min_pts - 1 behind.
    out = in_chunks(df, part, order, 2 * min_pts, chunk)
    w = Window.partitionBy("__chunk", *part).orderBy("__n")
    far = F.lead(pos, min_pts - 1).over(w)
    out = out.withColumn("__core", F.coalesce(far - F.col(pos) < epsilon, F.lit(False)))
    out = out.withColumn("__new", F.col("__core") & ~F.coalesce(F.lag("__core").over(w), F.lit(False)))
    out = running_count(out, part, "__new", "__count").withColumn("__run", F.when(F.col("__core"), F.col("__count")))
    out = out.withColumn(label, F.last("__run", ignorenulls=True).over(w.rowsBetween(-(min_pts - 1), 0)).cast("long"))
    return out.where("__home").drop("__core", "__new", "__run", "__count", "__n", "__chunk", "__home")


def dbscan_xy(df: DataFrame, epsilon, min_pts: int, part: list[str] = PART) -> DataFrame:
    """df with x_label and y_label: runs along posA, then runs along posB inside each; null y_label is noise.

    (x_label, y_label) names a cluster.  Rows are ordered by posA, posB, idx, and inside a run by posB and then that order.
    """
    by_x = staged(run_labels(df, part, ["posA", "posB", "idx"], "posA", epsilon, min_pts, "x_label"))
    in_run = by_x.where("x_label is not null")
    by_y = run_labels(in_run, [*part, "x_label"], ["posB", "posA", "idx"], "posB", epsilon, min_pts, "y_label")
    return by_y.unionByName(by_x.where("x_label is null").withColumn("y_label", F.lit(None).cast("long")))


def blocks(df: DataFrame, part: list[str], distance: Column | int, order: list[str], chunk: int = 1 << 16) -> DataFrame:
    """df with __block: parts are cut where posA jumps by more than the distance, as no link spans such a gap."""
    out = in_chunks(df, part, order, 1, chunk)
    w = Window.partitionBy("__chunk", *part).orderBy("__n")
    out = out.withColumn("__jump", F.coalesce(F.col("posA") - F.lag("posA").over(w) > distance, F.lit(False)))
    return running_count(out, part, "__jump", "__block").where("__home").drop("__jump", "__n", "__chunk", "__home")


def fold_blocks(df: DataFrame, keys: list[str], order: list[str], fold, schema: str) -> DataFrame:
    """fold(rows) -> rows for each block of equal keys, in order; many small blocks are taken in one go.

    Blocks are dealt by their keys and sorted; a task holds one Arrow batch and the block that runs over its end.
    ``fold`` gets a frame and its blocks' bounds, and returns a frame.
    """

    def run(frames):
        held = None
        for pdf in frames:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            bounds = _bounds(pdf, keys)
            held = pdf.iloc[bounds[-2] :]
            if len(bounds) > 2:
                yield fold(pdf.iloc[: bounds[-2]], bounds[:-1])
        if held is not None and len(held):
            yield fold(held.reset_index(drop=True), np.array([0, len(held)]))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _bounds(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    new = np.zeros(len(pdf), bool)
    new[0] = True
    for k in keys:
        v = pdf[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.nonzero(new)[0], len(pdf))


def _star_fold(a: np.ndarray, b: np.ndarray, inter: bool, distance: float, overlap: float) -> list[tuple[int, np.ndarray]]:
    """Centres and their closed neighbourhoods; rows come in the order of posA and posB.

    Equal positions are one spot.  Spots are counted by length if an overlap is asked for, else by posA, some thousand pairs at a time;
    only a centre's neighbourhood is kept.
    """
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    ends = np.append(first[1:], len(a))
    sa, sb, weight = a[first], b[first], ends - first
    by_length = not inter and overlap > 0 and bool((sb >= sa).all())
    key = (sb - sa + 1) if by_length else sa
    order = np.argsort(key, kind="stable")
    key, ka, kb, kw = key[order], sa[order], sb[order], weight[order]

    def window(low, high):
        # An overlap of this much needs lengths that differ by no more than this factor; one more on each side is for rounding.
        bounds = (low * overlap - 1, high / overlap + 1) if by_length else (low - distance, high + distance)
        return np.searchsorted(key, bounds[0], side="left"), np.searchsorted(key, bounds[1], side="right")

    def linked(xa, xb, lo, hi):
        ya, yb = ka[lo:hi], kb[lo:hi]
        ok = (np.abs(ya - xa) <= distance) & (np.abs(yb - xb) <= distance)
        if not inter:
            ok &= (np.minimum(yb, xb) - np.maximum(ya, xa) + 1) / (np.maximum(yb, xb) - np.minimum(ya, xa) + 1) >= overlap
        return ok

    size = np.zeros(len(first), np.int64)
    at = 0
    while at < len(key):
        upto = min(len(key), at + 64)
        lo, hi = window(key[at], key[upto - 1])
        step = max(1, min(upto - at, (1 << 20) // max(1, hi - lo)))
        upto = at + step
        size[order[at:upto]] = linked(ka[at:upto, None], kb[at:upto, None], lo, hi) @ kw[lo:hi]
        at = upto
    place = np.empty(len(first), np.int64)
    place[order] = np.arange(len(first))
    taken, out = np.zeros(len(first), bool), []
    for s in np.argsort(-size, kind="stable"):
        if not taken[s]:
            k = place[s]
            lo, hi = window(key[k], key[k])
            near = np.sort(order[lo:hi][linked(ka[k], kb[k], lo, hi)])
            taken[near] = True
            taken[s] = True
            out.append((int(first[s]), np.concatenate([np.arange(first[j], ends[j]) for j in near]) if len(near) else near))
    return out


def star_cover(df: DataFrame, distance: Column, overlap: Column, part: list[str]) -> DataFrame:
    """Greedy star cover inside each part: (part, center_idx, idx, posA, posB, sample, is_center).

    Rows by falling number of neighbours (ties by posA, posB, idx); a free row becomes a centre and its whole
    neighbourhood its cluster, so clusters may share rows.  Parts are cut at gaps wider than the distance, so a
    task gets rows that hang together only.
    """
    keyed = blocks(df.withColumn("__d", distance.cast("double")).withColumn("__o", overlap.cast("double")), part, F.col("__d"), ["posA", "posB", "idx"])

    def fold(pdf: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        a, b, ids = pdf.posA.to_numpy(), pdf.posB.to_numpy(), pdf.idx.to_numpy()
        inter = (pdf.chrA != pdf.chrB).to_numpy()
        far, need = pdf["__d"].to_numpy(), pdf["__o"].to_numpy()
        rows, centres = [], []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            stars = [(0, [0])] if hi - lo == 1 else _star_fold(a[lo:hi], b[lo:hi], inter[lo], far[lo], need[lo])
            for c, near in stars:
                rows.append(lo + np.asarray(near, np.int64))
                centres.append(np.full(len(near), ids[lo + c]))
        rows, centres = np.concatenate(rows), np.concatenate(centres)
        out = pdf.iloc[rows][[*part, "idx", "posA", "posB", "sample"]].copy()
        out["center_idx"] = centres
        out["is_center"] = out.center_idx == out.idx
        return out

    types = dict(df.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in [*part, "idx", "posA", "posB", "sample"]) + ", center_idx long, is_center boolean"
    keep = list(dict.fromkeys([*part, "__block", "chrA", "chrB", "idx", "posA", "posB", "sample", "__d", "__o"]))
    return fold_blocks(keyed.select(*keep), [*part, "__block"], ["posA", "posB", "idx"], fold, schema)


def greedy_merge(calls: DataFrame, overlap: float = 0.95, bnd_distance: int = 2000, ins_distance: int = 50, no_intra: bool = False, no_var: bool = False, pass_only: bool = False) -> DataFrame:
    """(call_id, anchor_id): calls in posA order (ties by source_ord, line_no); a free call is an anchor and claims every later free one that matches it.

    Members are compared with the anchor only.  The anchor's type alone decides between distance and overlap.
    On one chromosome nothing further than bnd_distance is claimed, insertions included.  With pass_only, calls that don't pass
    neither claim nor are claimed; with no_intra, an anchor claims calls of other sources only.

    Calls are dealt by chromosome pair (and type) and cut at gaps wider than any link.
    """
    part = ["chrA", "chrB"] + ["event_type"] * (not no_var)
    reach = F.when(F.col("chrA") == F.col("chrB"), F.lit(bnd_distance)).otherwise(F.lit(max(bnd_distance, ins_distance)))
    order = ["posA", "source_ord", "line_no"]
    keyed = blocks(calls, part, reach, order).withColumn("__pass", F.col("filter").isin("PASS", "."))

    def fold(pdf: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        a, b, src = pdf.posA.to_numpy(), pdf.posB.to_numpy(), pdf.source_ord.to_numpy()
        kinds, ok, ids = pdf.event_type.to_numpy(), pdf["__pass"].to_numpy(bool), pdf.call_id.to_numpy()
        apart = (pdf.chrA != pdf.chrB).to_numpy()
        owner = np.arange(len(a))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo == 1:
                continue
            free, inter = np.ones(hi - lo, bool), apart[lo]
            for i in range(lo, hi):
                if not free[i - lo] or (pass_only and not ok[i]):
                    continue
                ratio, far = (-1.0, ins_distance) if "INS" in kinds[i] else (overlap, bnd_distance)
                stop = hi if inter else lo + int(np.searchsorted(a[lo:hi], a[i] + bnd_distance, side="right"))
                j = np.arange(i + 1, max(stop, i + 1))
                j = j[free[j - lo] & (np.abs(a[j] - a[i]) <= far) & (np.abs(b[j] - b[i]) <= far)]
                if pass_only:
                    j = j[ok[j]]
                if no_intra:
                    j = j[src[j] != src[i]]
                if not inter and len(j):
                    r = (np.minimum(b[j], b[i]) - np.maximum(a[j], a[i]) + 1) / (np.maximum(b[j], b[i]) - np.minimum(a[j], a[i]) + 1)
                    j = j[r >= ratio]
                owner[j] = i
                free[j - lo] = False
        return pd.DataFrame({"call_id": ids, "anchor_id": ids[owner]})

    cols = list(dict.fromkeys([*part, "__block", "event_type", "posA", "posB", "source_ord", "line_no", "call_id", "__pass"]))
    return fold_blocks(keyed.select(*cols), [*part, "__block"], order, fold, "call_id long, anchor_id long")


def first_mis(nodes: DataFrame, edges: DataFrame, checkpoint, most_rounds: int = 200) -> DataFrame:
    """Greedy claiming by rounds of joins, for blocks too large for a task: (id, owner).

    nodes: id, rank (unique).  edges: (a, b), the ranks of two linked nodes, a < b.  A node all of whose lower neighbours are claimed
    is an anchor; a node with an anchor below it is claimed, in the end by the lowest one; owner is that anchor's rank.  ``checkpoint`` cuts lineage each round.
    """
    state = checkpoint(nodes.select("id", "rank", F.lit(None).cast("boolean").alias("anchor")))
    for _ in range(most_rounds):
        free = state.where("anchor is null").select(F.col("rank").alias("r"))
        blocked = edges.join(free, F.col("a") == F.col("r"), "left_semi").select(F.col("b").alias("r")).distinct()
        new = free.join(blocked, "r", "left_anti")
        claimed = edges.join(new, F.col("a") == F.col("r"), "left_semi").select(F.col("b").alias("r")).distinct().withColumn("to", F.lit(False))
        told = new.withColumn("to", F.lit(True)).unionByName(claimed).groupBy("r").agg(F.bool_or("to").alias("to"))
        state = checkpoint(state.join(told, F.col("rank") == F.col("r"), "left").select("id", "rank", F.coalesce("anchor", "to").alias("anchor")))
        if not state.where("anchor is null").take(1):
            break
    else:
        raise RuntimeError("claims did not settle")
    anchors = state.where("anchor").select(F.col("rank").alias("r"))
    owners = edges.join(anchors, F.col("a") == F.col("r"), "left_semi").groupBy("b").agg(F.min("a").alias("owner"))
    return state.join(owners, F.col("rank") == F.col("b"), "left").select("id", F.when(F.col("anchor"), F.col("rank")).otherwise(F.col("owner")).alias("owner"))
