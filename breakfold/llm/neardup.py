"""Near duplicates by one-permutation MinHash, and their groups by confirmed links.

1. Documents with the same words in the same order are one class, taken by its least id.
2. A class's set of shingle hashes is cut into ``bands * rows`` equal ranges of the hash
   space; the least hash in a range is its value.  An empty range takes the value of
   the first range in an order of its own that isn't empty (optimal densification).
3. Classes meet in buckets of equal bands.  In a bucket, members whose signatures agree
   well enough and whose sizes allow the similarity are joined, and every
   resulting cluster leaves the bucket as a star: an edge from its least id to each member.
   So a bucket of m classes gives less than m edges, never its pairs.
4. Components of the stars are candidate groups, which hold every link that the bands find.
   Inside a group links are confirmed on full sets, again leaving as stars, so no link between
   different texts is lost where a star's centre isn't similar to all.
5. Components of the confirmed stars are the result.

Buckets and groups of more than ``block`` members are dealt into blocks.  First each block meets the least
member of all, the centre, so a group of variants of one text is linked in about as many comparisons
as it has members.  Then members that aren't linked to the centre, dealt into blocks of their own, meet all
blocks; members that are linked to it needn't be compared with each other.  A task gets 2 * block members at most.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, cut, discard, small_batches, with_least
from .components import components
from .words import U, WordHashes, mixed, runs, words


@dataclass(frozen=True)
class Params:
    """A pair of similarity s shares no band with probability (1 - s^rows)^bands: 8e-7 at 0.85 with the defaults."""

    shingle: int = 3
    percent: int = 85  # links have 100 * intersection >= percent * union
    rows: int = 5
    bands: int = 24
    block: int = 128
    slack: float = 0.2  # signatures may agree by so much less than the similarity: six standard deviations

    @property
    def bins(self) -> int:
        return self.rows * self.bands


def shingle_set(found: list[bytes], n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; of fewer words, the whole sequence is one."""
    if not found:
        return np.zeros(0, U)
    h = hashes(found)
    return np.unique(runs(h, n) if len(found) >= n else mixed(runs(h, len(found)) + U(len(found))))


def _orders(bins: int) -> np.ndarray:
    """place[i, j]: where range j stands in the order in which range i looks for a value."""
    rng = np.random.default_rng(11)
    return np.stack([np.argsort(rng.permutation(bins)) for _ in range(bins)])


class Signer:
    def __init__(self, p: Params):
        self.p, self.place = p, _orders(p.bins)
        self.bounds = np.array([(i << 64) // p.bins for i in range(p.bins)], U)
        self.powers = np.array([pow(0xD6E8FEB86659FD93, r + 1, 1 << 64) for r in range(p.rows)], U)
        self.band = mixed(np.arange(1, p.bands + 1, dtype=U))

    def values(self, shingles: np.ndarray) -> np.ndarray:
        """The signature of a set that isn't empty."""
        h = np.sort(mixed(shingles ^ U(0x5851F42D4C957F2D)))
        at = np.searchsorted(h, self.bounds)
        ends = np.append(at[1:], len(h))
        full = at < ends
        out = h[np.minimum(at, len(h) - 1)]
        if not full.all():
            have = np.nonzero(full)[0]
            empty = np.nonzero(~full)[0]
            out[empty] = out[have[np.argmin(self.place[np.ix_(empty, have)], axis=1)]]
        return out

    def keys(self, values: np.ndarray) -> np.ndarray:
        grid = values.reshape(self.p.bands, self.p.rows)
        return mixed((grid * self.powers).sum(axis=1, dtype=U) + self.band).view(np.int64)


def _clusters(n: int, linked, known: np.ndarray) -> np.ndarray:
    """The least member of each member's cluster; linked(i, rest) tells which members of ``rest`` i is linked to.

    Members with ``known`` are one cluster already.  A member is compared only with later ones that aren't in its cluster
    yet, so a group whose members are mostly linked to each other takes about as many comparisons as it has members.
    """
    root = np.arange(n)
    root[known] = np.argmax(known)
    for i in range(n - 1):
        rest = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        if not len(rest):
            break
        found = rest[linked(i, rest)]
        if len(found):
            joined = np.unique(np.append(root[found], root[i]))
            root[np.isin(root, joined)] = joined[0]
    return root


def _links(rows: DataFrame, key: str, payload: DataFrame, star, names: list[str], block: int) -> DataFrame:
    """Edges (a, b) whose components are those of all links between rows (key, doc_id) of equal keys; payload has doc_id and what is compared."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__m"), F.min("doc_id").alias("__centre")).where("__m > 1").select(key, "__centre", F.expr(f"cast(ceil(__m / {block}) as int)").alias("__n"))
    members = rows.join(sizes.hint("merge"), key).withColumn("__i", F.expr("cast(pmod(xxhash64(doc_id, 5), __n) as int)"))
    every = F.explode(F.expr("sequence(0, __n - 1)"))
    centres = members.where("doc_id = __centre and __n > 1").withColumn("__own", F.col("__i")).withColumn("__i", every).where("__i <> __own").drop("__own")
    first = members.unionByName(centres).select(key, "__i", F.lit(-1).alias("__j"), "doc_id", F.lit(False).alias("known"))
    # The same join at every size: a broadcast that small tables get would hide what large ones send.
    edges = cut(_stars(first.hint("merge").join(payload, "doc_id"), key, star, names))
    big = cut(members.where("__n > 1").select(key, "doc_id", "__centre", "__n", "__i"))
    if not big.take(1):
        return edges
    near = edges.select(F.col("a").alias("__centre"), F.col("b").alias("doc_id"), F.lit(True).alias("known")).distinct()
    told = big.join(near, ["__centre", "doc_id"], "left").withColumn("known", F.coalesce("known", F.col("doc_id") == F.col("__centre")))
    told = cut(told)
    apart = told.where("not known")
    if not apart.take(1):
        discard(big, told)
        return edges
    counts = apart.groupBy(key).agg(F.expr(f"cast(ceil(count(1) / {block}) as int)").alias("__r"))
    told = told.join(counts, key).withColumn("__q", F.when(~F.col("known"), F.expr("cast(pmod(xxhash64(doc_id, 6), __r) as int)")))
    asking = told.where("not known").withColumn("__j", F.col("__q")).withColumn("__i", every)
    asked = told.withColumn("__j", F.explode(F.expr("sequence(0, __r - 1)"))).where("known or __q <> __j")
    cols = [key, "__i", "__j", "doc_id", "known"]
    second = asking.select(*cols).unionByName(asked.select(*cols))
    return edges.unionByName(_stars(second.hint("merge").join(payload, "doc_id"), key, star, names))


TASK = ["__i", "__j"]


def _stars(rows: DataFrame, key: str, star, names: list[str]) -> DataFrame:
    """star(columns, lo, hi) -> (ids, roots) for each task's rows lo..hi, as edges (a, b) from a cluster's least id to each member.

    Tasks of the same partition are taken one after another from its sorted rows; what is held is one Arrow batch and
    the task that runs over its end.
    """
    keys = [key, *TASK]

    def run(batches):
        held = None
        for b in _and_end(batches):
            if b is not None:
                held = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            if held is None or not held.num_rows:
                continue
            new = np.zeros(held.num_rows, bool)
            new[0] = True
            for k in keys:
                v = held.column(k).to_numpy()
                new[1:] |= v[1:] != v[:-1]
            bounds = np.append(np.nonzero(new)[0], held.num_rows)
            if b is not None:
                bounds = bounds[:-1]  # the last task may go on in the next batch
            columns = {n: held.column(n) for n in names}
            prepared = star.prepare(columns, bounds[-1])
            known = held.column("known").to_numpy(zero_copy_only=False)
            out_a, out_b = [], []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if hi - lo > 1:
                    a, c = star(prepared, lo, hi, known[lo:hi])
                    out_a.append(a)
                    out_b.append(c)
            held = held.slice(bounds[-1])
            none = np.zeros(0, np.int64)
            yield batch_of(["a", "b"], [pa.int64(), pa.int64()], [np.concatenate(out_a or [none]), np.concatenate(out_b or [none])])

    ready = rows.repartition(*keys).sortWithinPartitions(*keys, "doc_id").select(*keys, "known", *names)
    return ready.mapInArrow(run, "a long, b long")


def _and_end(batches):
    yield from batches
    yield None


class BucketStar:
    """Clusters of a bucket by size and agreement of signatures."""

    def __init__(self, p: Params):
        self.p, self.least = p, (p.percent / 100 - p.slack) * p.bins

    def prepare(self, columns: dict, n: int):
        sig = columns["sig"].slice(0, n)
        return columns["doc_id"].to_numpy()[:n], columns["n"].to_numpy()[:n], np.frombuffer(b"".join(sig.to_pylist()), np.uint8).reshape(n, -1) if n else None

    def __call__(self, prepared, lo: int, hi: int, known: np.ndarray):
        ids, n, sigs = (x[lo:hi] for x in prepared)
        p = self.p

        def linked(i, rest):
            a, b = np.minimum(n[i], n[rest]), np.maximum(n[i], n[rest])
            out = 100 * a >= p.percent * b
            at = np.nonzero(out)[0]
            out[at] = (sigs[rest[at]] == sigs[i]).sum(axis=1) >= self.least
            return out

        return _edges(ids, _clusters(len(ids), linked, known), known)


class SetStar:
    """Clusters of a group by the similarity of full sets."""

    def __init__(self, p: Params):
        self.p, self.hashes = p, None

    def prepare(self, columns: dict, n: int):
        self.hashes = self.hashes or WordHashes()
        return columns["doc_id"].to_numpy()[:n], columns["text"]

    def __call__(self, prepared, lo: int, hi: int, known: np.ndarray):
        p, ids = self.p, prepared[0][lo:hi]
        sets = [shingle_set(words(t, lower=True), p.shingle, self.hashes) for t in prepared[1].slice(lo, hi - lo).to_pylist()]
        n = np.array([len(s) for s in sets], np.int64)
        flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
        ends = np.cumsum(n)
        # Members of each shingle, as runs of a sorted list.
        owner = np.repeat(np.arange(len(sets)), n)
        order = np.argsort(flat, kind="stable")
        holders, first = owner[order], np.searchsorted(flat[order], np.arange(flat.max() + 2))

        def linked(i, rest):
            own = flat[ends[i] - n[i] : ends[i]]
            a, b = first[own], first[own + 1]
            lens = b - a
            at = np.repeat(b - np.cumsum(lens), lens) + np.arange(lens.sum())
            both = np.bincount(holders[at], minlength=len(sets))[rest]
            return 100 * both >= p.percent * (n[i] + n[rest] - both)

        return _edges(ids, _clusters(len(ids), linked, known), known)


def _edges(ids: np.ndarray, root: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An edge from each cluster's least member to every other; of known members one stands for all."""
    told = known & (np.cumsum(known) > 1)
    keep = (root != np.arange(len(ids))) & ~told
    return ids[root[keep]], ids[keep]


def near_duplicates(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Words are lower-cased in A-Z only.  component_id is the least id that links reach, the row's own included; kept
    is whether that is the row's own id.  Null texts and texts without words have no shingles and no links.  A null
    id links to nothing and has component_id null.  Rows repeated with the same id share one result each.
    An empty table gives an empty result.
    """
    spark, p = docs.sparkSession, params
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def sign(batches):
        hashes, signer = WordHashes(), Signer(p)
        for b in batches:
            same, sizes, sigs, keys = [], [], [], []
            for t in b.column("text").to_pylist():
                w = words(t, lower=True)
                s = shingle_set(w, p.shingle, hashes)
                v = signer.values(s) if w else None
                same.append(xxhash.xxh3_128_digest(b" ".join(w)) if w else None)
                sizes.append(len(s))
                sigs.append((v & U(255)).astype(np.uint8).tobytes() if w else None)
                keys.append(signer.keys(v).tolist() if w else None)
            yield batch_of(["doc_id", "same", "n", "sig", "keys"], [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64())], [b.column("doc_id"), same, sizes, sigs, keys])

    # One pass over the texts; a document's row is of fixed size.
    signs = cut(rows.mapInArrow(sign, "doc_id long, same binary, n long, sig binary, keys array<long>"))
    heads = signs.select("doc_id", "same", F.col("n").alias("n_shingles"))
    alone = heads.where("same is null or doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("rep"))
    reps = cut(with_least(heads, "same", "doc_id", "rep").select("doc_id", "n_shingles", "rep").unionByName(alone))
    one = reps.where("doc_id = rep").select("doc_id").distinct()
    signed = signs.where("same is not null").join(one, "doc_id", "left_semi")
    banded = signed.select("doc_id", F.explode("keys").alias("key"))
    stars = _links(banded, "key", signed.select("doc_id", "n", "sig"), BucketStar(p), ["doc_id", "n", "sig"], p.block)
    groups = cut(components(stars))
    grouped = groups.select(F.col("id").alias("doc_id"), F.col("component").alias("grp"))
    grouped = grouped.unionByName(grouped.select(F.col("grp").alias("doc_id"), "grp").distinct())
    # A text of a group is sent to its block once, but for what is apart from its group's centre.
    links = _links(grouped, "grp", rows.where("doc_id is not null"), SetStar(p), ["doc_id", "text"], p.block)
    found = components(links).select(F.col("id").alias("rep"), "component")
    out = reps.join(found, "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, params: Params, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with the least id of their group, with all their columns.

    Rows with a null id stay, and so do all rows repeated with an id that stays: they aren't told apart here.  An empty
    table gives an empty result.
    """
    gone = near_duplicates(docs, params, id_col, text_col).where("not kept").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone.hint("merge"), F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
