"""Substring deduplication with a log-structured index of fingerprints.

A window is ``width`` consecutive words of one document.  Each window is known by its anchor, the least
hash among the runs of half its words in it: equal windows have equal anchors, and neighbouring
windows mostly share theirs, so a document has one anchor for about a dozen windows.

The index holds immutable runs, sorted and bucketed by their key, of two kinds, and the documents' texts:

* anchors: (anchor, first, last), the least and greatest id of the documents that have the anchor;
* windows: (two halves of a 128-bit hash of the words, first), of every window whose anchor several documents have;
* texts: those of the documents that aren't copies of others, bucketed by id.

A batch becomes a new run of anchors, which is merge-joined with the runs of earlier batches.  Only windows whose
anchor some other document has are looked at further.  If an earlier document was the only one with its anchor, its
text is read again, by its bucket, for its windows; each anchor becomes shared only once, and later batches find those windows in
the runs.  Windows are verified by their whole 128-bit hashes in a merge join with the runs of windows, which also gives
the least document id of each.  Runs are compacted when there are too many of a level, as in a log-structured merge
tree, and what was compacted is deleted.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import batch_of, cut, delete, discard, small_batches, with_least, work_folder
from .words import U, WordHashes, runs, sliding_min, words


@dataclass(frozen=True)
class Params:
    width: int = 50
    fan: int = 2  # runs of a level that are compacted into one of the next

    @property
    def gram(self) -> int:
        return max(1, self.width // 2)


def anchors(h: np.ndarray, p: Params) -> np.ndarray:
    """The anchor of each window of a document's word hashes."""
    return sliding_min(runs(h, p.gram), p.width - p.gram + 1)


def covered(starts: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of n words a window that starts at one of the starts covers."""
    edge = np.zeros(n + 1, np.int64)
    edge[starts] += 1
    edge[starts + width] -= 1
    return np.cumsum(edge[:n]) > 0


#: Keys of the runs of each kind.
KEYS = {"anchors": ["anchor"], "windows": ["w1", "w2"], "texts": ["doc_id"]}


@dataclass
class Index:
    """Sorted runs by kind and level, as bucketed Parquet tables in a shared folder."""

    spark: SparkSession
    params: Params = field(default_factory=Params)
    folder: str = ""
    levels: dict[str, list[list[str]]] = field(default_factory=lambda: {kind: [[]] for kind in KEYS})
    compacted: int = 0

    def __post_init__(self):
        self.folder = self.folder or f"{work_folder(self.spark)}/fingerprints-{uuid.uuid4().hex}"

    def runs(self, kind: str) -> list[DataFrame]:
        """All runs of a kind; a key may stand in several."""
        return [self.spark.table(name) for level in self.levels[kind] for name in level]

    def write(self, kind: str, rows: DataFrame, level: int = 0) -> DataFrame:
        """A new run, which other runs of its kind can be joined with bucket by bucket."""
        name = f"run_{uuid.uuid4().hex}"
        n = min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 50_000)  # Spark takes 100,000 buckets at most
        out = rows.write.bucketBy(n, *KEYS[kind])
        if kind != "texts":  # texts are met by hash, so they need no order
            out = out.sortBy(*KEYS[kind])
        out.option("path", f"{self.folder}/{name}").saveAsTable(name)
        while len(self.levels[kind]) <= level:
            self.levels[kind].append([])
        self.levels[kind][level].append(name)
        return self.spark.table(name)

    def compact(self, kind: str) -> None:
        """Merges the runs of every full level into one of the next."""
        level, folds = 0, [F.min("first").alias("first"), F.max("last").alias("last")]
        while level < len(self.levels[kind]) and len(self.levels[kind][level]) >= self.params.fan:
            old, self.levels[kind][level] = self.levels[kind][level], []
            merged = reduce(DataFrame.unionByName, [self.spark.table(name) for name in old])
            self.write(kind, merged.groupBy(*KEYS[kind]).agg(*folds), level + 1)
            self._drop(old)
            self.compacted += 1
            level += 1

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"drop table if exists {name}")
            delete(self.spark, f"{self.folder}/{name}")

    def close(self) -> None:
        """Deletes the index; results that were not used yet can't be read then."""
        for kind in KEYS:
            self._drop([name for level in self.levels[kind] for name in level])
            self.levels[kind] = [[]]


def _digests(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, n_words, a digest of the words, and the distinct anchors of each document."""

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            sizes, same, found = [], [], []
            for t in b.column("text").to_pylist():
                w = words(t)
                sizes.append(len(w))
                same.append(xxhash.xxh3_128_digest(b" ".join(w)))
                found.append(np.unique(anchors(hashes(w), p)).view(np.int64))
            ends = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found or [np.zeros(0, np.int64)])))
            yield batch_of(["doc_id", "n_words", "same", "anchors"], [pa.int64(), pa.int64(), pa.binary(), None], [b.column("doc_id"), sizes, same, lists])

    return docs.mapInArrow(run, "doc_id long, n_words long, same binary, anchors array<long>")


def _with_older(new: DataFrame, older: list[DataFrame], keys: list[str]) -> DataFrame:
    """new with the least first and greatest last that older runs have of its keys, as old_first and old_last."""
    for n, run in enumerate(older):
        new = new.join(run.select(*keys, F.col("first").alias(f"__f{n}"), F.col("last").alias(f"__l{n}")).hint("merge"), keys, "left")
    n = len(older)
    # least and greatest leave nulls out, but need two values
    low = F.least(F.lit(None).cast("long"), F.lit(None).cast("long"), *[F.col(f"__f{k}") for k in range(n)])
    high = F.greatest(F.lit(None).cast("long"), F.lit(None).cast("long"), *[F.col(f"__l{k}") for k in range(n)])
    return new.withColumns({"old_first": low, "old_last": high}).drop(*[f"__{x}{k}" for x in "fl" for k in range(n)])


def remove_repeats(batch: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, with_row: bool = False) -> DataFrame:
    """Every row's n_words, n_removed and kept_sha256 (and kept text, and ``row``: all columns but the text), and the batch added to the index.

    A word goes if a window that covers it also starts in a document with a smaller id, of the batch or of the batches that
    the index holds.  Windows are judged on whole input texts.  Within one document nothing goes.
    Earlier results don't change: batches should come by rising id, as ``ingest`` gives them.

    Null texts have no words; texts shorter than a window keep all.  A null id is compared with none and
    keeps all.  Rows repeated with one id are one document to each other, and each has the result of its own text.  An empty
    table gives an empty result.
    """
    spark, p = batch.sparkSession, index.params
    small_batches(spark)
    docs = batch.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    carried = ["row"] * with_row
    if with_row:
        whole = F.struct(*[F.col(f"`{c}`") for c in batch.columns if c != text_col]).alias("row")
        docs = batch.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), whole)

    def typed(ddl: str) -> StructType:
        out = StructType.fromDDL(ddl)
        return StructType([*out.fields, *[docs.schema[c] for c in carried]])

    digests = cut(_digests(docs.select("doc_id", "text"), p).where(f"doc_id is not null and n_words >= {p.width}"))
    # Of documents with the same words only the one of least id is looked at: the others' windows are all in it.
    marked = cut(with_least(digests, "same", "doc_id", "rep").select("doc_id", "same", "rep", "anchors"))
    discard(digests)
    rows = marked.where("doc_id = rep").select("doc_id", F.explode("anchors").alias("anchor"))
    older = index.runs("anchors")
    own = index.write("anchors", rows.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")))
    met = _with_older(own, older, ["anchor"]).where("least(first, old_first) < greatest(last, old_last)")
    # single: the earlier document that was the only one with the anchor, so that its windows are in no run yet
    shared = cut(met.select("anchor", F.expr("case when old_first = old_last then old_first end").alias("single")))
    index.compact("anchors")
    # Documents with shared anchors, and which these are: a document's list is no longer than the document.
    lists = rows.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("shared"))
    copies = marked.where("rep < doc_id").groupBy("doc_id").agg(F.collect_set("same").alias("copies"))

    def split(batches):
        """The result of documents without shared anchors; texts are kept for the others and for later batches."""
        for b in batches:
            sizes, removed, sums, on, copied = [], [], [], [], []
            for t, some, same in zip(*(b.column(n).to_pylist() for n in ("text", "shared", "copies")), strict=True):
                w = words(t)
                joined = b" ".join(w)
                copy = bool(same) and len(w) >= p.width and xxhash.xxh3_128_digest(joined) in same
                sizes.append(len(w))
                removed.append(len(w) if copy else 0)
                sums.append(None if some and not copy else hashlib.sha256(b"" if copy else joined).hexdigest())
                on.append(t if not copy and (with_text or len(w) >= p.width) else None)
                copied.append(copy)
            yield batch_of(["doc_id", "n_words", "n_removed", "kept_sha256", "text", "is_copy", "shared", *carried], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), None, *[None for _ in carried]], [b.column("doc_id"), sizes, removed, sums, on, copied, b.column("shared"), *[b.column(c) for c in carried]])

    known_of = docs.join(lists.join(copies, "doc_id", "full"), "doc_id", "left").select("doc_id", "text", "shared", "copies", *carried)
    history = index.runs("texts")
    staged = index.write("texts", known_of.mapInArrow(split, typed("doc_id long, n_words long, n_removed long, kept_sha256 string, text string, is_copy boolean, shared array<long>")))

    def emit(batches):
        hashes = WordHashes()
        for b in batches:
            ids, a, c = [], [], []
            for i, t, some in zip(*(b.column(n).to_pylist() for n in ("doc_id", "text", "shared")), strict=True):
                low, high = hashes.both(words(t))
                hit = np.isin(anchors(low, p), np.array(some, np.int64).view(U))
                pair = np.unique(np.stack([runs(low, p.width)[hit], runs(high, p.width)[hit]]), axis=1)
                ids.append(np.full(pair.shape[1], i, np.int64))
                a.append(pair[0].view(np.int64))
                c.append(pair[1].view(np.int64))
            none = np.zeros(0, np.int64)
            yield batch_of(["doc_id", "w1", "w2"], [pa.int64(), pa.int64(), pa.int64()], [np.concatenate(ids or [none]), np.concatenate(a or [none]), np.concatenate(c or [none])])

    of_windows = "doc_id long, w1 long, w2 long"
    open_ones = staged.where("kept_sha256 is null")
    seen = cut(open_ones.select("doc_id", "text", "shared").mapInArrow(emit, of_windows))
    found = seen
    if history:
        # Earlier texts aren't shuffled: they are read by bucket and met with the few ids that are asked for.
        asked = shared.where("single is not null").groupBy(F.col("single").alias("doc_id")).agg(F.collect_set("anchor").alias("shared"))
        for past in history:
            again = past.where(f"text is not null and n_words >= {p.width} and doc_id is not null").select("doc_id", "text").join(asked.hint("shuffle_hash"), "doc_id")
            found = found.unionByName(again.select("doc_id", "text", "shared").mapInArrow(emit, of_windows))
    earlier = index.runs("windows")
    new = index.write("windows", found.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")))
    repeated = _with_older(new, earlier, ["w1", "w2"]).where("least(first, old_first) < greatest(last, old_last)")
    least = repeated.select("w1", "w2", F.least("first", "old_first").alias("first"))
    hits = cut(seen.join(least, ["w1", "w2"]).where("doc_id > first").groupBy("doc_id").agg(F.collect_set("w1").alias("gone")))
    index.compact("windows")
    discard(marked, shared, seen)
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text"] * with_text
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.string()] * with_text

    def finish(batches):
        hashes = WordHashes()
        for b in batches:
            cols: list[list] = [[] for _ in names[1:]]
            for t, gone in zip(b.column("text").to_pylist(), b.column("gone").to_pylist(), strict=True):
                w = words(t)
                n = len(w)
                if gone:
                    one = runs(hashes(w), p.width)
                    held = covered(np.nonzero(np.isin(one, np.array(gone, np.int64).view(U)))[0], n, p.width)
                    w = [w[k] for k in np.nonzero(~held)[0]]
                kept = b" ".join(w)
                row = [n, n - len(w), hashlib.sha256(kept).hexdigest()] + [kept.decode("utf-8", "surrogatepass") if gone else t] * with_text
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            yield batch_of(names + carried, types + [None for _ in carried], [b.column("doc_id"), *cols, *[b.column(c) for c in carried]])

    schema = typed("doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text)
    rest = open_ones.select("doc_id", "text", *carried).join(hits.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "gone", *carried).mapInArrow(finish, schema)
    kept = F.when(F.col("is_copy"), F.lit("")).otherwise(F.col("text")).alias("text")
    done = staged.where("kept_sha256 is not null").select(*names[:4], *[kept] * with_text, *carried)
    return done.unionByName(rest)


def ingest(docs: DataFrame, index: Index, batches: int = 3, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, with_row: bool = False) -> DataFrame:
    """remove_repeats of a whole table, taken in batches of about equal numbers of rows by rising id.

    Null ids go with the first batch.  Each batch is met with the runs of those before; what is written and shuffled
    at a time is that of one batch.
    """
    key = F.col(id_col).cast("long")
    at = docs.select(F.percentile_approx(key, [k / batches for k in range(1, batches)], 10_000).alias("at")).first()["at"] if batches > 1 else None
    bounds = sorted(set(at or []))
    parts, low = [], None
    for high in [*bounds, None]:
        own = F.lit(True) if low is None else key >= low
        own = own if high is None else own & (key < high)
        parts.append(docs.where(own if low is not None else own | key.isNull()))
        low = high
    return reduce(DataFrame.unionByName, [remove_repeats(part, index, id_col, text_col, with_text, with_row) for part in parts])
