"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a temporary one only where none is set and driver and executors are one process."""
    if not spark.sparkContext.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return spark.sparkContext.getCheckpointDir()


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Folders of intermediate tables by application, deleted when the driver ends: results are lazy, so the last tables must stay until then.
_FOLDERS: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """This application's folder of intermediate tables in the shared folder."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = f"{checkpoint_dir(spark)}/work-{app}"
        atexit.register(_end, spark, _FOLDERS[app])
    return _FOLDERS[app]


def _end(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except (Py4JError, OSError, AttributeError):
        pass  # the session was stopped first; its shared folder is the cluster's to clean


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: written as Parquet to the shared checkpoint folder and read again.

    Shuffle files of the jobs behind it aren't needed any more; a collection lets Spark's cleaner drop them.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    del df
    gc.collect()
    spark._jvm.System.gc()
    return out


def give_back() -> None:
    """Returns memory that the driver's Python no longer uses to the system, where the C library can."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def discard(*tables: DataFrame) -> None:
    """Deletes what ``cut`` wrote for tables that no later step reads."""
    for df in tables:
        delete(df.sparkSession, df.cut_path)


#: Bounds of an Arrow batch, the same for all operators: plans are lazy and read them when they run.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded rows and bytes: whole texts can be long, and a batch is held in memory at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def with_least(rows: DataFrame, key: str, value: str, name: str, salts: int = 16) -> DataFrame:
    """rows with the least ``value`` of their key as ``name``; rows of a hot key are dealt over ``salts`` tasks.

    Nulls in key or value match nothing: such rows go.
    """
    rows = rows.withColumn("__s", F.pmod(F.xxhash64(value), F.lit(salts)).cast("int")).where(F.col(key).isNotNull() & F.col(value).isNotNull())
    parts = rows.groupBy(key, "__s").agg(F.min(value).alias("__m"))
    whole = parts.groupBy(key).agg(F.min("__m").alias(name), F.expr("bit_or(shiftleft(1L, __s))").alias("__p"))
    spread = whole.select(key, name, F.explode(F.expr(f"filter(sequence(0, {salts - 1}), b -> (shiftright(__p, b) & 1) = 1)")).alias("__s"))
    # The same join at every size: a broadcast that small tables get would hide what large ones send.
    return rows.join(spread.hint("merge"), [key, "__s"]).drop("__s")


def without_blanks(text: Column) -> Column:
    """text less every character of BLANKS; plain replacements are cheaper than one regular expression."""
    for c in BLANKS:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def batch_of(names: list[str], types: list[pa.DataType], columns: list) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=t) for c, t in zip(columns, types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=names)


#: A pre-token that holds white space starts with it, so texts part before every run of white space that follows something else.
_CHUNKS = regex.compile(r"\s*\S+|\s+").findall
_ADJACENT = regex.compile(r" \s|\s ").search


class ChunkEncoder:
    """Token ids of texts through a memo of chunks that end before white space.

    In the byte-level pattern white space stands only at the start of a pre-token or makes up
    all of it.  So a text may be cut before each run of white space, and the ids of the chunks in a
    row are the ids of the text.  Texts in which no space has white space beside it are cut at single spaces, which is faster
    and as right; other white space stays inside chunks there.
    The memo holds chunks of up to ``longest`` characters and is dropped when it holds ``most`` of them,
    so its memory is bounded; longer chunks are encoded each time.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 400_000, longest: int = 48):
        self.encode, self.most, self.longest = encode, most, longest
        self.clear()

    def clear(self) -> None:
        self.memo: dict[str, int] = {}
        self.n = 0
        self.off, self.len = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids, self.end = np.zeros(4096, np.uint32), 0

    @staticmethod
    def chunks(text: str) -> list[str]:
        if not text:
            return []
        if _ADJACENT(text):
            return _CHUNKS(text)
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + x for x in rest]

    def _learn(self, new: list[str]) -> None:
        flat, sizes = self.encode(new)
        while self.n + len(new) > len(self.off):
            self.off, self.len = np.concatenate((self.off, self.off)), np.concatenate((self.len, self.len))
        if self.end + len(flat) > len(self.ids):
            grown = np.zeros(max(2 * len(self.ids), self.end + len(flat)), np.uint32)
            grown[: self.end] = self.ids[: self.end]
            self.ids = grown
        self.ids[self.end : self.end + len(flat)] = flat
        self.off[self.n : self.n + len(new)] = self.end + np.cumsum(sizes) - sizes
        self.len[self.n : self.n + len(new)] = sizes
        self.memo.update(zip(new, range(self.n, self.n + len(new)), strict=True))
        self.n += len(new)
        self.end += len(flat)

    def texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        step = 256
        for at in range(0, len(texts), step):
            parts = [self.chunks(x) for x in texts[at : at + step]]
            if self.n >= self.most:
                self.clear()
            known, longest = self.memo, self.longest
            new = list({c for p in parts for c in p if c not in known})
            kept = [c for c in new if len(c) <= longest]
            if kept:
                self._learn(kept)
            mark = self.n, self.end
            long = [c for c in new if len(c) > longest]
            if long:
                self._learn(long)
            counts = [len(p) for p in parts]
            k = np.fromiter((known[c] for p in parts for c in p), np.int64, sum(counts))
            lens = self.len[k]
            ends = np.cumsum(lens)
            flat = self.ids[np.repeat(self.off[k] - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)]
            bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
            for c in long:  # learned last, for these texts only
                del known[c]
            self.n, self.end = mark
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                yield flat[a:b]


def read_file(path: str) -> bytes:
    """A vocabulary file, read on the driver and sent to executors as bytes: its size is fixed."""
    with open(os.fspath(path), "rb") as f:
        return f.read()
