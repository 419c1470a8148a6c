"""Intermediate tables and counting over all rows, without one task that sees them all."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Folders by application, deleted when the driver ends: results are lazy and read them until then.
_FOLDERS: dict[str, str] = {}


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _end(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except (Py4JError, OSError, AttributeError):
        pass  # the session was stopped first


def folder(spark: SparkSession) -> str:
    """This application's folder in the checkpoint folder that the session names; a temporary one only in local mode."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        _FOLDERS[app] = f"{shared or tempfile.mkdtemp(prefix='staged-')}/staged-{app}"
        atexit.register(_end, spark, _FOLDERS[app])
    return _FOLDERS[app]


def staged(df: DataFrame) -> DataFrame:
    """df as it is now, written as Parquet and read again, so that whatever runs again sees the same rows."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def numbered(rows: DataFrame, order: list, name: str, first: int = 0) -> DataFrame:
    """rows with ``name`` counted on from ``first`` in the given order, gapless.

    Rows are sorted by ranges and written once with their range and place in it; ranges are sampled anew each time a plan
    runs, so counts and numbers must come from the same copy.  Each range starts behind those before it.  What is sorted is
    itself a written copy, as sampling runs the plan once more.
    """
    first_copy = vars(rows).get("staged_path")
    source = rows if first_copy else staged(rows)
    ranged = source.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = staged(ranged.withColumns({"__p": F.spark_partition_id(), "__m": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    if not first_copy:
        _delete(rows.sparkSession, source.staged_path)
    sizes = kept.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    starts = sizes.select("__p", (F.coalesce(before, F.lit(0)) + first).alias("__start"))
    return kept.join(F.broadcast(starts), "__p").withColumn(name, F.col("__m") + F.col("__start")).drop("__p", "__m", "__start")


def in_chunks(rows: DataFrame, part: list[str], order: list[str], reach: int, size: int = 1 << 16) -> DataFrame:
    """rows in chunks of ``size`` by (part, order), each with the ``reach`` rows on either side of it.

    __n is the row's number, __chunk the chunk and __home whether the row is the chunk's own and not a copy.  A window by
    (__chunk, part) in the order of __n sees what a window by part would see up to ``reach`` rows away, and
    never more than size + 2 * reach rows.
    """
    size = max(size, 2 * reach + 1)
    own = F.col("__own")
    out = numbered(rows, [*part, *order], "__n").withColumn("__own", F.floor(F.col("__n") / size))
    at = F.col("__n") % size
    copies = F.array_compact(F.array(own, F.when((at < reach) & (own > 0), own - 1), F.when(at >= size - reach, own + 1)))
    return out.withColumn("__chunk", F.explode(copies)).withColumn("__home", F.col("__chunk") == own).drop("__own")


def running_count(chunked: DataFrame, part: list[str], flag: str, name: str) -> DataFrame:
    """chunked with ``name``: how many rows of the part up to this one have the flag, counted from copies' places too.

    In a chunk it is a window; what the chunks before hold of the same part is a table of a row per chunk and part.
    """
    one = F.when(F.col("__home") & F.col(flag), 1).otherwise(0)
    local = Window.partitionBy("__chunk", *part).orderBy("__n").rowsBetween(Window.unboundedPreceding, 0)
    totals = chunked.groupBy("__chunk", *part).agg(F.sum(one).alias("__t"))
    before = Window.partitionBy(*part).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("__chunk", *part, F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__base"))
    keys = ["__chunk", *part]
    bases = bases.withColumnsRenamed({k: f"__b_{k}" for k in keys})
    joined = chunked.withColumn("__local", F.sum(one).over(local)).join(bases, [F.col(k).eqNullSafe(F.col(f"__b_{k}")) for k in keys])
    return joined.withColumn(name, F.col("__local") + F.col("__base")).drop("__local", "__base", *[f"__b_{k}" for k in keys])
