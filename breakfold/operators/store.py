"""The variant store: one row per call and carrier sample, appended as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breakfold.functions.parsing import ci_columns
from breakfold.operators import staging

COLUMNS = ["var", "chrA", "chrB", "posA", "ci_A_lower", "ci_A_upper", "posB", "ci_B_lower", "ci_B_upper", "sample", "idx"]
SCHEMA = "var string, chrA string, chrB string, posA long, ci_A_lower long, ci_A_upper long, posB long, ci_B_lower long, ci_B_upper long, sample string, idx long"
#: Genotypes that don't make a sample a carrier when a store is built.
NOT_CARRIED = ("0/0", "./.")
PASSING = ("PASS", ".")


def pass_filter(calls: DataFrame) -> DataFrame:
    return calls.where(F.col("filter").isin(*PASSING))


def carriers(calls: DataFrame, pass_only: bool = False) -> DataFrame:
    """A row per call and carrier sample, in source, line and sample order.

    calls: parsed calls with source_ord, line_no, sample_names and source_sample.  A call without genotypes
    is carried by its file's own sample; so is each call of a file whose FORMAT has no GT.
    """
    if pass_only:
        calls = pass_filter(calls)
    at = F.array_position(F.split("fmt", ":"), "GT").cast("int")
    gt = F.transform("samples", lambda s: F.coalesce(F.get(F.split(s, ":"), at - 1), F.lit(".")))
    gtless = F.coalesce(at < 1, F.lit(True)) | (F.size("samples") == 0)
    named = F.transform("samples", lambda s, i: F.struct(i.alias("n"), F.coalesce(F.get("sample_names", i), F.col("source_sample")).alias("sample"), F.get(gt, i).alias("gt")))
    whole = F.array(F.struct(F.lit(0).alias("n"), F.col("source_sample").alias("sample"), F.lit("").alias("gt")))
    rows = calls.withColumn("__c", F.explode(F.when(gtless, whole).otherwise(F.filter(named, lambda x: ~x["gt"].isin(*NOT_CARRIED)))))
    return rows.select(F.col("event_type").alias("var"), "chrA", "chrB", "posA", *ci_columns(F.col("info"))[:2], "posB", *ci_columns(F.col("info"))[2:], F.col("__c.sample").alias("sample"), "source_ord", "line_no", F.col("__c.n").alias("sample_pos"))


def numbered(rows: DataFrame, first: int = 0, order: tuple = ("source_ord", "line_no", "sample_pos")) -> DataFrame:
    """rows with idx counted on from ``first`` in the given order, without gathering them in one task."""
    return staging.numbered(rows, list(order), "idx", first)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def max_idx(store: DataFrame) -> DataFrame:
    return store.agg(F.max("idx").alias("max_idx"))


def new_samples(rows: DataFrame, store: DataFrame, sample: str = "sample") -> DataFrame:
    """rows of samples that the store doesn't hold."""
    return rows.join(store.select(F.col("sample").alias("__s")).distinct(), F.col(sample) == F.col("__s"), "left_anti")


def append(spark: SparkSession, path: str, calls: DataFrame, pass_only: bool = False) -> None:
    """Adds the calls' carriers to the store, numbered on; files whose own sample is stored already are left out."""
    first = 0
    if exists(spark, path):
        held = spark.read.schema(SCHEMA).parquet(path)
        first = (max_idx(held).first()[0] + 1) if held.take(1) else 0
        calls = new_samples(calls, held, "source_sample")
    rows = numbered(carriers(calls, pass_only), first)
    rows.select(*COLUMNS).repartition("chrA").sortWithinPartitions("var", "chrA", "chrB", "posA", "posB").write.mode("append").parquet(path)


def scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def tables(spark: SparkSession, path: str) -> list[str]:
    return [path] if exists(spark, path) else []


def column(df: DataFrame, name: str) -> list:
    """One column's values on the driver; for small results only."""
    return [r[0] for r in df.select(name).collect()]


def db_size(store: DataFrame) -> DataFrame:
    return store.agg(F.count_distinct("sample").alias("n"))


def distinct_values(store: DataFrame, name: str) -> DataFrame:
    return store.select(name).distinct()


def by_index(store: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose idx is among the ids."""
    return store.join(ids.select(F.col("idx").alias("__i")).distinct(), F.col("idx") == F.col("__i"), "left_semi")


def partition_rows(store: DataFrame, var: str, chr_a: str, chr_b: str) -> DataFrame:
    return store.where((F.col("var") == var) & (F.col("chrA") == chr_a) & (F.col("chrB") == chr_b))


