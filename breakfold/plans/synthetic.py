"""Calls derived from the order table: the same expressions make them here and in the SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

K, C = "CAST(o_orderkey AS BIGINT)", "CAST(o_custkey AS BIGINT)"
#: Step by step; each dictionary may use the columns of those before.
STEPS = [
    {"k": K, "c": C, "status": "o_orderstatus"},
    {
        "idx": "k",
        "sample": "'S' || CAST(c % 40 AS STRING)",
        "var": "CASE WHEN k % 10 <= 4 THEN 'DEL' WHEN k % 10 <= 6 THEN 'DUP' WHEN k % 10 = 7 THEN 'INS' WHEN k % 10 = 8 THEN 'INV' ELSE 'BND' END",
        "n1": "1 + (c * 31 + k * 7) % 22",
        "pa": "100000 + ((k * 7919) % 200) * 50000 + (c * 37) % 900",
        "gt": "CASE c % 4 WHEN 0 THEN '0/0' WHEN 1 THEN '0/1' WHEN 2 THEN '1/1' ELSE './.' END",
        "filter": "CASE status WHEN 'F' THEN 'PASS' WHEN 'O' THEN '.' ELSE 'LowQual' END",
    },
    {"n2": "CASE WHEN var = 'BND' THEN 1 + (n1 + c) % 22 ELSE n1 END", "pb": "CASE WHEN var = 'INS' THEN pa ELSE pa + 2000 + (k * 13 % 7) * 1000 + c % 300 END"},
    {"s1": "CAST(n1 AS STRING)", "s2": "CAST(n2 AS STRING)"},
    {
        "chrA": "CASE WHEN s1 > s2 THEN s2 ELSE s1 END",
        "chrB": "CASE WHEN s1 > s2 THEN s1 ELSE s2 END",
        "posA": "CASE WHEN s1 > s2 THEN pb ELSE pa END",
        "posB": "CASE WHEN s1 > s2 THEN pa ELSE pb END",
    },
]
_SPLIT = "CAST(k AS STRING) || ':x;' || CAST(c AS STRING)"
#: One line of VCF text a call, in eight styles.
LINE = {
    "line": f"""CASE k % 8 WHEN 1 THEN 'Chr' WHEN 2 THEN '' ELSE 'chr' END || s1 || chr(9) || CAST(pa AS STRING) || chr(9) || {_SPLIT} || chr(9) || 'N' || chr(9) ||
    CASE WHEN var = 'BND' AND k % 3 = 0 THEN 'N[chr' || s2 || ':' || CAST(pb AS STRING) || '[' WHEN var = 'BND' AND k % 3 = 1 THEN ']]' || s2 || ':' || CAST(pb AS STRING) || ']]N' WHEN var = 'BND' THEN '<TRA>'
         WHEN k % 8 = 4 AND var = 'DUP' THEN '<DUP:TANDEM>' WHEN k % 8 = 5 AND var = 'INS' THEN 'NACGTACGT' WHEN k % 8 = 6 THEN '.' ELSE '<' || var || '>' END
    || chr(9) || '.' || chr(9) || filter || chr(9) ||
    CASE WHEN var = 'BND' THEN 'CHR2=' || s2 || ';END=' || CAST(pb AS STRING) WHEN k % 8 = 3 THEN 'SVLEN=-' || CAST(pb - pa AS STRING) ELSE 'SVLEN=1;END=' || CAST(pb AS STRING) END
    || ';SVTYPE=' || var || ';IMPRECISE;NOTE=a=b' || CASE WHEN c % 2 = 0 THEN ';CIPOS=(-' || CAST(c % 50 AS STRING) || ',' || CAST(c % 70 AS STRING) || ')' ELSE '' END
    || CASE WHEN c % 3 = 0 THEN ';CIEND=-' || CAST(c % 30 AS STRING) ELSE '' END
    || chr(9) || CASE WHEN k % 2 = 0 THEN 'GT:CN:DP' ELSE 'GT:DP' END || chr(9) || gt || ':' || CAST(c % 5 AS STRING)"""
}
#: The three sources of the merge queries, in order of priority.
SOURCES = ["alpha", "beta", "gamma"]


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:  # a file of one row group is one task otherwise
        df = df.repartition(cores)
    for step in STEPS:
        df = df.withColumns({name: F.expr(e) for name, e in step.items()})
    return df.select("idx", "sample", "var", "chrA", "posA", "chrB", "posB", "gt", "filter", "k", "c", "s1", "s2", "pa", "pb")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).select("k", *[F.expr(e.replace("chr(", "char(")).alias(n) for n, e in LINE.items()])


def merge_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls as three sources' records for merging."""
    df = calls(spark, sf_dir)
    ord_ = (F.col("c") % 3).cast("int")
    s = lambda c: F.col(c).cast("string")
    return df.select(
        F.col("k").alias("call_id"), F.element_at(F.lit(SOURCES).cast("array<string>"), ord_ + 1).alias("source"), ord_.alias("source_ord"), F.col("k").alias("line_no"), F.col("var").alias("event_type"), "chrA", "chrB", "posA", "posB", "filter",
        F.concat(F.lit("v"), s("k")).alias("vid"), F.col("s1").alias("raw_chrom"), s("pa").alias("raw_pos"), F.lit("N").alias("ref"), F.concat(F.lit("<"), "var", F.lit(">")).alias("alt"), F.lit(".").alias("qual"),
        F.concat(F.lit("SVTYPE="), "var", F.lit(";END="), s("pb"), F.lit(";T"), ord_.cast("string"), F.lit("="), (F.col("c") % 7).cast("string"), F.lit(";ANY="), s("k")).alias("info"),
        F.when(F.col("k") % 2 == 0, "GT:CN").otherwise("GT:DP").alias("fmt"), F.array(F.concat("gt", F.lit(":"), (F.col("c") % 5).cast("string"))).alias("samples"), F.array(F.concat(F.lit("P"), ord_.cast("string"))).alias("sample_names"),
    )


def _cte(steps: list[dict]) -> str:
    out, last = [], "orders"
    for n, step in enumerate(steps):
        items = ", ".join(f'{e} AS "{name}"' for name, e in step.items())
        out.append(f"s_{n} AS (SELECT {'*, ' if n else ''}{items} FROM {last})")
        last = f"s_{n}"
    return ", ".join(out) + f", calls AS (SELECT * FROM {last})"


CALLS_CTE = _cte(STEPS)
LINES_CTE = _cte([*STEPS, LINE])
