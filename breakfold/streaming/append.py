"""Growing a store from a folder of arriving call sets, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from breakfold.functions.parsing import parse_calls
from breakfold.operators import store


def lines_stream(spark: SparkSession, folder: str, most_files: int = 1000) -> DataFrame:
    """Lines of files that arrive in a folder: line, path; a micro-batch takes ``most_files`` of them at most."""
    return spark.readStream.schema("value string").option("maxFilesPerTrigger", most_files).text(folder).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"))


def append_arriving(spark: SparkSession, folder: str, path: str, checkpoint: str, pass_only: bool = False, once: bool = True) -> StreamingQuery:
    """Appends each arriving file's calls to the store; a file whose sample is stored already is left out.

    The checkpoint remembers which files were taken.  Calls are carried by their file's own sample unless their
    header named samples, which a stream of lines takes from the #CHROM line of the same file.
    """

    def take(batch: DataFrame, _: int) -> None:
        if not batch.take(1):
            return
        # Lines of one file keep their order by line_no.
        batch = batch.withColumn("line_no", F.monotonically_increasing_id())
        stem = F.replace(F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", ""), F.lit("."), F.lit("_"))
        names = batch.where(F.startswith(F.col("line"), F.lit("#CHROM"))).select(F.col("path").alias("p"), F.slice(F.split("line", r"\s+"), 10, 1_000_000).alias("sample_names"))
        # A row per file, whose number lines_stream bounds, so names may be broadcast.
        parsed = parse_calls(batch.withColumn("source_sample", stem)).where("not bad")
        rows = parsed.join(F.broadcast(names), F.col("path") == F.col("p"), "left").withColumn("source_ord", F.col("path"))
        store.append(spark, path, rows.withColumn("sample_names", F.coalesce("sample_names", F.array().cast("array<string>"))), pass_only)

    writer = lines_stream(spark, folder).writeStream.option("checkpointLocation", checkpoint).foreachBatch(take)
    return (writer.trigger(availableNow=True) if once else writer).start()
