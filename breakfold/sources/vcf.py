"""VCF and BEDPE text: sources, header model, sinks."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breakfold.functions.parsing import parse_calls


def source_tag(path: str) -> str:
    return path.split(".vcf")[0].split("/")[-1]


def file_sample(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[0].replace(".", "_")


def folder_files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of plain, then gzipped VCF files in a folder of any file system Spark reads, sorted by name."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(str(f.getPath().toString()) for f in fs.listStatus(p)) if fs.exists(p) else []
    return [n for n in names if n.endswith(".vcf")] + [n for n in names if n.endswith(".vcf.gz")]


def existing(spark: SparkSession, paths: Iterable[str]) -> list[str]:
    """The paths that exist, in order."""
    jvm = spark._jvm

    def there(path):
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    return [p for p in paths if there(p)]


def read_lines(spark: SparkSession, path: str, source_ord: int = 0, tag: str | None = None) -> DataFrame:
    """Lines of one file (gzip by its suffix): line, line_no, source, source_ord, source_sample.

    line_no grows with the place in the file; it is not dense.
    """
    df = spark.read.text(path).withColumnRenamed("value", "line")
    return df.select("line", F.monotonically_increasing_id().alias("line_no"), F.lit(tag or source_tag(path)).alias("source"), F.lit(source_ord).alias("source_ord"), F.lit(file_sample(path)).alias("source_sample"))


def header_lines(spark: SparkSession, path: str) -> list[str]:
    """The header of one file, in order; headers are small."""
    df = spark.read.text(path).where(F.col("value").startswith("#")).withColumn("n", F.monotonically_increasing_id())
    return [r.value.rstrip() for r in df.orderBy("n").collect()]


def sample_names(header: list[str]) -> list[str]:
    """Sample columns of the #CHROM line; none if it has no samples."""
    for line in header:
        if "CHROM" in line and line.startswith("#") and not line.startswith("##"):
            return line.split()[9:]
    return []


def read_calls(spark: SparkSession, paths: list[str], tags: list[str] | None = None) -> DataFrame:
    """Parsed calls of several files in order, with call_id and sample_names; missing files are left out."""
    there = existing(spark, paths)
    if not there:
        raise FileNotFoundError("none of the files exists")
    out = None
    for n, path in enumerate(there):
        tag = dict(zip(paths, tags, strict=True))[path] if tags else None
        names = sample_names(header_lines(spark, path))
        df = parse_calls(read_lines(spark, path, n, tag)).withColumn("sample_names", F.lit(names).cast("array<string>"))
        out = df if out is None else out.unionByName(df)
    return out.where("not bad").withColumn("call_id", F.col("source_ord").cast("long") * F.lit(1 << 52) + F.col("line_no"))


def read_bedpe(spark: SparkSession, path: str, normalize: bool = False) -> DataFrame:
    """chrA, posA, chrB, posB, event_type, occ, frq, db_ord; oriented by chromosome, then position.  Chromosome names stay as they are."""
    from breakfold.functions.parsing import normalize_chrom

    t = spark.read.text(path).withColumn("db_ord", F.monotonically_increasing_id())
    return parse_bedpe(t.withColumnRenamed("value", "line"), normalize_chrom if normalize else (lambda c: c))


def parse_bedpe(lines: DataFrame, chrom=lambda c: c) -> DataFrame:
    c = F.split(F.regexp_replace("line", r"^\s+|\s+$", ""), r"\s+")
    rows = lines.where(~F.startswith(F.col("line"), F.lit("#")) & (F.length(F.trim("line")) > 0))
    rows = rows.select("db_ord", chrom(c[0]).alias("a"), c[1].try_cast("long").alias("p"), chrom(c[2]).alias("b"), c[3].try_cast("long").alias("q"), c[4].alias("event_type"), c[5].try_cast("double").cast("long").alias("occ"), c[6].try_cast("double").alias("frq"))
    keep = ((F.col("a") == F.col("b")) & (F.col("p") < F.col("q"))) | (F.col("a") < F.col("b"))
    pick = lambda x, y: F.when(keep, F.col(x)).otherwise(F.col(y))
    return rows.select(pick("a", "b").alias("chrA"), pick("p", "q").alias("posA"), pick("b", "a").alias("chrB"), pick("q", "p").alias("posB"), "event_type", "occ", "frq", "db_ord")


def write_lines(lines: DataFrame, header: list[str], path: str, order: list) -> None:
    """One text file's parts in a folder: the header first, then the lines in order."""
    spark = lines.sparkSession
    head = spark.createDataFrame([(n, h) for n, h in enumerate(header)], "n int, line string")
    head.orderBy("n").select("line").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    lines.orderBy(*order).select("line").write.mode("overwrite").text(f"{path}/body")


#: Header lines of an export.
EXPORT_HEADER = (
    "##fileformat=VCFv4.1",
    '##ALT=<ID=DEL,Description="Deletion">',
    '##ALT=<ID=DUP,Description="Duplication">',
    '##ALT=<ID=INS,Description="Insertion">',
    '##ALT=<ID=INV,Description="Inversion">',
    '##ALT=<ID=BND,Description="Break end">',
    '##INFO=<ID=SVTYPE,Number=1,Type=String,Description="Type of structural variant">',
    '##INFO=<ID=END,Number=1,Type=Integer,Description="End of the variant">',
    '##INFO=<ID=SVLEN,Number=1,Type=Integer,Description="Length of the variant">',
    '##INFO=<ID=NSAMPLES,Number=1,Type=Integer,Description="Samples in the store">',
    '##INFO=<ID=OCC,Number=1,Type=Integer,Description="Samples with the variant">',
    '##INFO=<ID=FRQ,Number=1,Type=Float,Description="Share of samples with the variant">',
    '##INFO=<ID=CIPOS,Number=2,Type=Integer,Description="Span around POS">',
    '##INFO=<ID=CIEND,Number=2,Type=Integer,Description="Span around END">',
    '##INFO=<ID=VARIANTS,Number=1,Type=String,Description="Members as sample:POS:END">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
)


def export_header(samples: list[str]) -> list[str]:
    return [*EXPORT_HEADER, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]


def query_header(header: list[str], occ_tag: str = "OCC", frq_tag: str = "FRQ") -> list[str]:
    """A header with the two tags' lines, once, behind the last INFO line or before #CHROM."""
    have = "\n".join(header)
    new = [f'##INFO=<ID={t},Number=1,Type={kind},Description="{what}">' for t, kind, what in ((occ_tag, "Integer", "The number of occurrences of the event in the database"), (frq_tag, "Float", "The frequency of the event in the database")) if f"<ID={t}," not in have]
    infos = [n for n, h in enumerate(header) if h.startswith("##INFO")]
    at = infos[-1] + 1 if infos else next((n for n, h in enumerate(header) if h.startswith("#CHROM")), len(header))
    return header[:at] + new + header[at:]


class Headers:
    """The union of several files' headers."""

    def __init__(self, headers: dict[str, list[str]]):
        """headers: source tag to lines, in file order.  The last line of an ID wins; contigs come from the first file that has them."""
        self.kinds: dict[str, dict[str, str]] = {k: {} for k in ("ALT", "INFO", "FILTER", "FORMAT")}
        self.contigs: dict[str, str] = {}
        self.other: dict[str, str] = {}
        self.reference = ""
        self.samples: list[str] = []
        self.order: dict[str, dict[str, int]] = {}
        for tag, lines in headers.items():
            own_contigs = {}
            for line in lines:
                m = re.match(r"##(\w+)=<ID=([^,>]+)", line)
                if line.startswith("#CHROM"):
                    for pos, name in enumerate(line.split("\t")[9:]):
                        if name not in self.samples:
                            self.samples.append(name)
                        self.order.setdefault(name, {})[tag] = pos
                elif m and m[1] in self.kinds:
                    if not (m[1] == "INFO" and m[2] in ("VARID", "set")):
                        self.kinds[m[1]][m[2]] = line
                elif m and m[1] == "contig":
                    own_contigs[m[2]] = line
                elif line.startswith("##reference"):
                    self.reference = self.reference or line
                elif not re.match(r"##(source|file)", line):
                    self.other.setdefault(line.split("=", 1)[0], line)
            self.contigs = self.contigs or own_contigs

    def merged(self, tags: list[str], no_tag: bool = False, command: str = "", origin_tag: str = "origin") -> list[str]:
        by_id = lambda k: [self.kinds[k][i] for i in sorted(self.kinds[k])]
        info = lambda i, n, t, d: f'##INFO=<ID={i},Number={n},Type={t},Description="{d}">'
        out = ["##fileformat=VCFv4.1", "##source=MergedCalls", *by_id("ALT"), *by_id("INFO")]
        for t in tags:
            out += [info(f"{t}_{x}", ".", "String", f"{x} of the calls of {t} as id|value") for x in ("CHROM", "POS", "QUAL", "FILTERS", "SAMPLE", "INFO")]
        out.append(info("SUPP_VEC", 1, "String", "Support by source, in the order " + ",".join(sorted(tags))))
        out += [self.reference] * bool(self.reference) + list(self.contigs.values()) + by_id("FILTER") + by_id("FORMAT") + [self.other[k] for k in sorted(self.other)]
        if not no_tag:
            out += [info("VARID", 1, "String", "Merged calls"), info("set", 1, "String", "Sources of the call"), info("FOUNDBY", 1, "Integer", "Number of sources"), info(origin_tag, 1, "String", "Sources in order")]
        out += [f"##merge_command={command}"] * bool(command)
        return [*out, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *self.samples])]
