"""Command line: build, query, export and merge."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from breakfold.operators import annotate, export, merge, store
from breakfold.sources import vcf

log = logging.getLogger("breakfold")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="breakfold")
    top.add_argument("--debug", action="store_true")
    sub = top.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="append call sets to a store")
    g = b.add_mutually_exclusive_group(required=True)
    g.add_argument("--files", nargs="+")
    g.add_argument("--folder")
    b.add_argument("--passonly", action="store_true")
    b.add_argument("--prefix", default="store")
    q = sub.add_parser("query", help="annotate calls with occurrence and frequency")
    q.add_argument("--query_vcf", required=True)
    for kind in ("db", "table", "bedpe"):
        q.add_argument(f"--{kind}", help="one or more, parted by commas")
    for name in ("in_occ", "in_frq"):
        q.add_argument(f"--{name}")
    q.add_argument("--out_occ", default="OCC")
    q.add_argument("--out_frq", default="FRQ")
    q.add_argument("--max_frq", type=float, default=1.0)
    q.add_argument("--prefix")
    q.add_argument("--bnd_distance", type=int, default=10_000)
    q.add_argument("--ins_distance", type=int, default=50)
    q.add_argument("--overlap", type=float, default=0.6)
    q.add_argument("--memory", action="store_true", help="cache the database")
    q.add_argument("--no_var", action="store_true")
    e = sub.add_parser("export", help="cluster a store's calls")
    e.add_argument("--db", required=True)
    e.add_argument("--no_merge", action="store_true")
    e.add_argument("--bnd_distance", type=int, default=2500)
    e.add_argument("--ins_distance", type=int, default=50)
    e.add_argument("--overlap", type=float, default=0.8)
    e.add_argument("--DBSCAN", action="store_true")
    e.add_argument("--epsilon", type=int, default=500)
    e.add_argument("--min_pts", type=int, default=2)
    e.add_argument("--prefix", default="export")
    e.add_argument("--memory", action="store_true")
    m = sub.add_parser("merge", help="merge call sets")
    m.add_argument("--vcf", nargs="+", required=True)
    m.add_argument("--priority", help="tags parted by commas; files are then path:tag")
    m.add_argument("--bnd_distance", type=int, default=2000)
    m.add_argument("--ins_distance", type=int, default=50)
    m.add_argument("--overlap", type=float, default=0.95)
    for flag in ("no_intra", "no_var", "pass_only", "same_order", "notag"):
        m.add_argument(f"--{flag}", action="store_true")
    m.add_argument("--prefix")
    return top


def _emit(lines, header: list[str], prefix: str | None, order: list) -> None:
    """A folder of text parts under the prefix, or standard output, row by row."""
    if prefix:
        vcf.write_lines(lines, header, prefix, order)
        return
    print(*header, sep="\n")
    for r in lines.orderBy(*order).select("line").toLocalIterator():
        print(r.line)


def run_build(spark: SparkSession, a) -> int:
    paths = a.files or vcf.folder_files(spark, a.folder)
    if not paths:
        log.warning("no call sets found")
        return 0
    store.append(spark, a.prefix, vcf.read_calls(spark, paths), a.passonly)
    return 0


def _split(text: str | None) -> list[str]:
    return text.split(",") if text else []


def run_query(spark: SparkSession, a) -> int:
    dbs = [("db", p) for p in _split(a.db)] + [("table", p) for p in _split(a.table)] + [("bedpe", p) for p in _split(a.bedpe)]
    if not dbs:
        log.error("no database given")
        return 0
    tags = [_split(x) for x in (a.in_occ, a.in_frq, a.out_occ, a.out_frq)]
    if len(dbs) > 1 and (not a.prefix or any(len(t) != len(dbs) for t in tags[2:])):
        log.error("several databases need a prefix and as many output tags")
        return 1
    header = vcf.header_lines(spark, a.query_vcf)
    calls = vcf.read_calls(spark, [a.query_vcf]).withColumn("qid", F.col("call_id"))
    df = calls
    for n, (kind, path) in enumerate(dbs):
        occ_tag, frq_tag = tags[2][n], tags[3][n]
        header = vcf.query_header(header, occ_tag, frq_tag)
        rules = {"overlap": a.overlap, "bnd_distance": a.bnd_distance}
        if kind == "table":
            held = store.scan(spark, path)
            df = annotate.annotate_table(df, held.cache() if a.memory else held, max_frq=a.max_frq, **rules)
        else:
            rules |= {"ins_distance": a.ins_distance, "no_var": a.no_var}
            if kind == "bedpe":
                df = annotate.annotate_best(df, vcf.read_bedpe(spark, path), **rules)
            else:
                held = vcf.read_calls(spark, [path])
                held = held.cache() if a.memory else held
                if a.in_occ or a.in_frq:
                    df = annotate.annotate_best(df, annotate.tag_database(held.withColumn("db_ord", F.col("call_id")), tags[0][min(n, len(tags[0]) - 1)], tags[1][min(n, len(tags[1]) - 1)]), **rules)
                else:
                    size = max(1, len(vcf.sample_names(vcf.header_lines(spark, path))))
                    at = F.array_position(F.split("fmt", ":"), "GT").cast("int")
                    gts = F.transform("samples", lambda s: F.coalesce(F.get(F.split(s, ":"), at - 1), F.lit(".")))
                    df = annotate.annotate_genotypes(df, held.withColumn("gts", F.when(F.size("samples") > 0, gts).otherwise(F.array(F.lit("1")))), size, **rules)
        df = df.withColumn("info", annotate.info_with(F.col("info"), F.col("occ"), F.col("frq"), occ_tag, frq_tag)).drop("occ", "frq")
    line = F.concat_ws("\t", "raw_chrom", "raw_pos", "vid", "ref", "alt", "qual", "filter", "info", "fmt", F.when(F.size("samples") > 0, F.array_join("samples", "\t")))
    _emit(df.withColumn("line", line), header, a.prefix, ["call_id"])
    return 0


def run_export(spark: SparkSession, a) -> int:
    held = store.scan(spark, a.db)
    held = held.cache() if a.memory else held
    samples = store.column(store.distinct_values(held, "sample").orderBy("sample"), "sample")  # a VCF line has a column of each
    if a.no_merge:
        members = export.no_merge_members(held, a.ins_distance)
    else:
        members = export.cluster_members(held, a.overlap, a.bnd_distance, a.ins_distance, a.DBSCAN, a.epsilon, a.min_pts)
    vcf.write_lines(export.lines(members, samples), vcf.export_header(samples), a.prefix, ["ord"])
    return 0


def run_merge(spark: SparkSession, a) -> int:
    paths, tags = a.vcf, None
    if a.priority:
        paths, tags = zip(*(p.rsplit(":", 1) for p in a.vcf), strict=True)
        if sorted(tags) != sorted(_split(a.priority)):
            log.error("the files' tags are not those of --priority")
            return 1
    tags = list(tags or [vcf.source_tag(p) for p in paths])
    headers = {t: vcf.header_lines(spark, p) for t, p in zip(tags, paths, strict=True)}
    head = vcf.Headers(headers)
    calls = vcf.read_calls(spark, list(paths), tags)
    rules = {k: getattr(a, k) for k in ("overlap", "bnd_distance", "ins_distance", "no_intra", "no_var", "pass_only")}
    out = merge.merge(calls, _split(a.priority) or tags, head.samples, a.notag, a.same_order, **rules)
    _emit(merge.output_order(out, list(head.contigs)), head.merged(tags, a.notag), a.prefix, merge.ORDER)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if a.debug else logging.INFO, stream=sys.stderr)
    spark = spark or SparkSession.builder.appName("breakfold").getOrCreate()
    return {"build": run_build, "query": run_query, "export": run_export, "merge": run_merge}[a.command](spark, a)


if __name__ == "__main__":
    sys.exit(main())
