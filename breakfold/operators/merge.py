"""Merging of call sets: similar calls become one record with full provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breakfold.functions.tags import collect_info, collect_sample, csq_effects, format_tag, merge_csq, sanitize_id, set_tag, supp_vec
from breakfold.operators.cluster import greedy_merge

#: INFO tags that only the source of highest priority gives.
ONE_SOURCE = ("SVLEN", "END", "SVTYPE")


def merge_edges(calls: DataFrame, overlap: float = 0.95, bnd_distance: int = 2000, ins_distance: int = 50) -> DataFrame:
    """(a, b, ra, rb): ids and ranks of matching calls of one type, a before b in (posA, source_ord, line_no) order."""
    from breakfold.functions.overlap import overlap_ratio
    from breakfold.operators.blockpairs import block_pairs

    length = F.col("posB") - F.col("posA")
    rows = calls.select("chrA", "chrB", "event_type", (F.col("chrA") != F.col("chrB")).alias("inter"), F.contains(F.col("event_type"), F.lit("INS")).alias("ins"), "posA", "posB", "source_ord", "line_no", "call_id")

    def hit(a: dict, b: dict) -> Column:
        q = (a["posA"], a["posB"], b["posA"], b["posB"])
        inter, ins = a["inter"], a["ins"]
        far_a = F.when(ins, F.when(inter, ins_distance).otherwise(min(ins_distance, bnd_distance))).otherwise(bnd_distance)
        far_b = F.when(ins, ins_distance).otherwise(bnd_distance)
        return (b["posA"] - a["posA"] <= far_a) & (F.abs(a["posB"] - b["posB"]) <= far_b) & (inter | F.coalesce(overlap_ratio(*q) >= F.when(ins, -1.0).otherwise(overlap), F.lit(False)))

    def could(a, b) -> Column:
        """A ratio is at most that of the shorter interval to the longer; the rest is for rounding."""
        shorter, longer = F.least(a("high", "length"), b("high", "length")) + 1, F.greatest(a("low", "length"), b("low", "length")) + 1
        return F.col("l_k_3") | F.col("l_k_4") | (shorter >= longer * (overlap - 1e-9))

    pairs = block_pairs(
        rows, ["chrA", "chrB", "event_type", "inter", "ins"], "posA", "posB", ["posA", "source_ord", "line_no"], max(bnd_distance, ins_distance), hit,
        blocks_by=[length, "posA"], within=[length, "posA"], could=could if overlap > 0 else None, carry=["call_id"], size=256,
    )
    rank = lambda s: F.struct(*[F.col(f"{s}_{c}").alias(c) for c in ("posA", "source_ord", "line_no")])
    return pairs.select(F.col("l_call_id").alias("a"), F.col("r_call_id").alias("b"), rank("l").alias("ra"), rank("r").alias("rb"))


def clusters(calls: DataFrame, assigned: DataFrame) -> DataFrame:
    """A row per anchor: call_id of the anchor and its members ``m``, an array in anchor-first order.

    A cluster is one output record, so its members belong in one row.
    """
    head = F.struct(
        (F.col("call_id") != F.col("anchor_id")).alias("later"), "posA", "source_ord", "line_no", "call_id", "source", "vid", "raw_chrom", "raw_pos", "ref", "alt", "qual", "filter", "info", "fmt", "samples", "sample_names",
        (F.col("chrA") != F.col("chrB")).alias("inter"),
        collect_info(F.col("vid"), F.col("info")).alias("info_text"),
        collect_sample(F.col("vid"), F.col("fmt"), F.col("samples"), F.col("sample_names")).alias("sample_text"),
    )
    return calls.join(assigned, "call_id").groupBy("anchor_id").agg(F.array_sort(F.collect_list(head)).alias("m"))


def _of(m: Column, source: Column) -> Column:
    return F.filter(m, lambda x: x["source"] == source)


def _file(m: Column, source: Column) -> Column:
    """A source's record of a cluster: the anchor's own, else the last that was claimed."""
    anchor, own = F.get(m, F.lit(0)), _of(m, source)
    return F.when(anchor["source"] == source, anchor).otherwise(F.get(own, F.size(own) - 1))


def info_union(files: Column) -> Column:
    """INFO entries of records in priority order; the first of each tag wins, and some tags come from the first record only."""
    tag = lambda c: F.split_part(c, F.lit("="), F.lit(1))
    all_of = F.flatten(F.transform(files, lambda f, n: F.filter(F.split(f["info"], ";"), lambda c: (n == 0) | ~tag(c).isin(*ONE_SOURCE))))
    tags = F.transform(all_of, tag)
    return F.array_join(F.filter(all_of, lambda c, i: F.array_position(tags, tag(c)) == i + 1), ";")


def format_union(files: Column, samples: list[str]) -> tuple[Column, Column]:
    """FORMAT keys of the records that give a sample its values, and each sample's values by them.

    A sample is taken from the first record in priority order that has it.  Missing genotypes are ``./.``, other missing values ``.``.
    """
    names = F.transform(files, lambda f: F.slice(f["sample_names"], F.lit(1), F.size(f["samples"])))
    gives = F.transform(names, lambda own, n: F.size(F.array_except(own, F.flatten(F.slice(names, F.lit(1), n)))) > 0)
    keys = F.array_distinct(F.flatten(F.transform(files, lambda f, n: F.when(F.get(gives, n), F.split(f["fmt"], ":")).otherwise(F.array().cast("array<string>")))))

    def one(sample: Column) -> Column:
        holder = F.get(F.filter(files, lambda f: F.array_contains(F.slice(f["sample_names"], F.lit(1), F.size(f["samples"])), sample)), F.lit(0))
        own_keys = F.split(holder["fmt"], ":")
        values = F.split(F.get(holder["samples"], F.array_position(holder["sample_names"], sample).cast("int") - 1), ":")

        def value(k: Column) -> Column:
            at = F.array_position(own_keys, k).cast("int")
            return F.when(at > 0, F.coalesce(F.get(values, at - 1), F.lit("."))).otherwise(F.when(k == "GT", "./.").otherwise("."))

        return F.array_join(F.transform(keys, value), ":")

    return F.array_join(keys, ":"), F.transform(F.lit(samples).cast("array<string>"), one)


def merge(calls: DataFrame, priority: list[str], samples: list[str], no_tag: bool = False, same_order: bool = False, origin_tag: str = "origin", **rules) -> DataFrame:
    """A row per merged record: the fixed VCF columns, foundby, supp_vec, set_tag, origin, and the whole ``line``.

    calls: parsed calls with call_id, source (tag), source_ord, line_no and sample_names.  priority: source tags,
    first the most trusted.  rules: those of greedy_merge.
    """
    return assemble(clusters(calls, greedy_merge(calls, **rules)), priority, samples, no_tag, same_order, origin_tag)


def assemble(grouped: DataFrame, priority: list[str], samples: list[str], no_tag: bool = False, same_order: bool = False, origin_tag: str = "origin") -> DataFrame:
    m = F.col("m")
    a = F.get(m, F.lit(0))
    df = grouped.withColumn("a", a).withColumn("callers", F.array_distinct(F.transform(m, lambda x: x["source"])))
    # Members' CSQ joins the anchor's INFO for calls between chromosomes.
    effects = F.flatten(F.transform(F.filter(m, lambda x: x["later"] & x["inter"]), lambda x: csq_effects(x["info"])))
    df = df.withColumn("a", F.col("a").withField("info", F.when(F.size(effects) > 0, merge_csq(F.col("a.info"), effects)).otherwise(F.col("a.info"))))
    df = df.withColumn("m", F.transform(m, lambda x: F.when(x["later"], x).otherwise(F.col("a"))))
    df = df.withColumn("files", F.transform(F.filter(F.lit(priority).cast("array<string>"), lambda s: F.array_contains("callers", s)), lambda s: _file(F.col("m"), s)))
    passing = F.transform(F.filter("files", lambda f: f["filter"].isin("PASS", ".")), lambda f: f["source"])
    keys, values = format_union(F.col("files"), samples)
    has_samples = F.size("a.samples") > 0
    later = F.filter("m", lambda x: x["later"])
    varid = F.array_join(F.transform(later, lambda x: F.concat(sanitize_id(x["vid"]), F.lit(":"), x["source"])), "|")
    df = df.withColumns({
        "varid": varid,
        "set_tag": set_tag(priority, F.col("callers"), passing),
        "foundby": F.size("callers"),
        "supp_vec": supp_vec(priority, F.col("callers")),
        "origin": F.array_join("callers", "|"),
        "info_union": info_union(F.col("files")),
        "fmt": F.col("a.fmt") if same_order else F.when(has_samples, keys),
        "sample_values": F.col("a.samples") if same_order else F.when(has_samples, values).otherwise(F.array().cast("array<string>")),
    })
    tagged = lambda name, value, fix=lambda c: c: F.array_join(F.transform("callers", lambda s: F.concat(F.lit(";"), s, F.lit(f"_{name}="), fix(F.array_join(F.transform(_of(F.col("m"), s), value), ",")))), "")
    per_source = F.concat(
        tagged("CHROM", lambda x: format_tag(x["vid"], x["raw_chrom"])),
        tagged("POS", lambda x: format_tag(x["vid"], x["raw_pos"])),
        tagged("QUAL", lambda x: format_tag(x["vid"], x["qual"])),
        tagged("FILTERS", lambda x: format_tag(x["vid"], x["filter"]), lambda c: F.replace(c, F.lit(";"), F.lit(","))),
        tagged("SAMPLE", lambda x: x["sample_text"]),
        tagged("INFO", lambda x: x["info_text"]),
    )
    found = F.size(later) > 0
    none = F.lit("")
    info = F.concat(
        F.col("info_union"),
        none if no_tag else F.when(found, F.concat(F.lit(";VARID="), F.col("varid"))).otherwise(""),
        none if no_tag else F.concat(F.lit(";set="), F.col("set_tag"), F.lit(";FOUNDBY="), F.col("foundby").cast("string")),
        per_source,
        none if no_tag else F.concat(F.lit(f";{origin_tag}="), F.col("origin")),
        F.lit(";SUPP_VEC="),
        F.col("supp_vec"),
    )
    vid = F.col("a.vid") if no_tag else F.when(found, F.concat(F.col("a.vid"), F.lit(":"), F.col("a.source"), F.lit("|"), F.col("varid"))).otherwise(F.col("a.vid"))
    out = df.select(
        F.col("anchor_id"), F.col("a.raw_chrom").alias("chrom"), F.col("a.raw_pos").cast("long").alias("pos"), vid.alias("id"), F.col("a.ref").alias("ref"), F.col("a.alt").alias("alt"), F.col("a.qual").alias("qual"), F.col("a.filter").alias("filter"),
        info.alias("info"), "fmt", "sample_values", "varid", "set_tag", "foundby", "supp_vec", "origin", "info_union", F.col("a.posA").alias("posA"), F.col("a.source_ord").alias("source_ord"), F.col("a.line_no").alias("line_no"),
    )
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "id", "ref", "alt", "qual", "filter", "info", "fmt", F.when(F.size("sample_values") > 0, F.array_join("sample_values", "\t")))
    return out.withColumn("line", line)


def output_order(merged: DataFrame, contigs: list[str]) -> DataFrame:
    """merged with contig_rank: header order first, other chromosomes behind in lexicographic order (no contigs: all so).

    Sort by (contig_rank, chrom, pos, posA, source_ord, line_no) to write.
    """
    at = F.array_position(F.lit(contigs).cast("array<string>"), F.col("chrom")) if contigs else F.lit(0)
    return merged.withColumn("contig_rank", F.when(at > 0, at).otherwise(len(contigs) + 1).cast("int"))


ORDER = ["contig_rank", "chrom", "pos", "posA", "source_ord", "line_no"]
