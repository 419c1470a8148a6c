"""Record parsing as column expressions: a line of VCF text becomes a typed call, without Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that are dropped from a chromosome, wherever they stand, in this order.
CHROM_WORDS = ("chr", "Chr", "CHR")


def normalize_chrom(name: Column) -> Column:
    for word in CHROM_WORDS:
        name = F.replace(name, F.lit(word), F.lit(""))
    return name


def info_map(info: Column) -> Column:
    """INFO as a map: flags are dropped, the first ``=`` parts key and value, the last of equal keys wins."""
    pairs = F.filter(F.split(info, ";"), lambda e: F.contains(e, F.lit("=")))
    return F.aggregate(
        pairs,
        F.create_map().cast("map<string,string>"),
        lambda acc, e: F.map_concat(
            F.map_filter(acc, lambda k, v: k != F.split_part(e, F.lit("="), F.lit(1))),
            F.create_map(F.split_part(e, F.lit("="), F.lit(1)), F.substring(e, F.locate("=", e) + 1, F.length(e))),
        ),
    )


def info_value(info: Column, key: str) -> Column:
    """One INFO value (the last of equal keys) without building the map or a list of entries; null without the key."""
    marked, mark = F.concat(F.lit(";"), info), f";{key}="
    return F.when(F.contains(marked, F.lit(mark)), F.split_part(F.substring_index(marked, mark, -1), F.lit(";"), F.lit(1)))


def format_map(fmt: Column, samples: Column) -> Column:
    """FORMAT and samples as key -> one value a sample, ``.`` where a sample has fewer fields; repeated keys keep the first."""
    keys = F.array_distinct(F.split(fmt, ":"))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(samples, lambda s: F.coalesce(F.get(F.split(s, ":"), F.array_position(F.split(fmt, ":"), k).cast("int") - 1), F.lit(".")))))


def confidence(ci: Column) -> tuple[Column, Column]:
    """A confidence interval's two numbers, absolute; parentheses are dropped and a single number counts twice."""
    plain = F.translate(ci, "()", "")
    low, high = (F.abs(F.split_part(plain, F.lit(","), F.lit(n)).try_cast("long")) for n in (1, 2))
    return low, F.coalesce(high, low)


def ci_columns(info: Column) -> list[Column]:
    """CIPOS seeds both ends, CIEND overrides the second, and 0 stands for neither."""
    pos, end = confidence(info_value(info, "CIPOS")), confidence(info_value(info, "CIEND"))
    zero = F.lit(0).cast("long")
    return [
        F.coalesce(pos[0], zero).alias("ci_A_lower"),
        F.coalesce(pos[1], zero).alias("ci_A_upper"),
        F.coalesce(end[0], pos[0], zero).alias("ci_B_lower"),
        F.coalesce(end[1], pos[1], zero).alias("ci_B_upper"),
    ]


#: Doubled brackets at the start of an ALT and what replaces them, in this order.
BRACKETS = (("[]", "]"), ("[[", "["), ("]]", "]"), ("][", "["))


def _single_brackets(df: DataFrame, alt: str) -> DataFrame:
    """df with doubled brackets at the start of ``alt`` made single; each kind, in this order, is replaced wherever it stands."""
    for pair, one in BRACKETS:
        df = df.withColumn(alt, F.when(F.startswith(F.col(alt), F.lit(pair)), F.replace(F.col(alt), F.lit(pair), F.lit(one))).otherwise(F.col(alt)))
    return df


def split_columns(lines: DataFrame, line: str = "line") -> DataFrame:
    """Raw columns of data lines; header and blank lines go."""
    rows = lines.withColumn("__s", F.btrim(F.col(line), F.lit(" \t\n\r\x0b\x0c"))).where((F.length("__s") > 0) & ~F.startswith(F.col("__s"), F.lit("#")))
    # One split for all columns: a projection whose result is used many times stays a step of its own.
    rows, c = rows.withColumn("__c", F.split("__s", "\t")), F.col("__c")
    at = lambda i: F.get(c, F.lit(i))
    return rows.select(
        "*",
        at(0).alias("raw_chrom"),
        at(1).alias("raw_pos"),
        at(2).alias("vid"),
        at(3).alias("ref"),
        at(4).alias("alt"),
        at(5).alias("qual"),
        at(6).alias("filter"),
        F.coalesce(at(7), F.lit("")).alias("info"),
        at(8).alias("fmt"),
        F.when(F.size(c) > 9, F.slice(c, 10, F.greatest(F.size(c) - 9, F.lit(1)))).otherwise(F.array().cast("array<string>")).alias("samples"),
    ).drop("__s", "__c")


def parse_calls(lines: DataFrame, line: str = "line", keep_swapped_end: bool = False) -> DataFrame:
    """Typed calls of text lines: chrA, posA, chrB, posB, event_type beside the raw columns.

    Lines whose numbers can't be read have ``bad`` true and null positions; see ``rejected``.
    A translocation whose chromosomes are swapped loses its end (posB = posA) unless keep_swapped_end.
    """
    df = split_columns(lines, line)
    alt, ref, info = F.col("alt"), F.col("ref"), F.col("info")
    pos = F.col("raw_pos").try_cast("long")
    end_s, len_s = info_value(info, "END"), info_value(info, "SVLEN")
    end, length = end_s.try_cast("long"), F.abs(len_s.try_cast("long"))
    chrom = normalize_chrom(F.col("raw_chrom"))
    tra = F.contains(alt, F.lit("TRA"))
    bnd = ~tra & (F.contains(alt, F.lit("[")) | F.contains(alt, F.lit("]")))
    df = df.withColumns({"__pos": pos, "__chrom": chrom, "__tra": tra, "__bnd": bnd, "__end": end, "__len": length, "__chr2": info_value(info, "CHR2"), "__svtype": info_value(info, "SVTYPE")})
    # The mate is the second part of a bracketed ALT; others have none.
    df = _single_brackets(df.withColumn("__alt", F.when(F.col("__bnd"), alt)), "__alt")
    df = df.withColumn("__mate", F.get(F.split(F.translate("__alt", "[]", ",,"), ","), F.lit(1)))
    mate = F.col("__mate")
    df = df.withColumns({"__mchr": normalize_chrom(F.regexp_extract(mate, r"^(.*):", 1)), "__mpos": F.regexp_extract(mate, r"([^:]*)$", 1).try_cast("long")})
    p, e, t2 = F.col("__pos"), F.col("__end"), F.col("__chr2")
    # Intrachromosomal: END, else SVLEN, else the position itself; then in order.
    b0 = F.when(end_s.isNotNull(), e).when(len_s.isNotNull(), p + F.col("__len")).otherwise(p)
    df = df.withColumns({"__b0": b0}).withColumns({"__lo": F.least("__pos", "__b0"), "__hi": F.greatest("__pos", "__b0")})
    bases = alt.rlike("^[ATCGN]*$")
    inserted = F.length(alt) > F.length(ref)
    own = F.rtrim(F.btrim(alt, F.lit("<")), F.lit(">"))
    symbolic = F.contains(alt, F.lit("<")) & F.contains(alt, F.lit(">"))
    kind = (
        F.when(symbolic, F.when(F.contains(own, F.lit("DUP")), "DUP").otherwise(own))
        .when(F.col("__svtype").isNotNull(), F.col("__svtype"))
        .when(bases, F.when(inserted, "INS").otherwise("DEL"))
        .otherwise("")
    )
    df = df.withColumn("__kind", kind)
    by_length = ~symbolic & F.col("__svtype").isNull() & bases & ~inserted
    ins = F.contains(F.col("__kind"), F.lit("INS"))
    swap_t = F.col("__chrom") > t2
    swap_b = F.col("__chrom") > F.col("__mchr")
    same_b = F.col("__chrom") == F.col("__mchr")
    m = F.col("__mpos")
    lo, hi = F.col("__lo"), F.col("__hi")
    out = df.withColumns(
        {
            "chrA": F.when(F.col("__tra"), F.least("__chrom", "__chr2")).when(F.col("__bnd"), F.least("__chrom", "__mchr")).otherwise(F.col("__chrom")),
            "posA": F.when(F.col("__tra"), p).when(F.col("__bnd"), F.when(swap_b, m).when(same_b, F.least(p, m)).otherwise(p)).when(ins, p).otherwise(lo),
            "chrB": F.when(F.col("__tra"), F.greatest("__chrom", "__chr2")).when(F.col("__bnd"), F.greatest("__chrom", "__mchr")).otherwise(F.col("__chrom")),
            "posB": F.when(F.col("__tra"), F.when(swap_t & F.lit(not keep_swapped_end), p).otherwise(e))
            .when(F.col("__bnd"), F.when(swap_b, p).when(same_b, F.greatest(p, m)).otherwise(m))
            .when(ins, p)
            .when(by_length, lo + F.length(ref) - 1)
            .otherwise(hi),
            "event_type": F.when(F.col("__tra") | F.col("__bnd"), "BND").otherwise(F.col("__kind")),
        }
    )
    bad = F.col("__pos").isNull() | (F.col("__bnd") & F.col("__mpos").isNull()) | F.col("posA").isNull() | F.col("posB").isNull() | F.col("chrB").isNull() | (end_s.isNotNull() & e.isNull() & ~F.col("__bnd"))
    out = out.withColumn("bad", bad)
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def rejected(calls: DataFrame) -> DataFrame:
    """The lines whose positions can't be read."""
    return calls.where("bad")


def is_interchromosomal(chr_a: Column, chr_b: Column) -> Column:
    return chr_a != chr_b


def is_insertion(kind: Column) -> Column:
    return F.contains(kind, F.lit("INS"))


def is_precise(kind: Column) -> Column:
    return kind == "BND"


def retrieve_key(line: Column, key: str) -> Column:
    """The value after the last ``;key=``, else after ``<tab>key=``, of a whole line; null if neither occurs."""
    after = lambda mark: F.regexp_extract(line, rf"(?s)^.*{mark}{key}=([^;\t]*)", 1)
    return F.when(F.contains(line, F.lit(f";{key}=")), after(";")).when(F.contains(line, F.lit(f"\t{key}=")), after("\t"))
