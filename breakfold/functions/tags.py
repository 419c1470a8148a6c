"""Text of identifiers, provenance tags and genotypes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitize_id(vid: Column) -> Column:
    return F.translate(vid, ";:|", "___")


def format_tag(vid: Column, value: Column) -> Column:
    return F.concat(sanitize_id(vid), F.lit("|"), value)


def collect_info(vid: Column, info: Column) -> Column:
    """INFO entries as id|K:V|...; entries with a colon or bar go, flags stay."""
    kept = F.filter(F.split(info, ";"), lambda e: ~F.contains(e, F.lit(":")) & ~F.contains(e, F.lit("|")))
    return F.array_join(F.concat(F.array(sanitize_id(vid)), F.transform(kept, lambda e: F.translate(e, "=,", "::"))), "|")


def collect_sample(vid: Column, fmt: Column, samples: Column, names: Column) -> Column:
    """Sample columns as id|name|KEY:VALUE|..., commas as colons; missing fields are a dot."""
    keys = F.split(fmt, ":")
    one = lambda s, i: F.concat_ws(
        "|", F.get(names, i), F.array_join(F.transform(keys, lambda k, n: F.concat(k, F.lit(":"), F.coalesce(F.get(F.split(s, ":"), n), F.lit(".")))), "|")
    )
    text = F.concat_ws("|", sanitize_id(vid), F.array_join(F.transform(samples, one), "|"))
    return F.translate(text, ",", ":")


def csq_effects(info: Column) -> Column:
    """The CSQ effects of an INFO text, none if it has none."""
    return F.filter(F.split(F.regexp_extract(info, r"(?:^|;)CSQ=([^;]*)", 1), ","), lambda e: F.length(e) > 0)


def merge_csq(info: Column, effects: Column) -> Column:
    """INFO with its CSQ replaced by the sorted union with other effects; unchanged without CSQ."""
    union = F.array_join(F.array_sort(F.array_union(csq_effects(info), effects)), ",")
    escaped = F.replace(F.replace(union, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return F.when(info.rlike(r"(^|;)CSQ="), F.regexp_replace(info, F.lit(r"(^|;)CSQ=[^;]*"), F.concat(F.lit("$1CSQ="), escaped))).otherwise(info)


def genotype_columns(samples: Column, hits: Column) -> Column:
    """Tab-joined genotypes in sample order: 0/0, or ./1 for samples among the hits."""
    return F.array_join(F.transform(samples, lambda s: F.when(F.array_contains(hits, s), "./1").otherwise("0/0")), "\t")


def export_alt(kind: Column, chr_a: Column, chr_b: Column, pos_b: Column) -> Column:
    plain = (chr_a == chr_b) & (kind != "BND")
    return F.when(plain, F.concat(F.lit("<"), kind, F.lit(">"))).otherwise(F.concat(F.lit("N["), chr_b, F.lit(":"), pos_b.cast("string"), F.lit("[")))


def supp_vec(priority: list[str], present: Column) -> Column:
    """A 0 or 1 for each source in sorted order."""
    return F.concat(*[F.when(F.array_contains(present, s), "1").otherwise("0") for s in sorted(priority)])


def set_tag(priority: list[str], present: Column, passing: Column) -> Column:
    """Which sources support a call.

    Every source present and passing: ``Intersection``.  Every one present and none passing: ``FilteredInAll``.
    Else those present in priority order joined by ``-``, with ``filterIn`` before those that don't pass.
    """
    n = len(priority)
    count = lambda test: sum((F.when(test(x), 1).otherwise(0) for x in priority), F.lit(0))
    passes = lambda x: F.array_contains(passing, x)
    fails = lambda x: F.array_contains(present, x) & ~F.array_contains(passing, x)
    parts = F.array_compact(F.array(*[F.when(passes(x), x).when(fails(x), f"filterIn{x}") for x in priority]))
    return F.when(count(passes) == n, "Intersection").when(count(fails) == n, "FilteredInAll").otherwise(F.array_join(parts, "-"))
