"""Export of a store as clustered population calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breakfold.functions.overlap import overlap_ratio, within_box
from breakfold.functions.tags import export_alt, genotype_columns
from breakfold.operators.bandjoin import band_join
from breakfold.operators.cluster import PART, dbscan_xy, star_cover
from breakfold.operators.staging import numbered


def _is_ins():
    return F.contains(F.col("var"), F.lit("INS"))


def labelled(store: DataFrame, bnd_distance: int = 2500, ins_distance: int = 50, dbscan: bool = False, epsilon: int = 500, min_pts: int = 2) -> DataFrame:
    """store with x_label and y_label by density; the reach depends on the kind of clustering and on the type."""
    if dbscan:
        return dbscan_xy(store, epsilon, min_pts)
    return dbscan_xy(store, F.when(_is_ins(), ins_distance).otherwise(bnd_distance), 2)


def neighbours(store: DataFrame, overlap: float = 0.8, bnd_distance: int = 2500, ins_distance: int = 50, part: list[str] = PART) -> DataFrame:
    """(idx, other) of calls in one part that are neighbours, each call its own included."""
    far = F.when(_is_ins(), ins_distance).otherwise(bnd_distance)
    left = store.select(*part, "posA", "posB", "idx")
    right = store.select(*part, F.col("posA").alias("dA"), F.col("posB").alias("dB"), F.col("idx").alias("other"))
    q = [F.col(c) for c in ("posA", "posB", "dA", "dB")]
    hit = within_box(*q, far) & ((F.col("chrA") != F.col("chrB")) | _is_ins() | F.coalesce(overlap_ratio(*q) >= overlap, F.lit(False)))
    return band_join(left, right, part, "posA", "dA", max(bnd_distance, ins_distance), "inner", hit, "posB", "dB").select("idx", "other")


def cluster_members(store: DataFrame, overlap: float = 0.8, bnd_distance: int = 2500, ins_distance: int = 50, dbscan: bool = False, epsilon: int = 500, min_pts: int = 2) -> DataFrame:
    """A row per cluster and member: kind, x_label, y_label, center_idx, var, chrA, chrB, idx, posA, posB, sample, is_center.

    Noise is a cluster of its own row.  Density clusters stand as they are with ``dbscan``, else they are refined by star covers.
    ``overlap`` must be 0 to 1; ``no_merge_members`` turns merging off.
    """
    if not 0 <= overlap <= 1:
        raise ValueError("overlap must be 0 to 1")
    df = labelled(store, bnd_distance, ins_distance, dbscan, epsilon, min_pts)
    cols = [*PART, "idx", "posA", "posB", "sample"]
    noise = df.where("y_label is null").select(F.lit("single").alias("kind"), F.lit(0).cast("long").alias("x_label"), F.lit(0).cast("long").alias("y_label"), F.col("idx").alias("center_idx"), *cols, F.lit(True).alias("is_center"))
    dense = df.where("y_label is not null")
    if dbscan:
        more = dense.select(F.lit("dense").alias("kind"), "x_label", "y_label", F.lit(0).cast("long").alias("center_idx"), *cols, F.lit(False).alias("is_center"))
    else:
        far = F.when(_is_ins(), ins_distance).otherwise(bnd_distance)
        need = F.when(_is_ins(), -1.0).otherwise(float(overlap))
        stars = star_cover(dense, far, need, [*PART, "x_label", "y_label"])
        more = stars.select(F.lit("star").alias("kind"), "x_label", "y_label", "center_idx", *cols, "is_center")
    return noise.unionByName(more)


def no_merge_members(store: DataFrame, ins_distance: int = 50) -> DataFrame:
    """cluster_members with merging off: every call by itself, but insertions as always."""
    rest = store.where(~_is_ins())
    cols = [*PART, "idx", "posA", "posB", "sample"]
    single = rest.select(F.lit("single").alias("kind"), F.lit(0).cast("long").alias("x_label"), F.lit(0).cast("long").alias("y_label"), F.col("idx").alias("center_idx"), *cols, F.lit(True).alias("is_center"))
    return single.unionByName(cluster_members(store.where(_is_ins()), ins_distance=ins_distance))


KEY = ["kind", *PART, "x_label", "y_label", "center_idx"]


def summarize(members: DataFrame, n_samples: int) -> DataFrame:
    """A row per cluster: representative posA and posB, their spans, occ, frq (4 digits), n_samples, and bounds around the representative.

    The representative is the centre, or the truncated mean of a density cluster.
    """
    g = members.groupBy(*KEY).agg(
        F.coalesce(F.max(F.when(F.col("is_center"), F.col("posA"))), F.floor(F.sum("posA") / F.count(F.lit(1))).cast("long")).alias("posA"),
        F.coalesce(F.max(F.when(F.col("is_center"), F.col("posB"))), F.floor(F.sum("posB") / F.count(F.lit(1))).cast("long")).alias("posB"),
        F.min("posA").alias("minA"), F.max("posA").alias("maxA"), F.min("posB").alias("minB"), F.max("posB").alias("maxB"),
        F.count_distinct("sample").alias("occ"), F.count(F.lit(1)).alias("n_calls"), F.min("idx").alias("first_idx"),
    )
    near = lambda p, x: F.abs(F.col(p) - F.col(x))
    return g.withColumns({"ci_pos_low": -near("posA", "minA"), "ci_pos_high": near("posA", "maxA"), "ci_end_low": -near("posB", "minB"), "ci_end_high": near("posB", "maxB"), "frq": F.round(F.col("occ") / F.lit(n_samples), 4), "n_samples": F.lit(n_samples)})


def lines(members: DataFrame, samples: list[str]) -> DataFrame:
    """A row per cluster with its VCF ``line`` and ``ord``, its running number.

    Clusters are named by running numbers from 0, by chromosomes, type, position, first index and centre.
    """
    n = len(samples)
    who = members.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("idx", "sample", "posA", "posB"))).alias("who"), F.array_sort(F.collect_set("sample")).alias("hits"))
    out = summarize(members, n).join(who.withColumnsRenamed({k: f"w_{k}" for k in KEY}), [F.col(k) == F.col(f"w_{k}") for k in KEY])
    listed = F.array_join(F.transform("who", lambda w: F.concat(F.lit("|"), w["sample"], F.lit(":"), w["posA"].cast("string"), F.lit(":"), w["posB"].cast("string"))), "")
    alt = export_alt(F.col("var"), F.col("chrA"), F.col("chrB"), F.col("posB"))
    plain = (F.col("chrA") == F.col("chrB")) & (F.col("var") != "BND")
    s = lambda c: F.col(c).cast("string")
    info = F.concat(
        F.lit("SVTYPE="), "var", F.when(plain, F.concat(F.lit(";END="), s("posB"), F.lit(";SVLEN="), F.abs(F.col("posA") - F.col("posB")).cast("string"))).otherwise(""),
        F.lit(";NSAMPLES="), s("n_samples"), F.lit(";OCC="), s("occ"), F.lit(";FRQ="), s("frq"),
        F.lit(";CIPOS="), s("ci_pos_low"), F.lit(","), s("ci_pos_high"), F.lit(";CIEND="), s("ci_end_low"), F.lit(","), s("ci_end_high"), F.lit(";VARIANTS="), listed,
    )
    order = ["chrA", "chrB", "var", "posA", "posB", "first_idx", "center_idx", "kind", "x_label", "y_label"]
    whole = numbered(out.select(*order, info.alias("info"), alt.alias("alt"), "hits"), order, "ord")
    line = F.concat_ws("\t", "chrA", s("posA"), F.concat(F.lit("cluster_"), s("ord")), F.lit("N"), "alt", F.lit("."), F.lit("PASS"), "info", F.lit("GT"), genotype_columns(F.lit(samples).cast("array<string>"), F.col("hits")))
    return whole.select("ord", line.alias("line"))
