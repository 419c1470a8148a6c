"""Annotation of query calls with occurrence and frequency in a database of calls.

Query rows have qid, chrA, chrB, posA, posB, event_type.  All three databases are joined by cells of near positions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breakfold.operators.celljoin import Rule, best_match, matched_numbers

#: Genotypes of a call-set database that don't count as carriers.
NOT_CARRIED = ("0|0", "0/0")


def annotate_table(query: DataFrame, store: DataFrame, overlap: float = 0.6, bnd_distance: int = 10_000, max_frq: float = 1.0, db_size: int | None = None) -> DataFrame:
    """query with occ (distinct samples of matching stored calls) and frq (of all samples).

    Matches are of the same type, inside the box, and on one chromosome have an overlap of at least ``overlap`` that isn't
    exactly 0.  Insertions have no rule of their own here.  Rows whose frequency is above max_frq go.  An empty store is an error.
    """
    n = db_size if db_size is not None else store.agg(F.count_distinct("sample")).first()[0]
    if not n:
        raise ValueError("the store holds no samples")
    db = store.withColumnRenamed("var", "event_type") if "var" in store.columns else store
    by_name = Window.orderBy("__name")  # one row a sample
    names = store.select(F.col("sample").alias("__name")).distinct().withColumn("number", F.row_number().over(by_name) - 1)
    db = db.join(F.broadcast(names), F.col("sample") == F.col("__name"))
    out = matched_numbers(query, db, Rule(overlap, bnd_distance, touching=False), "occ")
    return out.withColumn("frq", F.col("occ") / F.lit(n)).where(F.col("frq") <= max_frq)


def annotate_genotypes(query: DataFrame, db: DataFrame, n_samples: int, overlap: float = 0.6, bnd_distance: int = 10_000, ins_distance: int = 50, no_var: bool = False) -> DataFrame:
    """query with occ and frq from a call-set database: db has genotypes ``gts``, an array with one of each sample column.

    occ counts the sample columns that carry any matching call.
    """
    rule = Rule(overlap, bnd_distance, ins_distance, no_var)
    carried = db.select(*rule.keys, "posA", "posB", F.posexplode("gts").alias("number", "gt")).where(~F.col("gt").isin(*NOT_CARRIED))
    return matched_numbers(query, carried, rule, "occ").withColumn("frq", F.col("occ") / F.lit(n_samples))


def annotate_best(query: DataFrame, db: DataFrame, overlap: float = 0.6, bnd_distance: int = 10_000, ins_distance: int = 50, no_var: bool = False) -> DataFrame:
    """query with the occ and frq of its most similar database call; db has occ, frq and db_ord.

    Most similar: the least distance between chromosomes and for insertions, else the largest overlap;
    ties to the first type met in the database, then to database order.
    """
    first = db.groupBy("chrA", "chrB", "event_type").agg(F.min("db_ord").alias("type_ord")).withColumnsRenamed({"chrA": "tA", "chrB": "tB", "event_type": "tT"})
    ranked = db.join(first, (F.col("chrA") == F.col("tA")) & (F.col("chrB") == F.col("tB")) & (F.col("event_type") == F.col("tT"))).drop("tA", "tB", "tT")
    return best_match(query, ranked, Rule(overlap, bnd_distance, ins_distance, no_var), ["type_ord", "db_ord"], ["occ", "frq"])


def tag_database(calls: DataFrame, in_occ: str, in_frq: str) -> DataFrame:
    """Database calls with occ and frq from their own INFO tags; calls that lack one of them go."""
    from breakfold.functions.parsing import info_value

    if not in_occ or not in_frq:
        raise ValueError("both tags are needed")
    out = calls.withColumn("occ", info_value(F.col("info"), in_occ)).withColumn("frq", info_value(F.col("info"), in_frq))
    return out.where("occ is not null and frq is not null").withColumn("occ", F.col("occ").try_cast("long"))


def info_with(info: Column, occ: Column, frq: Column, occ_tag: str = "OCC", frq_tag: str = "FRQ") -> Column:
    """INFO with both tags appended where there is an occurrence."""
    added = F.concat(info, F.lit(f";{occ_tag}="), occ.cast("string"), F.lit(f";{frq_tag}="), frq.cast("string"))
    return F.when(occ.isNotNull() & (occ != 0), added).otherwise(info)


def chain(query: DataFrame, steps: list) -> DataFrame:
    """Several annotations one after another; each is a function of a DataFrame, and nothing is written in between."""
    return reduce(lambda df, step: step(df), steps, query)
