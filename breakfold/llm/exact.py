"""Exact deduplication by skew-safe combining, in DataFrame operations only.

1. Local: the partial aggregation folds equal texts of a partition before anything is sent.
2. Salted: groups of (digest, salt, content) are merged; a salt is a hash of the document id,
   so a text that a third of all rows share is dealt over ``salts`` tasks.
3. Global: at most ``salts`` winners of each text meet by (digest, content).

Contents are grouping keys at each stage, so texts are compared whole and not by digest alone.
The winner of a group is found in the same pass as its size: length and document id are
one decimal number whose maximum hash aggregation can keep in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, without_blanks

#: 2^63 and 2^65 as decimals; an id takes 64 bits, its length stands above them.
_HALF, _SHIFT = "cast(9223372036854775808 as decimal(20,0))", "cast(36893488147419103232 as decimal(20,0))"


#: A row's length and id as one number; a null id is below every other.
_RANK = f"cast(cast(n_chars as decimal(10,0)) * {_SHIFT} + coalesce({_HALF} - cast(doc_id as decimal(19,0)), 0) as decimal(38,0))"


def _keyed(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    base = base.select("doc_id", F.length("text").alias("n_chars"), without_blanks(F.col("text")).alias("norm"))
    return base.select("doc_id", "n_chars", "norm", F.sha2("norm", 256).alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per distinct normalised text: digest, rank of the row that stays, keep_id, group_size, present (bits of the salts that occur)."""
    if not 1 <= salts <= 62:
        raise ValueError("salts must be 1 to 62")
    local = _keyed(docs, id_col, text_col, salts).select("digest", "norm", "salt", F.expr(_RANK).alias("rank"))
    salted = local.groupBy("digest", "norm", "salt").agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n"))
    whole = salted.groupBy("digest", "norm").agg(F.max("rank").alias("rank"), F.sum("n").alias("group_size"), F.expr("bit_or(shiftleft(1L, salt))").alias("present"))
    part = F.expr(f"rank % {_SHIFT}")
    keep = F.when(part > 0, F.expr(f"cast({_HALF} - rank % {_SHIFT} as bigint)"))
    return whole.select("digest", "rank", keep.alias("keep_id"), "group_size", "present")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """Every row's group of equal texts and the row of the group that stays.

    Texts are equal when identical without white space ([\\x20\\x09-\\x0D]).  The row with the
    most code points stays, then the smallest id.  Returns doc_id, keep_id, group_size, kept,
    text_sha256, one row per input row.

    Null texts count as empty, and empty texts are equal to each other.  A null id ranks after
    every other id; a group of null ids only has keep_id null and keeps its rows.  Repeated
    rows (same id and text) count in group_size and share one decision.  An empty table
    gives an empty result.
    """
    found = winners(docs, id_col, text_col, salts)
    # A text's row is repeated for the salts that it has, so that its many copies don't meet in one join task.
    bits = F.expr(f"filter(sequence(0, {salts - 1}), b -> (shiftright(present, b) & 1) = 1)")
    spread = found.select("digest", "keep_id", "group_size", F.explode(bits).alias("salt"))
    rows = _keyed(docs, id_col, text_col, salts).select("doc_id", "digest", "salt")
    return rows.join(spread, ["digest", "salt"]).select(
        "doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), F.col("digest").alias("text_sha256")
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row of docs for each group of equal texts, with all its columns.

    It is the row that ``exact_dedup`` keeps; of rows that have that id (or, if the group has no other, a null id) and
    that length, one stays.  Rows are told by group and rank and not by id, so ids may be null or repeated.
    """
    kept = winners(docs, id_col, text_col, salts).select(F.col("digest").alias("__digest"), F.col("rank").alias("__rank"))
    key = ["__digest", "__rank"]
    text, n = text_of(text_col), F.length(text_of(text_col))
    rank = F.expr(_RANK.replace("n_chars", "__n").replace("doc_id", "__id"))
    rows = docs.withColumns({"__digest": F.sha2(without_blanks(text), 256), "__n": n, "__id": F.col(id_col).cast("long")})
    rows = rows.withColumn("__rank", rank).drop("__n", "__id")
    # Candidates of a group have one id; the join has brought them together in order.
    return rows.join(kept.hint("merge"), key, "left_semi").dropDuplicates(key).select(*docs.columns)
