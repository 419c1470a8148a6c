"""Band join: equal keys and positions within a distance, without comparing all rows of a key.

Positions are cut into bins twice as wide as the distance, so what is within reach of a position lies in two bins at
most.  One side's rows go to their own bin, the other's to the one or two bins in reach, so each pair
meets in one bin exactly.  With a second position on both sides, bins are squares.  Catalyst
then plans an ordinary equi-join, whose skewed partitions AQE can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bins(pos: str, distance: float) -> tuple[Column, Column]:
    """The bin of a position, and an array of the bins within reach of it."""
    width = max(1, 2 * distance)
    p = F.col(pos)
    low, high = F.floor((p - distance) / width), F.floor((p + distance) / width)
    return F.floor(p / width), F.when(low < high, F.array(low, high)).when(low == high, F.array(low))


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_pos: str, right_pos: str, distance: int, how: str = "inner", residual=None, left_end: str | None = None, right_end: str | None = None) -> DataFrame:
    """Pairs of rows with equal keys and positions within the distance, which also meet the residual condition.

    With ``left_end`` and ``right_end`` these second positions must be within the distance, too.  An inner join copies rows
    of the left side, which should be the smaller one; a left join those of the right.
    Right columns must have names of their own, keys apart; right keys are named ``r_<key>``.  Null keys and
    positions match nothing.  A negative distance matches nothing.  how: inner or left.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    ends = [(left_pos, right_pos, "a"), *([(left_end, right_end, "b")] if left_end else [])]
    rk = [f"r_{k}" for k in keys]
    right = right.withColumnsRenamed(dict(zip(keys, rk, strict=True)))
    cond = F.lit(distance >= 0)
    for k, r in zip(keys, rk, strict=True):
        cond = cond & (F.col(k) == F.col(r))
    for lp, rp, n in ends:
        one, many = (lp, rp) if how == "left" else (rp, lp)
        single, reached = _bins(one, distance)[0], F.explode(_bins(many, distance)[1])
        left = left.withColumn(f"__l{n}", single if how == "left" else reached)
        right = right.withColumn(f"__r{n}", reached if how == "left" else single)
        cond = cond & (F.col(f"__l{n}") == F.col(f"__r{n}")) & (F.abs(F.col(lp) - F.col(rp)) <= distance)
    if residual is not None:
        cond = cond & residual
    return left.join(right, cond, how).drop(*[f"__{x}{n}" for _, _, n in ends for x in "lr"])
