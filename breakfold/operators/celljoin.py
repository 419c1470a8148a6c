"""What rows of a database say about query calls near them, without comparing all calls of a dense site.

Equal positions are taken once, and positions share small square cells.  For two cells a rule is certain for all pairs, impossible, or
open: a cell's bounds tell.  Certain cells answer as a whole, and single positions meet only where a cell is open and could still
add something.  A site has no more cells than its ground, so pairs of cells stop growing when a site fills up with calls.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breakfold.functions.overlap import breakpoint_distance, overlap_ratio, similarity, within_box
from breakfold.operators.bandjoin import _bins

WIDTH = 64
#: Bounds this near to a limit leave the answer to single positions, which are held against the rule itself.
MARGIN = 1e-9


def _bounds() -> list[Column]:
    """Least and largest posA and posB of a query cell, then of a database cell."""
    return [F.col(f"{s}{p}{n}") for s in "qd" for p in "ab" for n in "01"]


class Rule:
    """A match of calls: both ends within ``distance`` (insertions: ``ins_distance``, if given), and on one chromosome
    an overlap of at least ``overlap`` (not for insertions that have a distance).  ``touching`` lets an overlap of exactly 0 count.
    """

    def __init__(self, overlap: float, distance: int, ins_distance: int | None = None, no_var: bool = False, touching: bool = True):
        self.overlap, self.distance, self.touching, self.ins_distance = overlap, distance, touching, ins_distance
        self.no_var = no_var
        # With no_var the query's type still decides between distance and overlap, so it stays a key of the query side only.
        self.keys = ["chrA", "chrB"] + ["event_type"] * (not no_var)
        self.width = max(1, min(WIDTH, distance // 8))

    def _inter(self) -> Column:
        return F.col("chrA") != F.col("chrB")

    def _ins(self) -> Column:
        return F.lit(False) if self.ins_distance is None else F.contains(F.col("event_type"), F.lit("INS"))

    def _enough(self, ratio: Column) -> Column:
        ok = ratio >= self.overlap
        return ok if self.touching else ok & (ratio != 0)

    def hit(self, a: Column, b: Column, c: Column, d: Column) -> Column:
        """Whether query positions (a, b) and database positions (c, d) match."""
        by_kind = F.when(self._inter(), True)
        if self.ins_distance is not None:
            by_kind = by_kind.when(self._ins(), breakpoint_distance(a, b, c, d) <= self.ins_distance)
        return within_box(a, b, c, d, self.distance) & by_kind.otherwise(F.coalesce(self._enough(overlap_ratio(a, b, c, d)), F.lit(False)))

    def score(self, a: Column, b: Column, c: Column, d: Column) -> Column:
        return similarity(self._inter() | self._ins(), a, b, c, d)

    def certain(self) -> Column:
        """Whether all pairs of two cells' positions match; false where it is a matter of rounding."""
        qa0, qa1, qb0, qb1, da0, da1, db0, db1 = _bounds()
        far = (qa1 - da0 <= F.col("lim")) & (da1 - qa0 <= F.col("lim")) & (qb1 - db0 <= F.col("lim")) & (db1 - qb0 <= F.col("lim"))
        if self.overlap <= 0:
            return far & F.col("apart")
        part, span = F.least(qb0, db0) - F.greatest(qa1, da1) + 1.0, F.greatest(qb1, db1) - F.least(qa0, da0) + 1.0
        return far & (F.col("apart") | ((part > 0.0) & (part > span * (self.overlap * (1 + MARGIN)))))

    def possible(self) -> Column:
        """Whether any pair may match within ``lim`` and reach the overlap ``need``."""
        qa0, qa1, qb0, qb1, da0, da1, db0, db1 = _bounds()
        near = (qa0 - da1 <= F.col("lim")) & (da0 - qa1 <= F.col("lim")) & (qb0 - db1 <= F.col("lim")) & (db0 - qb1 <= F.col("lim"))
        if self.overlap <= 0:
            return near
        part, span = F.least(qb1, db1) - F.greatest(qa0, da0) + 1.0, F.greatest(qb0, db0) - F.least(qa1, da1) + 1.0
        return near & (F.col("apart") | (part >= span * F.col("need")))

    def least_score(self) -> Column:
        """The least score of two cells whose pairs all match."""
        qa0, qa1, qb0, qb1, da0, da1, db0, db1 = _bounds()
        part, span = F.least(qb0, db0) - F.greatest(qa1, da1) + 1.0, F.greatest(qb1, db1) - F.least(qa0, da0) + 1.0
        return F.when(F.col("apart"), -F.greatest(qa1 - da0, da1 - qa0, qb1 - db0, db1 - qb0)).otherwise(part / F.when(span > 0, span))

    def raised(self, left: DataFrame, floor: str) -> DataFrame:
        """Query cells whose ``lim`` and ``need`` leave no score below the column ``floor``, where it isn't null."""
        f = F.col(floor)
        return left.withColumns({"lim": F.when(F.col("apart") & f.isNotNull(), F.least(F.col("lim"), -f)).otherwise(F.col("lim")), "need": F.when(f.isNotNull(), F.greatest(F.col("need"), f * (1 - MARGIN))).otherwise(F.col("need"))})

    def cells(self, points: DataFrame, side: str, extra: list[str] = (), aggs: list[Column] = (), inner: list[str] = ()) -> DataFrame:
        """A row per cell (and ``extra``): its bounds and its positions, an array that the ground of a cell limits.

        Query cells also say whether distance alone counts (``apart``), and how far (``lim``) or how much overlap (``need``) will do.
        """
        a, b = f"{side}A", f"{side}B"
        keys = [*self.keys, *(["event_type"] if self.no_var and side == "q" else []), *extra]
        cell = points.withColumns({a: F.floor(F.col("posA") / self.width) * self.width, b: F.floor(F.col("posB") / self.width) * self.width})
        bounds = [f("pos" + p.upper()).alias(f"{side}{p}{n}") for p in "ab" for n, f in ((0, F.min), (1, F.max))]
        out = cell.groupBy(*keys, a, b).agg(*bounds, *aggs, F.collect_list(F.struct("posA", "posB", *inner)).alias(f"{side}pts"))
        # Doubles that are never null keep the code of a join short enough to be compiled.
        out = out.withColumns({f"{side}{p}{n}": F.coalesce(F.col(f"{side}{p}{n}").cast("double"), F.lit(0.0)) for p in "ab" for n in "01"})
        if side == "d":
            return out
        lim = F.when(self._ins() & ~self._inter(), float(min(self.distance, self.ins_distance or 0))).otherwise(float(self.distance))
        return out.withColumns({"apart": F.coalesce(self._inter() | self._ins(), F.lit(False)), "lim": lim, "need": F.lit(self.overlap * (1 - MARGIN))})

    def join(self, left: DataFrame, right: DataFrame, residual: Column) -> DataFrame:
        """Cells with equal keys in reach of one another, by squares of which a database cell has one and a query cell up to four."""
        reach = self.distance + self.width - 1
        left = left.withColumn("__la", F.explode(_bins("qA", reach)[1])).withColumn("__lb", F.explode(_bins("qB", reach)[1]))
        right = right.withColumns({"__ra": _bins("dA", reach)[0], "__rb": _bins("dB", reach)[0]}).withColumnsRenamed({k: f"r_{k}" for k in self.keys})
        cond = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"r_{k}") for k in self.keys])
        cond = cond & (F.col("__la") == F.col("__ra")) & (F.col("__lb") == F.col("__rb"))
        return left.join(right, cond & residual).drop("__la", "__lb", "__ra", "__rb", *[f"r_{k}" for k in self.keys])

    def opened(self, pairs: DataFrame, q: list[str], d: list[str]) -> DataFrame:
        """Pairs of positions of joined cells that match, with the positions' own fields ``q`` and ``d``."""
        out = pairs.withColumn("__q", F.explode("qpts")).withColumn("__d", F.explode("dpts"))
        out = out.withColumns({"posA": F.col("__q.posA"), "posB": F.col("__q.posB"), "__c": F.col("__d.posA"), "__e": F.col("__d.posB")} | {c: F.col(f"__q.{c}") for c in q} | {c: F.col(f"__d.{c}") for c in d})
        return out.where(self.hit(F.col("posA"), F.col("posB"), F.col("__c"), F.col("__e")))


POINT = ["chrA", "chrB", "event_type", "posA", "posB"]


def points_of(query: DataFrame) -> DataFrame:
    """Each position and type of the query once; those with nulls match nothing later on."""
    return query.select(*POINT).distinct()


def with_points(query: DataFrame, found: DataFrame) -> DataFrame:
    """query with the columns found for its position, null where there are none."""
    named = found.withColumnsRenamed({c: f"__p_{c}" for c in POINT})
    return query.join(named, [F.col(c) == F.col(f"__p_{c}") for c in POINT], "left").drop(*[f"__p_{c}" for c in POINT])


def matched_numbers(query: DataFrame, db: DataFrame, rule: Rule, name: str) -> DataFrame:
    """query with ``name``: how many different ``number`` (from 0) the matching rows of db have.

    Numbers are bits of 64-bit words, so a cell's are one row a word.
    """
    n = F.col("number")
    words = db.select(*rule.keys, "posA", "posB", F.floor(n / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(number % 64 as int))").alias("bits"))
    words = words.groupBy(*rule.keys, "posA", "posB", "word").agg(F.bit_or("bits").alias("bits"))
    right = rule.cells(words, "d", ["word"], [F.bit_or("bits").alias("all")], ["bits"])
    points = points_of(query)
    left = rule.cells(points, "q")
    cell = ["chrA", "chrB", "event_type", "qA", "qB"]
    sure = rule.join(left.drop("qpts"), right.drop("dpts"), rule.certain()).groupBy(*cell, "word").agg(F.bit_or("all").alias("bits"))
    had = sure.groupBy(*cell).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("had")).withColumnsRenamed({c: f"__s_{c}" for c in cell})
    left = left.join(had, [F.col(c) == F.col(f"__s_{c}") for c in cell], "left").drop(*[f"__s_{c}" for c in cell])
    lacking = lambda bits: bits.bitwiseAND(F.bitwise_not(F.coalesce(F.try_element_at("had", F.col("word")), F.lit(0).cast("long")))) != 0
    open_ = rule.possible() & ~rule.certain() & lacking(F.col("all"))
    more = rule.opened(rule.join(left, right, open_), [], ["bits"]).groupBy(*POINT, "word").agg(F.bit_or("bits").alias("bits"))
    whole = left.select(*[c for c in cell if c not in ("qA", "qB")], F.explode("qpts").alias("__q"), "had").where("had is not null").select("chrA", "chrB", "event_type", "__q.posA", "__q.posB", F.explode("had").alias("word", "bits"))
    counts = whole.unionByName(more).groupBy(*POINT, "word").agg(F.bit_or("bits").alias("bits")).groupBy(*POINT).agg(F.sum(F.bit_count("bits")).alias(name))
    return with_points(query, counts).withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def best_match(query: DataFrame, db: DataFrame, rule: Rule, order: list[str], values: list[str]) -> DataFrame:
    """query with ``values`` of its best match: the highest score, then the least ``order``.

    A call at the query's own positions beats all others.  For the other queries a cell's bounds leave the cells whose best score isn't below
    what another cell surely has; their scores' maximum is taken first and then the rows that reach it, so pairs are never sorted.
    """
    spots = db.groupBy(*rule.keys, "posA", "posB").agg(F.min(F.struct(*order, *values)).alias("row"))
    points = points_of(query)
    same = [*rule.keys, "posA", "posB"]
    at = spots.select(*[F.col(c).alias(f"__w_{c}") for c in same], "row")
    met = points.join(at, [F.col(c) == F.col(f"__w_{c}") for c in same], "left")
    met = met.withColumn("row", F.when(rule.hit(F.col("posA"), F.col("posB"), F.col("__w_posA"), F.col("__w_posB")), F.col("row"))).drop(*[f"__w_{c}" for c in same])
    rest = met.where("row is null").drop("row")
    right = rule.cells(spots, "d", [], [], ["row"])
    cell = ["chrA", "chrB", "event_type", "qA", "qB"]
    left = rule.cells(rest, "q")
    floor = rule.join(left.drop("qpts"), right.drop("dpts"), rule.certain()).groupBy(*cell).agg(F.max(rule.least_score()).alias("floor")).withColumnsRenamed({c: f"__s_{c}" for c in cell})
    left = left.join(floor, [F.col(c) == F.col(f"__s_{c}") for c in cell], "left").drop(*[f"__s_{c}" for c in cell])
    scored = rule.score(F.col("posA"), F.col("posB"), F.col("__c"), F.col("__e"))
    tops = rule.opened(rule.join(rule.raised(left, "floor"), right, rule.possible()), [], []).groupBy(*POINT).agg(F.max(scored).alias("top"))
    again = rule.cells(tops, "q", [], [F.min("top").alias("floor")], ["top"])
    won = rule.opened(rule.join(rule.raised(again, "floor"), right, rule.possible()), ["top"], ["row"]).where(scored == F.col("top")).groupBy(*POINT).agg(F.min("row").alias("row"))
    found = met.where("row is not null").unionByName(won).select(*POINT, *[F.col(f"row.{v}").alias(v) for v in values])
    return with_points(query, found)
