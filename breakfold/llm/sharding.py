"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups of equal texts never part, and every group is an item.  Items go by falling size into the shard with the tightest
sufficient room, found in a balanced tree.  Items of one size are alike, so the driver packs sizes with their
numbers of groups: as sizes differ, their number is at most the square root of twice all bytes, and it grows with the
variety of lengths rather than with rows.  A step of the plan gives one shard the next items of one size.  Groups are numbered among those
of their size, and each finds its shard by a join with the steps.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_of


class _Node:
    __slots__ = ("key", "left", "level", "right")

    def __init__(self, key):
        self.key, self.left, self.right, self.level = key, None, None, 1


class BinTree:
    """A balanced (AA) tree of (remaining capacity, bin)."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _skew(n):
        if n and n.left and n.left.level == n.level:
            m, n.left = n.left, n.left.right
            m.right = n
            return m
        return n

    @staticmethod
    def _split(n):
        if n and n.right and n.right.right and n.level == n.right.right.level:
            m, n.right = n.right, n.right.left
            m.left = n
            m.level += 1
            return m
        return n

    def add(self, key) -> None:
        def put(n):
            if n is None:
                return _Node(key)
            if key < n.key:
                n.left = put(n.left)
            else:
                n.right = put(n.right)
            return self._split(self._skew(n))

        self.root = put(self.root)

    def tightest(self, size: int):
        """The least key whose remaining capacity is size or more."""
        n, best = self.root, None
        while n:
            if n.key[0] >= size:
                best, n = n.key, n.left
            else:
                n = n.right
        return best

    def remove(self, key) -> None:
        def level(n):
            return n.level if n else 0

        def drop(n, key):
            if n is None:
                return None
            if key < n.key:
                n.left = drop(n.left, key)
            elif key > n.key:
                n.right = drop(n.right, key)
            elif n.left is None:
                return n.right
            elif n.right is None:
                return n.left
            else:
                m = n.right
                while m.left:
                    m = m.left
                n.key = m.key
                n.right = drop(n.right, m.key)
            low = min(level(n.left), level(n.right)) + 1
            if low < n.level:
                n.level = low
                if n.right and n.right.level > low:
                    n.right.level = low
            n = self._skew(n)
            n.right = self._skew(n.right)
            if n.right:
                n.right.right = self._skew(n.right.right)
            n = self._split(n)
            n.right = self._split(n.right)
            return n

        self.root = drop(self.root, key)


def pack_sizes(sizes: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """Best fit of counted items into bins of the capacity: steps (size, number of the first item, how many, bin).

    sizes: (size, count) by falling size.  Each item goes into the bin with the tightest sufficient room, ties to the lower
    bin, and into a new one if none has room; a bin takes items of one size for as long as it has room, as it stays the
    tightest.  Larger items get a bin of their own.  None if more than ``most`` bins were needed.
    """
    tree, steps, bins = BinTree(), [], 0
    for size, count in sizes:
        done = 0
        while done < count:
            found = tree.tightest(size)
            if found is None:
                if bins == most:
                    return None
                found, bins = (max(capacity, size), bins), bins + 1
            else:
                tree.remove(found)
            room, b = found
            n = min(count - done, room // size)
            tree.add((room - n * size, b))
            steps.append((size, done, n, b))
            done += n
    return steps


def even_plan(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """Steps that fill ``shards`` shards near equally: those of the smallest capacity with which best fit needs no more.

    Items above an even share of what is left fill shards of their own.
    """
    left = [(s, n) for s, n in sorted(sizes, reverse=True) if n]
    total, steps, used = sum(s * n for s, n in left), [], 0
    while left and used < shards - 1 and left[0][0] * (shards - used) > total:
        size, n = left[0]
        done = 0
        while done < n and used < shards - 1 and size * (shards - used) > total:
            steps.append((size, done, 1, used))
            total, used, done = total - size, used + 1, done + 1
        left = ([(size, n - done)] if done < n else []) + left[1:]
        if done < n:
            break
    moved = {left[0][0]: sum(k for s, _, k, _ in steps if s == left[0][0])} if left else {}
    free = shards - used
    if not left:
        return steps
    low = max(left[0][0], -(-total // free))
    high = low
    while (best := pack_sizes(left, high, free)) is None:
        high += max(1, high // 1000)
    for _ in range(8):
        if high - low <= high // 100_000:
            break
        mid = (low + high) // 2
        found = pack_sizes(left, mid, free)
        if found is None:
            low = mid + 1
        else:
            high, best = mid, found
    return steps + [(s, at + moved.get(s, 0), n, used + b) for s, at, n, b in best]


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, salts: int = 16, sub_rows: int = 65_536) -> DataFrame:
    """Every row's shard by the law ``bytes``: sizes as equal as indivisible groups of equal texts allow.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard, one row per input row.
    Size is the text's UTF-8 bytes plus ``overhead``; null texts count as empty and are one group
    with the empty ones.  Slots are gapless from 0 in each shard, by a hash of the id, then id;
    repeated rows have slots of their own.  Null ids come first.  An empty table gives an empty result.

    Texts are read once; what travels is a row of some sixty bytes each.  ``sub_rows`` is about how many rows of a shard are
    numbered in one task.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = cut(base.select("doc_id", (F.octet_length("text").cast("long") + overhead).alias("size"), F.crc32("text").alias("text_crc32"), F.unhex(F.sha2("text", 256)).alias("g")).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")))
    # A text that many rows share is counted in parts, and its shard goes to each of them.
    parts = rows.groupBy("g", "salt").agg(F.sum("size").alias("s"))
    groups = parts.groupBy("g").agg(F.sum("s").alias("s"), F.expr("bit_or(shiftleft(1L, salt))").alias("present"))
    # Groups are numbered among those of their size: inside a partition, from what the partitions before hold.
    groups = cut(groups.withColumn("p", F.spark_partition_id()))
    held = groups.groupBy("s", "p").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("s").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("s", "p", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    counts = held.groupBy("s").agg(F.sum("n").cast("long").alias("n")).orderBy(F.desc("s")).toArrow()
    sizes = list(zip(counts["s"].to_pylist(), counts["n"].to_pylist(), strict=True))
    plan = even_plan(sizes, shards)
    columns = np.array(plan, np.int64).reshape(-1, 4).T if plan else np.zeros((4, 0), np.int64)
    steps = spark.createDataFrame([(s, f, f + n, b) for s, f, n, b in columns.T.tolist()], "s long, low long, high long, shard int")
    # Steps of one size are few (a shard each at most), so a group meets them all in one array.
    steps = steps.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("low", "high", "shard"))).alias("steps"))
    number = F.row_number().over(Window.partitionBy("s", "p").orderBy("g")) - 1
    placed = groups.withColumn("number", number).join(held.select("s", "p", "first"), ["s", "p"]).withColumn("number", F.col("number") + F.col("first")).join(steps, "s")
    placed = placed.select("g", "present", F.expr("filter(steps, x -> x.low <= number and number < x.high)[0].shard").alias("shard"))
    spread = placed.select("g", "shard", F.explode(F.expr(f"filter(sequence(0, {salts - 1}), b -> (shiftright(present, b) & 1) = 1)")).alias("salt"))
    told = rows.join(spread, ["g", "salt"]).select("doc_id", "size", "text_crc32", "shard")
    # Slots: each shard's rows are dealt into parts by hash, numbered there, and moved on by the parts before.
    total = sum(n for _, n in sizes) and rows.count()
    subs = max(1, -(-total // (shards * sub_rows)))
    told = told.withColumn("sub", F.expr(f"cast(pmod(xxhash64(doc_id, text_crc32), {subs}) as int)"))
    own = told.groupBy("shard", "sub").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = own.select("shard", "sub", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    w = Window.partitionBy("shard", "sub").orderBy("doc_id", "text_crc32")
    slots = told.withColumn("slot", F.row_number().over(w)).join(offsets.hint("merge"), ["shard", "sub"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot") - 1 + F.col("offset")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
