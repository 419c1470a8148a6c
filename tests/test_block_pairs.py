"""Pairs made block by block: those of a scan, in an order that keeps files small."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from breakfold.operators import blockpairs, merge
from breakfold.plans import registry

COLS = "key string, posA long, posB long, n long, id long"


@pytest.mark.parametrize(("distance", "size", "by_length"), [(60, 16, False), (60, 16, True), (7, 1024, False), (0, 4, True), (-1, 16, False)])
def test_block_pairs_are_the_scan(spark, monkeypatch, distance, size, by_length):
    monkeypatch.setattr(blockpairs, "SLICE", 5)
    r = random.Random(distance)
    rows = [(r.choice("ab"), r.randrange(-150, 150), r.randrange(-150, 150), r.choice([None, 1, 2]), i) for i in range(300)]
    rows += [(None, 1, 1, 1, 900), ("a", None, 1, 1, 901), ("a", 1, None, 1, 902)]
    length = [F.col("posB") - F.col("posA")] if by_length else None
    got = blockpairs.block_pairs(
        spark.createDataFrame(rows, COLS), ["key"], "posA", "posB", ["n", "id"], distance, lambda a, b: (a["id"] + b["id"]) % 3 != 0,
        blocks_by=length, within=length, could=(lambda a, b: a("high", "length") >= b("low", "length") - 40) if by_length else None, size=size,
    )
    got = [(x.l_id, x.r_id) for x in got.collect()]
    rank = lambda x: (x[3] is not None, x[3] or 0, x[4])
    fits = lambda a, b: not by_length or size != 16 or a[2] - a[1] >= b[2] - b[1] - 40
    whole = [x for x in rows if None not in x[:3]]
    want = [(a[4], b[4]) for a in whole for b in whole if a[0] == b[0] and abs(a[1] - b[1]) <= distance and abs(a[2] - b[2]) <= distance and (a[4] + b[4]) % 3 and rank(a) < rank(b)]
    must = {(a[4], b[4]) for a in whole for b in whole if fits(a, b)}
    assert len(got) == len(set(got)) and set(got) <= set(want)
    assert set(want) & must <= set(got)


@pytest.mark.parametrize(("name", "most"), [("box_candidates", 1.0), ("overlap_ratio", 7.5)])
def test_files_of_a_dense_site_are_small(spark, tmp_path, name, most):
    rows, c = [], 0
    for i in range(1800):
        c += 1
        while (c * 31 + 200 * i * 7) % 22:
            c += 1
        rows.append((200 * i, c, "F"))
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string").repartition(4).write.parquet(f"{tmp_path}/orders.parquet")
    registry.QUERIES[name](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    pairs = spark.read.parquet(f"{tmp_path}/out").count()
    assert pairs == 1800 * 1799 // 2
    assert sum(f.stat().st_size for f in Path(tmp_path, "out").glob("*.parquet")) / pairs < most


def test_files_of_a_dense_site_hold_runs_of_whole_blocks(spark, tmp_path):
    """Runs of a multiple of eight repeat byte for byte in Parquet, and a short block is cheap to begin a page with: less than 0.3 bytes a pair where blocks of 1,024 took more."""
    rows, c = [], 0
    for i in range(1801):
        c += 1
        while (c * 31 + 200 * i * 7) % 22:
            c += 1
        rows.append((200 * i, c, "F"))
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string").repartition(4).write.parquet(f"{tmp_path}/orders.parquet")
    registry.QUERIES["box_candidates"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    pairs = spark.read.parquet(f"{tmp_path}/out")
    assert pairs.count() == pairs.distinct().count() == 1801 * 1800 // 2
    assert sum(f.stat().st_size for f in Path(tmp_path, "out").glob("*.parquet")) / pairs.count() < 0.3


def test_sides_share_a_shuffle_and_many_rows_get_more_tasks(spark, monkeypatch):
    rows = spark.range(500).selectExpr("'a' key", "id posA", "id posB", "id")
    plan = lambda **more: blockpairs.block_pairs(rows, ["key"], "posA", "posB", ["id"], 5, lambda a, b: F.lit(True), **more)
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    df = plan()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert "ReusedExchange" in text(plan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert ", 16), REPARTITION_BY_NUM" in text(df)
    monkeypatch.setattr(blockpairs, "TASK_ROWS", 10)
    assert ", 50), REPARTITION_BY_NUM" in text(plan(count=500))
    assert plan(count=500).count() == sum(min(5, 499 - i) for i in range(500))


def test_edges_of_a_dense_site_are_compiled_and_pruned(spark):
    """The loop over pairs must be small enough for the JVM to compile (8,000 bytes a method), and blocks whose lengths are too far apart don't meet."""
    r = random.Random(4)
    rows = [(i, "1", "1", "DEL", a := r.randrange(300), a + r.choice([500, 3000, 9000]) + r.randrange(40), i % 3, i) for i in range(1500)]
    edges = merge.merge_edges(spark.createDataFrame(rows, "call_id long, chrA string, chrB string, event_type string, posA long, posB long, source_ord int, line_no long"))
    want = set()
    for a in rows:
        for b in rows:
            if (a[4], a[6], a[7]) < (b[4], b[6], b[7]) and max(b[4] - a[4], abs(b[5] - a[5])) <= 2000 and (min(a[5], b[5]) - b[4] + 1) / (max(a[5], b[5]) - a[4] + 1) >= 0.95:
                want.add((a[0], b[0]))
    got = [(x.a, x.b) for x in edges.select("a", "b").collect()]
    assert len(got) == len(want) and set(got) == want
    assert "least(l_high_length" in edges._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = edges.select("a", "b")._jdf.queryExecution().executedPlan()
        code = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package").codegenStringSeq(plan).iterator()
        loops = [s._3().maxMethodCodeSize() for s in iter(lambda: code.next() if code.hasNext() else None, None) if "SortMergeJoin" in s._1()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert loops and max(loops) < 8000
