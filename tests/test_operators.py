import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from breakfold.functions import overlap as ov
from breakfold.operators import annotate, cluster, export, merge, store
from breakfold.operators.bandjoin import band_join


def one(spark, expr, *values):
    return spark.range(1).select(expr(*[F.lit(v) for v in values])).first()[0]


def test_similarity(spark):
    assert one(spark, ov.overlap_ratio, 100, 199, 100, 199) == 1.0
    assert one(spark, ov.overlap_ratio, 1, 100, 51, 150) == pytest.approx(50 / 150)
    assert one(spark, ov.overlap_ratio, 1, 10, 21, 30) < 0
    assert one(spark, ov.breakpoint_distance, 100, 200, 150, 210) == 50
    assert one(spark, lambda *x: ov.same_interval(*x, 0.5, 10), 1, 100, 20, 100) is False
    assert one(spark, lambda *x: ov.same_interval(*x, 0.5, 19), 1, 100, 20, 100) is True


def random_calls(n, seed, spread=4000):
    r = random.Random(seed)
    out = []
    for k in range(n):
        kind = r.choice(["DEL", "DEL", "INS", "BND"])
        a, b = r.choice([("1", "1"), ("1", "2")]) if kind == "BND" else (r.choice("12"),) * 2
        pos = r.randrange(spread)
        out.append((k, a, b, pos, pos if kind == "INS" else pos + r.randrange(1, 900), kind, r.randrange(3), f"s{r.randrange(4)}", r.choice(["PASS", ".", "q"])))
    return out


COLS = "call_id long, chrA string, chrB string, posA long, posB long, event_type string, source_ord int, sample string, filter string"


@pytest.mark.parametrize(("distance", "how"), [(0, "inner"), (150, "inner"), (150, "left"), (-1, "inner")])
def test_band_join_is_the_cross_join(spark, distance, how):
    rows = random_calls(120, 1)
    df = spark.createDataFrame(rows, COLS)
    left = df.select("call_id", "chrA", "posA")
    right = df.select("chrA", F.col("posA").alias("dA"), F.col("call_id").alias("o"))
    got = sorted(((r.call_id, r.o) for r in band_join(left, right, ["chrA"], "posA", "dA", distance, how).collect()), key=str)
    want = [(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and abs(a[3] - b[3]) <= distance]
    if how == "left":
        want += [(a[0], None) for a in rows if a[0] not in {x for x, _ in want}]
    assert got == sorted(want, key=str)


def runs_by_scan(x, eps, m):
    """The rule told step by step: cores, runs of cores, and later runs over earlier ones."""
    labels, run, last = [None] * len(x), 0, False
    for i in range(len(x)):
        core = i + m - 1 < len(x) and x[i + m - 1] - x[i] < eps
        if core:
            run += not last
            for j in range(i, i + m):
                labels[j] = run
        last = core
    return labels


@pytest.mark.parametrize("m", [2, 3, 5])
def test_run_labels(spark, m):
    r = random.Random(m)
    x = sorted(r.randrange(600) for _ in range(150))
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(x)], "g int, i int, p long")
    got = [row.l for row in cluster.run_labels(df, ["g"], ["p", "i"], "p", 7, m, "l").orderBy("i").collect()]
    assert got == runs_by_scan(x, 7, m)
    with pytest.raises(ValueError):
        cluster.run_labels(df, ["g"], ["p"], "p", 7, 1, "l")


def test_exact_epsilon_is_noise(spark):
    df = spark.createDataFrame([(0, 0, 10), (0, 1, 20)], "g int, i int, p long")
    assert [r.l for r in cluster.run_labels(df, ["g"], ["p"], "p", 10, 2, "l").collect()] == [None, None]


def ratio(a, b):
    return (min(a[4], b[4]) - max(a[3], b[3]) + 1) / (max(a[4], b[4]) - min(a[3], b[3]) + 1)


def links(a, b, overlap, bnd, ins):
    if (a[1], a[2]) != (b[1], b[2]):
        return False
    far = ins if "INS" in a[5] else bnd
    if max(abs(a[3] - b[3]), abs(a[4] - b[4])) > far:
        return False
    if a[1] != a[2]:
        return True
    return abs(a[3] - b[3]) <= bnd and ratio(a, b) >= (-1 if "INS" in a[5] else overlap)


@pytest.mark.parametrize("flags", [{}, {"no_var": True}, {"pass_only": True}, {"no_intra": True}, {"bnd_distance": 30, "ins_distance": 400}])
def test_greedy_merge_is_the_scan(spark, flags):
    rows = random_calls(150, 5)
    df = spark.createDataFrame(rows, COLS).withColumn("line_no", F.col("call_id"))
    bnd, ins = flags.get("bnd_distance", 300), flags.get("ins_distance", 50)
    got = {r.call_id: r.anchor_id for r in cluster.greedy_merge(df, **({"overlap": 0.5, "bnd_distance": 300} | flags)).collect()}
    order = sorted(rows, key=lambda r: (r[3], r[6], r[0]))
    owner = {}
    for n, a in enumerate(order):
        if a[0] in owner:
            continue
        owner[a[0]] = a[0]
        for b in order[n + 1 :]:
            if b[0] in owner or (a[5] != b[5] and not flags.get("no_var")) or (flags.get("no_intra") and a[6] == b[6]):
                continue
            if flags.get("pass_only") and "q" in (a[8], b[8]):
                continue
            if links(a, b, 0.5, bnd, ins):
                owner[b[0]] = a[0]
    assert got == owner


def test_rounds_of_joins_claim_like_the_fold(spark):
    rows = random_calls(120, 9)
    df = spark.createDataFrame(rows, COLS).withColumn("line_no", F.col("call_id"))
    edges = merge.merge_edges(df, 0.5, 300, 50)
    ranks = {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[3], r[6], r[0])))}
    ids = {n: i for i, n in ranks.items()}
    nodes = spark.createDataFrame(list(ranks.items()), "id long, rank long")
    e = spark.createDataFrame([(ranks[r.a], ranks[r.b]) for r in edges.collect()], "a long, b long")
    got = {r.id: ids[r.owner] for r in cluster.first_mis(nodes, e, lambda x: spark.createDataFrame(x.collect(), x.schema)).collect()}
    want = {r.call_id: r.anchor_id for r in cluster.greedy_merge(df, 0.5, 300, 50).collect()}
    assert got == want


def test_star_cover_is_the_scan(spark):
    rows = [r for r in random_calls(150, 3, 1500) if r[5] != "BND"]
    df = spark.createDataFrame(rows, COLS).withColumnsRenamed({"event_type": "var", "call_id": "idx"})
    got = {(r.center_idx, r.idx) for r in cluster.star_cover(df, F.lit(200), F.lit(0.4), ["var", "chrA", "chrB"]).collect()}
    want = set()
    for key in {(r[5], r[1]) for r in rows}:
        own = sorted((r for r in rows if (r[5], r[1]) == key), key=lambda r: (r[3], r[4], r[0]))
        near = {a[0]: [b[0] for b in own if abs(a[3] - b[3]) <= 200 and abs(a[4] - b[4]) <= 200 and ratio(a, b) >= 0.4] for a in own}
        taken = set()
        for a in sorted(own, key=lambda r: -len(near[r[0]])):
            if a[0] not in taken:
                taken |= set(near[a[0]])
                want |= {(a[0], b) for b in near[a[0]]}
    assert got == want


def test_annotation_edges(spark):
    q = spark.createDataFrame([(1, "1", "1", 100, 200, "DEL"), (2, "1", "2", 100, 200, "BND"), (3, "1", "1", 500, 500, "INS")], "qid long, chrA string, chrB string, posA long, posB long, event_type string")
    db = spark.createDataFrame([("DEL", "1", "1", 100, 200, "a"), ("DEL", "1", "1", 105, 201, "a"), ("DEL", "1", "1", 100, 204, "b"), ("BND", "1", "2", 9000, 200, "b"), ("INS", "1", "1", 501, 501, "c")], "var string, chrA string, chrB string, posA long, posB long, sample string")
    got = {r.qid: (r.occ, round(r.frq, 4)) for r in annotate.annotate_table(q, db).collect()}
    assert got == {1: (2, 0.6667), 2: (1, 0.3333), 3: (0, 0.0)}
    assert {r.qid for r in annotate.annotate_table(q, db, max_frq=0.5).collect()} == {2, 3}
    with pytest.raises(ValueError):
        annotate.annotate_table(q, db.limit(0))
    with pytest.raises(ValueError):
        annotate.tag_database(q, "AC", None)


def test_export_validates(spark):
    df = spark.createDataFrame([], "var string, chrA string, chrB string, posA long, posB long, sample string, idx long")
    with pytest.raises(ValueError):
        export.cluster_members(df, overlap=1.5)
    assert export.cluster_members(df).count() == 0
