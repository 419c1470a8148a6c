"""Sites full of calls: the same results as comparing all pairs, by plans that don't compare them."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from breakfold.operators import annotate, cluster

COLS = "qid long, chrA string, chrB string, posA long, posB long, event_type string, sample string"


def dense(n, seed, spread=500):
    r = random.Random(seed)
    out = []
    for k in range(n):
        kind = r.choice(["DEL", "DEL", "INS", "BND"])
        a, b = ("1", "2") if kind == "BND" else ("1", "1")
        pos = r.randrange(spread)
        out.append((k, a, b, pos, pos if kind == "INS" else pos + r.choice([300, 900, 1300]) + r.randrange(150), kind, f"s{r.randrange(70)}"))
    return out + [(n + 1, "1", "1", None, 5, "DEL", "s1"), (n + 2, None, "1", 5, 5, "DEL", "s1"), (n + 3, "1", "1", 200, 90, "DEL", "s2")]


def score(q, d, far, ins, overlap, no_var=False):
    """None for no match, else how similar; written out for one pair."""
    if None in q[1:6] or None in d[1:6] or q[1:3] != d[1:3] or (q[5] != d[5] and not no_var):
        return None
    off = max(abs(q[3] - d[3]), abs(q[4] - d[4]))
    if off > far:
        return None
    if q[1] != q[2]:
        return -off
    if ins is not None and "INS" in q[5]:
        return -off if off <= ins else None
    span = max(q[4], d[4]) - min(q[3], d[3]) + 1
    ratio = (min(q[4], d[4]) - max(q[3], d[3]) + 1) / span if span > 0 else None
    return ratio if ratio is not None and ratio >= overlap else None


@pytest.mark.parametrize(("overlap", "far"), [(0.6, 1000), (0.9, 120), (-0.5, 200)])
def test_table_on_a_dense_site(spark, overlap, far):
    q, d = dense(250, 1), dense(400, 2)
    frame = spark.createDataFrame(d, COLS)
    got = {r.qid: r.occ for r in annotate.annotate_table(spark.createDataFrame(q, COLS).drop("sample"), frame, overlap, far).collect()}
    want = {x[0]: len({y[6] for y in d if score(x, y, far, None, overlap) not in (None, 0) or (x[1] != x[2] and score(x, y, far, None, overlap) == 0)}) for x in q}
    assert got == want


@pytest.mark.parametrize(("no_var", "overlap"), [(False, 0.6), (True, 0.6), (True, 0.9)])
def test_calls_on_a_dense_site(spark, no_var, overlap):
    q, d = dense(250, 3), dense(300, 4)
    query = spark.createDataFrame(q, COLS).drop("sample")
    db = spark.createDataFrame(d, COLS)
    gts = F.transform(F.sequence(F.lit(0), F.lit(69)), lambda i: F.when(F.concat(F.lit("s"), i.cast("string")) == F.col("sample"), "0/1").otherwise("0/0"))
    got = {r.qid: r.occ for r in annotate.annotate_genotypes(query, db.withColumn("gts", gts), 70, overlap, 1000, 40, no_var).collect()}
    assert got == {x[0]: len({y[6] for y in d if score(x, y, 1000, 40, overlap, no_var) is not None}) for x in q}
    known = db.select("chrA", "chrB", "posA", "posB", "event_type", (F.lit(1000) - F.col("qid")).alias("db_ord"), F.col("qid").alias("occ"), F.col("sample").alias("frq"))
    got = {r.qid: r.occ for r in annotate.annotate_best(query, known, overlap, 1000, 40, no_var).collect()}
    first = {}
    for y in d:
        first[y[1], y[2], y[5]] = min(first.get((y[1], y[2], y[5]), 2000), 1000 - y[0])
    want = {}
    for x in q:
        hits = [(s, -first[y[1], y[2], y[5]], y[0] - 1000, y[0]) for y in d if (s := score(x, y, 1000, 40, overlap, no_var)) is not None]
        want[x[0]] = max(hits)[3] if hits else None
    assert got == want


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_best_does_not_sort_pairs(spark):
    q, d = spark.createDataFrame(dense(5, 5), COLS), spark.createDataFrame(dense(5, 6), COLS).withColumns({"db_ord": F.col("qid"), "occ": F.lit(1), "frq": F.lit(0.5)})
    assert "max_by" not in plan(annotate.annotate_best(q, d))


def test_stars_of_copies_stay_small():
    a = np.repeat(np.array([100, 130, 900]), 6000)
    tracemalloc.start()
    stars = cluster._star_fold(a, a + 500, False, 2500.0, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(c, len(near)) for c, near in stars] == [(0, 12000), (12000, 6000)]
    assert peak < 50e6


def test_stars_are_the_scan():
    r = random.Random(3)
    rows = sorted((p, p + r.choice([300, 500, 900]) + r.randrange(40)) for p in (r.randrange(300) // 3 * 3 for _ in range(400)))
    a, b = np.array(rows).T
    for inter, overlap in ((False, 0.8), (True, 0.8), (False, -1.0)):
        ratio = (np.minimum(b[:, None], b) - np.maximum(a[:, None], a) + 1) / (np.maximum(b[:, None], b) - np.minimum(a[:, None], a) + 1)
        near = (np.abs(a[:, None] - a) <= 150) & (np.abs(b[:, None] - b) <= 150) & (inter | (ratio >= overlap))
        taken, want = set(), []
        for i in sorted(range(len(a)), key=lambda i: -near[i].sum()):
            if i not in taken:
                taken |= set(np.flatnonzero(near[i]))
                want.append((i, np.flatnonzero(near[i]).tolist()))
        assert [(c, list(n)) for c, n in cluster._star_fold(a, b, inter, 150.0, overlap)] == want
