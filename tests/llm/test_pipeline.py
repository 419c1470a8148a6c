"""The pipeline on the smallest tables, its stages against brute force on their own inputs."""

import random

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from breakfold.llm import queries

from .test_documents import components_by_scan, removed_by_scan, sets_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, SF).write.parquet(f"{folder}/{k}")
        after = spark.read.parquet(f"{folder}/{k}")
        out.append((docs, after))
        docs = after
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns(staged):
    for before, after in staged[:-1]:
        assert after.dtypes == before.dtypes


def test_quality_keeps_what_is_labelled_good(spark, staged):
    before, after = staged[0]
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    kept = {r.doc_id for r in after.collect()}
    assert len(good - kept) <= 0.02 * len(good)
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    assert len(bad & kept) <= 0.2 * len(bad)


def test_exact_stage(staged):
    norm = lambda t: "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r")
    before, after = map(pairs, staged[1])
    keep = {}
    for i, t in before:
        keep[norm(t)] = min(keep.get(norm(t), (1, 0)), (-len(t or ""), i))
    assert sorted(i for i, _ in after) == sorted(i for _, i in keep.values())


def test_near_stage(staged):
    before, after = map(pairs, staged[2])
    root = components_by_scan(sets_of(before, 5), 80)
    assert sorted(i for i, _ in after) == sorted(i for i in root if root[i] == i)


def test_substring_stage(staged):
    before, after = map(pairs, staged[3])
    want = removed_by_scan(before, 50)
    got = dict(after)
    assert set(got) == set(want)
    for i, t in before:
        assert len((got[i] or "").split(" ")) == want[i][0] - want[i][1] if want[i][1] and want[i][0] > want[i][1] else got[i] in (t, "")


def test_packed_stage(staged):
    before, after = staged[4]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}


def test_run(spark, staged):
    out = corpus_pipeline.run(spark, SF)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, out.select(*key).collect())) == sorted(map(tuple, staged[-1][1].select(*key).collect()))


def test_stages_take_nulls_repeated_rows_and_empty_tables(spark):
    r = random.Random(1)
    line = lambda n: " ".join("".join(r.choice("aeioulnrst") for _ in range(5)) for _ in range(n))
    shared, text = line(60), line(80)
    rows = [(None, text, None, None, None), (None, None, None, None, None), (1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text + " more", "en", "s", 1), (3, line(20) + " " + shared, None, "s", None)]
    rows += [(4, shared + " " + line(20), "en", None, 7), (4, shared + " " + line(20), "en", None, 7), (5, "", "", "", 0), (6, "x " * 3000, "en", "s", 6000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for kept in (rows, []):
        docs = spark.createDataFrame(kept, schema)
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            got = out.collect()
            assert out.columns == docs.columns or stage is corpus_pipeline.packed
            assert len(got) <= len(kept) or stage is corpus_pipeline.packed
            docs = spark.createDataFrame(got, out.schema) if stage is not corpus_pipeline.packed else out
            if stage is corpus_pipeline.good:
                docs = spark.createDataFrame(kept, schema)  # what the others get doesn't depend on the model
            if stage is corpus_pipeline.unique and kept:
                assert sorted(x.doc_id for x in got if x.doc_id) == [1, 2, 3, 4, 4, 5, 6]  # the two texts of id 4 differ; empty texts are one group
            if stage is corpus_pipeline.distinct and kept:
                assert 2 not in {x.doc_id for x in got} and {1, 3, 4, 6} <= {x.doc_id for x in got}
            if stage is corpus_pipeline.without_repeats and kept:
                texts = {x.doc_id: x.text for x in got}
                assert shared in texts[3] and shared not in texts[4]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    rel = con.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(rel.columns)
    assert sorted(map(str, map(tuple, got.select(*sorted(rel.columns)).collect()))) == sorted(map(str, rel.select(", ".join(f'"{c}"' for c in sorted(rel.columns))).fetchall()))


def test_all_ten_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
