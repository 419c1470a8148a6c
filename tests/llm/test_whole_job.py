"""Cases in which operators once did less than the whole job."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from breakfold.llm import packing, quality, substring


def grams_by_scan(text, p):
    """Counts of the features of a text, one n-gram after another."""
    out = np.zeros(p.buckets, np.int64)
    for w in text.encode().split():
        out[zlib.crc32(w) % p.buckets] += 1
        m = b"<" + w + b">"
        for n in p.grams:
            for k in range(len(m) - n + 1):
                h = (2166136261 + n) % 2**32
                for c in m[k : k + n]:
                    h = (h ^ c) * 16777619 % 2**32
                out[(h ^ h >> 15) % p.buckets] += 1
    return out


def test_quality_takes_all_of_long_words(monkeypatch):
    p, r = quality.Params(), random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda n: "".join(r.choice(letters) for _ in range(n))
    texts = ["".join(chr(0x4E00 + r.randrange(900)) for _ in range(400)) + "　end", f"ab {word(41)} {word(3000)} ab cd", word(90), "a b"]
    model = quality.Model(np.random.default_rng(0).normal(size=p.buckets).astype(np.float32), 0.1, p)
    for part in (quality.PART, 64, 7):  # words in one part and in many
        monkeypatch.setattr(quality, "PART", part)
        scorer = quality.Scorer(model)
        got = scorer.score(texts)
        for t, s in zip(texts, got, strict=True):
            n = grams_by_scan(t, p)
            ids, share = quality.document_features(t, p, {})
            assert ids.tolist() == np.flatnonzero(n).tolist()
            assert np.allclose(share, n[ids] / n.sum(), rtol=1e-5)
            assert np.isclose(s, 1 / (1 + np.exp(-(n @ model.weight.astype(float) / n.sum() + model.bias))), rtol=1e-9)
        assert max(map(len, scorer.memo)) <= p.longest


def test_quality_tells_texts_without_spaces_by_their_middle():
    r = random.Random(4)
    end = "".join(chr(0x4E00 + r.randrange(900)) for _ in range(30))
    text = lambda y: end + "".join(chr(0x5E00 + 400 * y + r.randrange(300)) for _ in range(300)) + end
    labels = [k % 2 for k in range(80)]
    model = quality.fit([text(y) for y in labels], labels)
    assert ((quality.Scorer(model).score([text(y) for y in labels]) >= 0.5) == np.array(labels, bool)).all()


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t, lang, source in rows], DOCUMENTS)


def test_exact_stage_keeps_one_row_of_each_group(spark):
    rows = [(None, "only null", None, "s"), (None, "with id", "en", None), (3, "with  id", "en", None), (5, "r r", None, None), (5, "r r", None, None), (5, "r r", None, None)]
    rows += [(5, "another of five", "en", "a"), (6, "another of  five", "en", "a"), (None, None, None, None), (None, "", "en", None), (None, "only null", None, "s"), (7, "rr", None, None)]
    rows += [(8, "tie", "en", "x"), (8, "tie", "en", "y")]
    for n in (1, 5):
        out = [tuple(r) for r in corpus_pipeline.unique(spark, documents(spark, rows).repartition(n), "").collect()]
        ties = [r for r in out if r[1] == "tie"]
        empty = [r for r in out if not r[1]]
        assert len(ties) == 1 and len(empty) == 1 and empty[0][0] is None
        want = [(None, "only null", None, "s", 9), (3, "with  id", "en", None, 8), (5, "r r", None, None, 3), (6, "another of  five", "en", "a", 16)]
        assert sorted((r for r in out if r not in ties + empty), key=str) == sorted(want, key=str)


def test_substring_stage_keeps_every_row(spark):
    long = " ".join(f"w{k}" for k in range(120))
    rows = [(None, long, "en", None), (None, None, None, None), (None, "short", None, "s"), (1, long, "en", "a"), (2, "say " + long + " end", None, None), (2, "say " + long + " end", None, None), (2, "say " + long + " end", "de", "b"), (4, "x", None, None), (4, "x", None, None), (5, None, None, None)]
    out = [tuple(r) for r in corpus_pipeline.without_repeats(spark, documents(spark, rows), "").collect()]
    want = [(i, "say end" if i == 2 else t, a, b) for i, t, a, b in rows]
    assert sorted(out, key=str) == sorted(((i, t, a, b, len(t or "")) for i, t, a, b in want), key=str)


def test_packing_fills_bins_from_all_partitions(spark):
    import public_tokenizers

    # 40 documents of 1,101 tokens, then 40 of 901: no two of the first, but one of each fit a sequence
    docs = documents(spark, [(k, "word " * (1100 if k < 40 else 900), None, None) for k in range(80)])
    for rows in (docs.coalesce(1), docs.repartitionByRange(2, "doc_id"), docs.repartition(7)):
        out = packing.pack_documents(rows, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
        assert len(out) == 80 and {r.sequence_id for r in out} == set(range(40))
        by = {}
        for r in sorted(out, key=lambda r: r.offset):
            assert r.offset == by.get(r.sequence_id, 0)
            by[r.sequence_id] = r.offset + r.length
        assert max(by.values()) <= 2048


def test_packing_plan_does_not_grow_with_the_pieces():
    counts = {n: 1_000_000 + 37 * n for n in range(1, 2049)}
    steps, bins = packing.plan(counts)
    assert sum(map(len, steps.values())) < 20_000
    assert bins <= 1.01 * sum(n * k for n, k in counts.items()) / 2048
    for n, own in steps.items():
        assert [s.piece for s in own] == np.cumsum([0, *[s.bins * s.each for s in own]])[:-1].tolist()
        assert sum(s.bins * s.each for s in own) == counts[n]


def test_quality_sample_goes_on_behind_a_text_that_does_not_fit(spark):
    rows = [(k, "good words here" if k % 2 else "BAD!! BAD!!", None, None) for k in range(60)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    first = docs.orderBy(F.xxhash64("doc_id")).first().doc_id
    docs = docs.withColumn("text", F.when(F.col("doc_id") == first, F.expr("repeat('long ', 2000)")).otherwise(F.col("text")))
    model = quality.fit_sample(docs, labels, "quality", quality.Params(most_bytes=5000))
    assert quality.Scorer(model).score(["BAD!! BAD!!", "good words here"]).round().tolist() == [0, 1]


def test_substring_needs_no_earlier_documents(spark):
    long = " ".join(f"w{k}" for k in range(60))
    one, two = (documents(spark, [(k, long, None, None)]) for k in (1, 2))
    index = substring.Index(spark)
    substring.remove_repeats(one, index).collect()
    assert [r.n_removed for r in substring.remove_repeats(two, index).collect()] == [60]
