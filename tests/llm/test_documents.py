"""Operators over documents against brute force, with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from breakfold.llm import bpe, exact, neardup, packing, quality, sharding, substring
from breakfold.llm.words import LOWER, runs, sliding_min, words

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, shard int, size long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, 0, False, 7, 7) for i, t in rows], SCHEMA)


def corpus(seed=0, n=60):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randrange(1, 8))) for _ in range(400)]
    text = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    shared = text(70)
    out = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "two words"), (5, "x" * 5000)]
    for i in range(6, n):
        body = text(r.randrange(20, 160))
        if i % 4 == 0:
            body = body[: len(body) // 2] + " " + shared + " " + body[len(body) // 2 :]
        if i % 5 == 0:
            body = out[-1][1] or ""
        if i % 7 == 0:
            w = (out[-2][1] or "").split()
            if w:
                w[r.randrange(len(w))] = "changed"
            body = " ".join(w)
        if i % 11 == 0:
            body = (out[-1][1] or "").upper() + "\n"
        out.append((i, body))
    r.shuffle(out)
    return out


def test_exact(spark):
    rows = [(5, "a b"), (1, "ab "), (3, "a  b"), (9, "ab"), (2, None), (4, " \t\n\x0b\x0c\r"), (6, "c\xa0d"), (7, "cd"), (9, "ab"), (None, "cd"), (None, "zz"), (8, "x" * 100_000)]
    got = sorted((tuple(r) for r in exact.exact_dedup(frame(spark, rows)).collect()), key=str)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    want = []
    for i, t in rows:
        group = [(j, u) for j, u in rows if norm(u) == norm(t)]
        keep = min(group, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))[0]
        want.append((i, keep, len(group), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert exact.exact_dedup(frame(spark, [])).count() == 0
    kept = exact.keep_first(frame(spark, [x for x in rows if x[0] is not None and x[0] != 9]))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 6, 7, 8] and kept.columns == frame(spark, []).columns


def test_exact_extremes(spark):
    rows = [(-(2**63), "a"), (2**63 - 1, "a"), (0, "a ")]
    assert {(r.doc_id, r.keep_id) for r in exact.exact_dedup(frame(spark, rows)).collect()} == {(i, 0) for i, _ in rows}
    rows = [(-(2**63), "a"), (2**63 - 1, "a")]
    assert {r.keep_id for r in exact.exact_dedup(frame(spark, rows)).collect()} == {-(2**63)}


@pytest.fixture(scope="module")
def tok():
    return bpe.Bpe(bpe.load_ranks(bpe.read_file(RANKS)), public_tokenizers.PATTERN)


def test_perfect_hash(tok):
    assert sorted(tok.table.find(k) for k in tok.ranks) == list(range(len(tok.ranks)))
    assert tok.table.find(b"no such token at all") == -1
    assert bpe.PerfectHash([]).find(b"a") == -1


def strange_texts():
    r = random.Random(2)
    out = ["", " ", "  ", "\n", "a   b", " \n x", "x \n\n  y\t z", "it's  I'LL don't", "<|endoftext|> x", "  a　 b", "é \U0001f600‍", "x" * 3000, "0123 456  7", "tail ", " head", "a \x1c b"]
    return out + ["".join(r.choice(" \n\tab'é1. Ω") for _ in range(r.randrange(40))) for _ in range(300)]


def test_bpe_is_tiktoken(spark, tok):
    import tiktoken

    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tok.ranks, special_tokens={})
    texts = strange_texts()
    chunks = tok.chunk_encoder()
    for t, ids in zip(texts, chunks.texts(texts), strict=True):
        want = e.encode_ordinary(t)
        assert ids.tolist() == want, repr(t)
        assert tok.encode(t) == want
        assert tok.decode(want).decode() == t
    rows = list(enumerate(texts)) + [(None, None), (0, texts[0])]
    got = bpe.encode_documents(frame(spark, rows), RANKS, public_tokenizers.PATTERN, with_ids=True).collect()
    assert len(got) == len(rows)
    for r in got:
        t = texts[r.doc_id] if r.doc_id is not None else ""
        ids = e.encode_ordinary(t)
        assert (r.n_tokens, list(r.ids), bytes(r.decoded)) == (len(ids), ids, t.encode())
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert bpe.encode_documents(frame(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_texts_with_blank_lines_are_encoded_in_bounded_memory(tok):
    import tiktoken

    e = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tok.ranks, special_tokens={})
    chunks = tok.chunk_encoder()
    r = random.Random(8)
    words = ["the", "na\u00efve", "x=1;", "\x1cq", "!\x1c", "\u3000", "\u00a0", "12", "'s"]
    made = ["".join(r.choice(words) + r.choice([" ", "  ", "\n", "\n\n", " \n\n ", "\t", " \u2003"]) for _ in range(60)) + r.choice(["", "u" * 300, "  "]) for _ in range(3000)]
    for text, ids in zip(made, chunks.texts(made), strict=True):
        assert ids.tolist() == e.encode_ordinary(text)
    # What is held are short chunks, of which texts share many, and neither whole texts nor their long words.
    assert max(map(len, chunks.memo)) <= chunks.longest
    assert sum(map(len, chunks.memo)) < sum(map(len, made)) / 5 and chunks.end < sum(map(len, made)) / 5


def test_packing_ids_are_those_of_tokenizers(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    encode = packing.token_encoder(packing.read_file(RANKS), public_tokenizers.PATTERN, packing.added_tokens(packing.read_file(path)))
    texts = [*strange_texts(), "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>y  <|endoftext|", "<|endoftext|>\n\n z"]
    assert encode("a <|endoftext|> b") == [64, 220, 50256, 275]
    for text, enc in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encode(text) == enc.ids, repr(text)


def test_pack():
    r = random.Random(4)
    lengths = [r.randrange(1, 2049) for _ in range(3000)]
    for w in (packing.Weights(), packing.Weights(rule="dot")):
        bins, n = packing.pack(lengths, weights=w)
        assert max(np.bincount(bins, weights=lengths)) <= 2048
        assert n <= sum(lengths) / 2048 * 1.02 + 1 or w.rule == "dot"
    bins, n = packing.pack([10] * 100, packing.Capacities(documents=3))
    assert n == 34 and max(np.bincount(bins)) == 3
    bins, _ = packing.pack([600] * 30, packing.Capacities(2048, 10, 2048**2))
    assert max(np.bincount(bins)) == 3
    assert packing.pack([]) == ([], 0)
    for bad in (0, 2049):
        with pytest.raises(ValueError):
            packing.pack([bad])
    with pytest.raises(ValueError):
        packing.pack([1], packing.Capacities(attention=5))


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_bins_are_those_of_a_scan_under_every_capacity(rule):
    """Each piece goes where the rule's score is best among all bins that hold it under three capacities."""
    r = random.Random(12)
    lengths = [r.choice([3, 3, 5, 5, 9, 17, 40, 41, 64]) for _ in range(400)]
    cap, w = packing.Capacities(64, 3, 64 * 64), packing.Weights(0.5, 1.0, 2.0, rule)
    bins: list[list[int]] = []

    def score(b, n):
        t, d, a = cap.tokens - sum(b), cap.documents - len(b), cap.attention - sum(x * x for x in b)
        if t < n or d < 1 or a < n * n:
            return None
        wt, wd, wa = w.tokens / cap.tokens**2, w.documents / cap.documents**2, w.attention / cap.attention**2
        value = wt * (t - n) ** 2 + wd * (d - 1) ** 2 + wa * (a - n * n) ** 2 if rule == "norm" else -(wt * n * t + wd * d + wa * n * n * a)
        return value, d, a

    for n in sorted(lengths, reverse=True):
        fits = [(s, k) for k, b in enumerate(bins) if (s := score(b, n)) is not None]
        if fits:
            bins[min(fits)[1]].append(n)
        else:
            bins.append([n])
    got, count = packing.pack(lengths, cap, w)
    made = [sorted((n for n, b in zip(lengths, got, strict=True) if b == k), reverse=True) for k in range(count)]
    assert sorted(made) == sorted(bins)
    assert any(len(b) == cap.documents and sum(b) < cap.tokens for b in made)  # the number of documents binds


def test_pack_documents(spark):
    rows = [*corpus(1), (900, "word " * 9000), (None, "no id"), (901, "word " * 2047)]
    out = packing.pack_documents(frame(spark, rows).repartition(2), RANKS, public_tokenizers.PATTERN, with_ids=True).collect()
    encode = packing.token_encoder(packing.read_file(RANKS), public_tokenizers.PATTERN)
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *r.ids)) and len(r.ids) == r.length
    for i, t in rows:
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [x for r in pieces for x in r.ids] == [*encode(t or ""), 0]
        assert all(r.length == 2048 for r in pieces[1:]) and [r.piece for r in pieces] == list(range(len(pieces)))
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack_documents(frame(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def removed_by_scan(rows, width):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        own = [tuple(w[k : k + width]) for k in range(len(w) - width + 1)]
        gone = {j for k, x in enumerate(own) if x in seen for j in range(k, k + width)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
        seen.update(own)
    return out


@pytest.mark.parametrize("width", [50, 7])
def test_substring(spark, width):
    rows = corpus(3)
    want = removed_by_scan(rows, width)
    p = substring.Params(width=width, fan=2)
    got = {r[0]: tuple(r[1:]) for r in substring.remove_repeats(frame(spark, rows), substring.Index(spark, p)).collect()}
    assert got == want
    assert any(x[1] for x in want.values())
    index, got = substring.Index(spark, p), {}
    for lo, hi in ((0, 20), (20, 45), (45, 99)):
        part = frame(spark, [x for x in rows if lo <= x[0] < hi])
        got |= {r[0]: tuple(r[1:]) for r in substring.remove_repeats(part, index).collect()}
    assert got == want
    assert [len(x) for x in index.levels["anchors"]] == [1, 1] and index.compacted == 2
    index.close()


def test_substring_meets_history_in_the_runs(spark):
    """Later batches need no earlier documents, and an earlier text is read again for an anchor that becomes shared, and only then."""
    r = random.Random(6)
    line = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    passage, fifty = line(60), line(50)
    rows = [(k, f"{line(30)} {passage if k % 3 == 0 else line(10)} {line(30)} {fifty if k in (2, 7, 23) else ''}") for k in range(24)]
    index, got = substring.Index(spark), {}
    for lo in range(0, 24, 8):
        out = substring.remove_repeats(frame(spark, rows[lo : lo + 8]), index)
        got |= {x[0]: tuple(x[1:]) for x in out.collect()}
    assert got == removed_by_scan(rows, 50)
    assert got[7][1] == 50 and got[23][1] == 50 and got[9][1] == 60
    out = substring.ingest(frame(spark, rows[::-1]).repartition(3), substring.Index(spark))
    assert {x[0]: tuple(x[1:]) for x in out.collect()} == got


def test_runs_are_joined_without_shuffling_them(spark):
    index = substring.Index(spark)
    for n in (1, 2):
        index.write("anchors", spark.range(50).selectExpr("id * 7 as anchor", f"id + {n} as first", "id as last"))
    one, two = index.runs("anchors")
    plan = substring._with_older(one, [two], ["anchor"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_substring_edges(spark):
    def run(rows, **kw):
        return sorted((tuple(r) for r in substring.remove_repeats(frame(spark, rows), substring.Index(spark), **kw).collect()), key=str)

    assert run([]) == [] and substring.ingest(frame(spark, []), substring.Index(spark)).collect() == []
    long = " ".join(f"w{k}" for k in range(120))
    out = run([(None, long), (1, long), (2, long + " end"), (3, None)], with_text=True)
    assert {(r[0], r[1], r[2], r[4]) for r in out} == {(None, 120, 0, long), (1, 120, 0, long), (2, 121, 120, "end"), (3, 0, 0, None)}
    # rows of one id have the results of their own texts
    other = " ".join(f"x{k}" for k in range(70))
    out = run([(1, long), (5, long), (5, other), (5, other), (7, other + " " + long)])
    assert [(r[0], r[1], r[2]) for r in out] == [(1, 120, 0), (5, 120, 120), (5, 70, 0), (5, 70, 0), (7, 190, 190)]


def sets_of(rows, n):
    out = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOWER))
        out[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    return out


def components_by_scan(sets, percent):
    ids = sorted(sets)
    root = {i: i for i in ids}
    changed = True
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    return root


@pytest.mark.parametrize("p", [neardup.Params(), neardup.Params(block=3), neardup.Params(shingle=5, percent=80, rows=4, bands=30)])
def test_near_duplicates(spark, p):
    rows = corpus(6, 70)
    sets = sets_of(rows, p.shingle)
    root = components_by_scan(sets, p.percent)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, rows), p).collect()}
    assert got == {i: (len(sets[i]), root[i], root[i] == i) for i, _ in rows}
    assert len(set(root.values())) < len(rows)


def test_near_duplicate_edges(spark):
    out = neardup.near_duplicates(frame(spark, []))
    assert out.count() == 0
    rows = [(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (7, "A B C D"), (8, None), (9, "")]
    got = sorted((tuple(r) for r in neardup.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (4, 2, 4, True), (4, 2, 4, True), (7, 2, 4, False), (8, 0, 8, True), (9, 0, 9, True)], key=str)


def test_chain_links_where_no_centre_is_similar_to_all(spark):
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(12):
        base[i * 16] = f"x{i}"
        rows.append((i, " ".join(base)))
    assert {r.component_id for r in neardup.near_duplicates(frame(spark, rows)).collect()} == {0}


@pytest.mark.parametrize("block", [8, 64])
def test_near_duplicates_in_blocks(spark, block):
    """A group of many blocks: variants of one text, some that only others link, and a chain away from the centre."""
    r = random.Random(4)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(120):
        w = base[:]
        for k in r.sample(range(150), 2 if i % 3 else 6):
            w[k] = f"z{r.randrange(1000)}"
        rows.append((i, " ".join(w)))
    for step in range(30):
        rows.append((500 + step, " ".join([f"q{k}" for k in range(step)] + base[step:])))
    sets = sets_of(rows, 3)
    want = components_by_scan(sets, 85)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, rows).repartition(5), neardup.Params(block=block)).collect()}
    assert got == want


def test_clusters_are_those_of_all_pairs():
    r = np.random.default_rng(1)
    for n in (2, 5, 40):
        for share in (0.02, 0.2, 0.9):
            link = r.random((n, n)) < share
            link |= link.T
            known = r.random(n) < 0.3
            full = link | np.outer(known, known) | np.eye(n, dtype=bool)
            want = np.arange(n)
            for _ in range(n):
                want = np.array([want[full[i]].min() for i in range(n)])
            got = neardup._clusters(n, lambda i, rest: link[i, rest], known)
            assert (got == want).all()
            a, b = neardup._edges(np.arange(n), got, known)
            assert len(a) < n


def test_hash_runs():
    h = np.random.default_rng(0).integers(0, 2**63, 90).astype(np.uint64)
    for n in (1, 2, 3, 5, 25, 50, 90, 91):
        got = runs(h, n)
        assert len(got) == max(0, 91 - n)
        assert len(set(got.tolist())) == len(got)
        again = runs(h[3:], n)
        assert again.tolist() == got[3:].tolist()
        assert sliding_min(h, n).tolist() == [int(h[k : k + n].min()) for k in range(max(0, 91 - n))]
    assert words("a\x1cb c\x85d") == [b"a\x1cb", "c\x85d".encode()]


def test_shards(spark):
    rows = [*corpus(8), *[(1000 + k, "hot text " * 30) for k in range(40)], (None, "x"), (3, "one")]
    out = sharding.assign_shards(frame(spark, rows), 4).collect()
    assert len(out) == len(rows)
    text_of = {}
    for i, t in rows:
        text_of.setdefault(i, t or "")
    shards, by_text = {}, {}
    for r in out:
        t = text_of[r.doc_id]
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(t.encode()) + 16, zlib.crc32(t.encode()), "bytes", None)
        shards.setdefault(r.shard, []).append(r)
        by_text.setdefault(t, set()).add(r.shard)
    assert all(len(x) == 1 for x in by_text.values())
    sizes = [sum(r["size"] for r in x) for x in shards.values()]
    assert len(sizes) == 4
    assert sorted(sizes)[-2] - min(sizes) <= 0.1 * max(sizes) or max(sizes) < 1.1 * min(sizes)
    for x in shards.values():
        assert sorted(r.slot for r in x) == list(range(len(x)))
    assert sharding.assign_shards(frame(spark, []), 4).count() == 0


def counted(items):
    return sorted(Counter(items).items(), reverse=True)


def test_best_fit():
    r = random.Random(1)
    items = [r.randrange(1, 100) for _ in range(300)]
    loads: list[int] = []
    placed = Counter()
    for size in sorted(items, reverse=True):
        fits = [(100 - load - size, b) for b, load in enumerate(loads) if load + size <= 100]
        b = min(fits)[1] if fits else len(loads)
        loads += [0] * (b == len(loads))
        loads[b] += size
        placed[size, b] += 1
    got = Counter()
    for size, _, n, b in sharding.pack_sizes(counted(items), 100):
        got[size, b] += n
    assert got == placed
    assert sharding.pack_sizes(counted(items), 100, 3) is None and sharding.pack_sizes([(500, 2)], 100) == [(500, 0, 1, 0), (500, 1, 1, 1)]


def test_even_plan():
    def loads(items, shards):
        out = [0] * shards
        seen: dict = {}
        for size, at, n, b in sharding.even_plan(counted(items), shards):
            out[b] += size * n
            seen.setdefault(size, []).append((at, n))
        for size, n in Counter(items).items():  # every item once
            ends = sorted(seen[size])
            assert [a for a, _ in ends] == [sum(k for _, k in ends[:j]) for j in range(len(ends))] and sum(k for _, k in ends) == n
        return sorted(out)

    r = random.Random(3)
    assert loads([10] * 40, 8) == [50] * 8
    assert sharding.even_plan([], 3) == []
    assert loads([1000, *[1] * 90], 4) == [30, 30, 30, 1000]
    assert loads([7, 7, 7], 2) == [7, 14]
    many = loads([r.randrange(20, 4000) for _ in range(5000)], 40)
    assert many[-1] - many[0] <= 0.002 * many[0]
    for shards in (1, 2, 5):
        items = [r.choice([1, 2, 3, 50, 500]) for _ in range(60)]
        assert sum(loads(items, shards)) == sum(items)


def quality_rows(n=500):
    r = random.Random(5)
    w = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(600)]
    out = []
    for i in range(n):
        text = [r.choice(w) for _ in range(r.randrange(5, 60))]
        y = r.random() < 0.6
        kind = r.randrange(3)
        if not y:
            text = [x.upper() + "!!" for x in text] if kind == 0 else [x + r.choice(["***", "%%%"]) for x in text] if kind == 1 else [x for x in text for _ in range(4)]
        out.append((i, " ".join(text), int(y)))
    return out


def test_quality(spark):
    rows = quality_rows()
    docs = frame(spark, [(i, t) for i, t, _ in rows] + [(10_000, None), (10_001, ""), (None, "a b")])
    labels = spark.createDataFrame([(i, y, None) for i, _, y in rows] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, text string")
    model = quality.fit_sample(docs, labels, "quality", held_out=quality.quarter_held_out)
    assert model.weight.tobytes() == quality.fit_sample(docs.repartition(3), labels.repartition(2), "quality", held_out=quality.quarter_held_out).weight.tobytes()
    got = {r.doc_id: r.score for r in quality.score_documents(docs, model).collect()}
    assert len(got) == len(rows) + 3 and all(0 <= s <= 1 for s in got.values())
    assert got[10_000] == got[10_001]
    held = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.95
    assert {r.doc_id for r in quality.keep_good(docs, model, 0.5).collect()} == {i for i, s in got.items() if s >= 0.5}
    none = quality.fit_sample(docs, labels.where("false"), "quality")
    assert {r.score for r in quality.score_documents(docs, none).collect()} == {0.5}
    assert quality.fit(["a"], [1]).bias > 3
    flags = docs.select("doc_id", quality.quarter_held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in flags)
