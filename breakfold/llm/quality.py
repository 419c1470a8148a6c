"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its features: each word occurrence gives its
own hashed vector and those of its hashed character n-grams.  A softmax layer on the average
gives the class.  Vectors and layer are trained together by stochastic gradient descent in
numpy, on a bounded sample of labelled rows.

Only the difference of the two classes' outputs counts for the score, and it is linear in the
average; so the model that scores is one number per hash bucket (the bucket's vector times the
layer's difference), which is small and of fixed size.

One feature goes beyond hashed words and n-grams: word bigrams whose two words are equal share one learned
vector, whatever the word.  An average of words can't tell a text that says each new word many times over; with
plain hashed bigrams in its place, a quarter of the held-out label-0 documents scored above 0.7 (README).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, give_back, small_batches


@dataclass(frozen=True)
class Params:
    buckets: int = 1 << 16
    dims: int = 8
    grams: tuple[int, ...] = (2, 3)
    longest: int = 40  # a longer word isn't held in memos; its n-grams count like those of others
    epochs: int = 4
    least_steps: int = 6000  # small samples are gone through more often
    rate: float = 0.5
    seed: int = 7
    #: The sample that is fitted: labelled rows in the order of a hash of their id, up to so many rows and bytes of text.
    most_rows: int = 4000
    most_bytes: int = 32_000_000


#: Bytes of words that are hashed at once.
PART = 1 << 20


def _grams(buf: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n bytes (FNV-1a on 32 bits)."""
    h = np.full(len(buf) - n + 1, 2166136261 + n, np.uint32)
    for j in range(n):
        h = (h ^ buf[j : len(buf) - n + 1 + j]) * np.uint32(16777619)
    h ^= h >> np.uint32(15)
    return h


def word_features(words: list[bytes], p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the words and of their character n-grams, word after word, and how many each word has.

    Words get a mark at both ends.  n-grams of a run of bytes are hashed at once.
    """
    mask = np.uint32(p.buckets - 1)
    marked = [b"<" + w + b">" for w in words]
    buf = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
    lens = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.cumsum(lens)
    owner = np.repeat(np.arange(len(words)), lens)
    whole = np.fromiter((zlib.crc32(w) for w in words), np.uint32, len(words))
    parts, owners = [whole & mask], [np.arange(len(words))]
    for n in p.grams:
        if len(buf) < n:
            continue
        h = _grams(buf, n)
        inside = np.arange(len(h)) + n <= ends[owner[: len(h)]]
        parts.append((h & mask)[inside])
        owners.append(owner[: len(h)][inside])
    own = np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return np.concatenate(parts)[order].astype(np.int64), np.bincount(own, minlength=len(words))


def _sliced(word: bytes, p: Params) -> Iterator[np.ndarray]:
    """The features of one word, of any length, in parts of bounded size."""
    mask = np.uint32(p.buckets - 1)
    yield np.array([zlib.crc32(word) & int(mask)], np.int64)
    marked = np.frombuffer(b"<" + word + b">", np.uint8)
    for n in p.grams:
        for at in range(0, len(marked) - n + 1, PART):
            yield (_grams(marked[at : at + PART + n - 1].astype(np.uint32), n) & mask).astype(np.int64)


def feature_parts(words: list[bytes], p: Params) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Where a part's words start in the list, their features and how many each has; a word longer than PART comes in several parts."""
    at, size = 0, 0
    for k, w in enumerate(words):
        if k > at and size + len(w) > PART:
            yield at, *word_features(words[at:k], p)
            at, size = k, 0
        if len(w) > PART:
            for flat in _sliced(w, p):
                yield k, flat, np.array([len(flat)])
            at = k + 1
        else:
            size += len(w)
    if at < len(words):
        yield at, *word_features(words[at:], p)


def repeats(words: list[bytes]) -> list[bytes]:
    """Word bigrams whose two words are the same, as one feature word whatever the word is."""
    return [SAME for a, b in pairwise(words) if a == b]


#: No word holds a space, so this is none.
SAME = b" same "


def document_features(text: str | None, p: Params, memo: dict[bytes, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a document and their shares of all its features."""
    words = (text or "").encode().split()
    counts = Counter(words)
    counts.update(repeats(words))
    if not counts:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    short = [w for w in counts if len(w) <= p.longest]
    new = [w for w in short if w not in memo]
    for at, flat, lens in feature_parts(new, p):
        memo.update(zip(new[at : at + len(lens)], np.split(flat, np.cumsum(lens)[:-1]), strict=True))
    total = np.zeros(p.buckets)
    if short:
        lists = [memo[w] for w in short]
        times = np.repeat(np.fromiter((counts[w] for w in short), np.float64, len(short)), [len(x) for x in lists])
        total += np.bincount(np.concatenate(lists), times, p.buckets)
    long = [w for w in counts if len(w) > p.longest]
    times = np.fromiter((counts[w] for w in long), np.float64, len(long))
    for at, flat, lens in feature_parts(long, p):
        total += np.bincount(flat, np.repeat(times[at : at + len(lens)], lens), p.buckets)
    ids = np.flatnonzero(total)
    share = total[ids].astype(np.float32)
    return ids.astype(np.int32), share / share.sum()


@dataclass(frozen=True)
class Model:
    """weight: the score's change of log odds for each bucket; bias: the log odds of no features."""

    weight: np.ndarray
    bias: float
    params: Params


def fit(texts: list[str | None], labels: list[int], params: Params = Params()) -> Model:
    """Trained in the given order, shuffled by a fixed seed; the result depends on nothing else.

    Without rows, or with one class only, the model scores that class's share (0.5 if none) everywhere.
    """
    p = params
    y = np.asarray(labels, np.int64)
    if len(set(labels)) < 2:
        share = 0.5 if not labels else (0.999 if labels[0] else 0.001)
        return Model(np.zeros(p.buckets, np.float32), float(np.log(share / (1 - share))), p)
    rng = np.random.default_rng(p.seed)
    memo: dict[bytes, np.ndarray] = {}
    docs = [document_features(t, p, memo) for t in texts]
    vectors = rng.uniform(-1 / p.dims, 1 / p.dims, (p.buckets, p.dims)).astype(np.float32)
    layer, bias = np.zeros((2, p.dims), np.float32), np.zeros(2, np.float32)
    weigh = len(y) / (2.0 * np.bincount(y, minlength=2))  # both classes count alike
    weigh /= weigh.max()
    epochs = max(p.epochs, -(-p.least_steps // len(docs)))
    steps, step = epochs * len(docs), 0
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            ids, share = docs[k]
            rate = p.rate * (1 - step / steps) * weigh[y[k]]
            step += 1
            own = vectors[ids]
            hidden = share @ own
            z = layer @ hidden + bias
            e = np.exp(z - z.max())
            grad = e / e.sum()
            grad[y[k]] -= 1
            back = grad @ layer
            layer -= rate * np.outer(grad, hidden)
            bias -= rate * grad
            if len(ids):
                # the share of a feature is small, so its vector's step is scaled up as if each feature stood alone
                vectors[ids] = own - (rate * min(50.0, len(ids) ** 0.5)) * np.outer(share, back)
    diff = layer[1] - layer[0]
    # Back from the balanced classes to those of the sample.
    prior = float(np.log(weigh[0] / weigh[1]))
    return Model((vectors @ diff).astype(np.float32), float(bias[1] - bias[0]) + prior, p)


def fit_sample(docs: DataFrame, labels: DataFrame, target: str, params: Params = Params(), held_out=None, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id") -> Model:
    """Fits on labelled rows whose id isn't held out; the sample's bound is in Params.

    Rows without id or label are no examples.  A row labelled twice is two examples.
    """
    lab = labels.select(F.col(label_id).cast("long").alias("id"), F.col(target).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    if held_out is not None:
        lab = lab.where(~held_out(F.col("id")))
    order = [F.xxhash64("id"), "id", "y"]
    # Twice the sample's rows may be looked at, as some have no document.
    lab = lab.orderBy(*order).limit(2 * params.most_rows)
    ids = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sizes = ids.select("id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).join(F.broadcast(lab), "id").orderBy(*order).limit(params.most_rows).collect()
    chosen, size = [], 0
    for r in sizes:
        if size + r.n > params.most_bytes:
            continue  # one very long text doesn't end the sample
        size += r.n
        chosen.append((r.id, r.y))
    if not chosen:
        return fit([], [], params)
    wanted = docs.sparkSession.createDataFrame(sorted(set(chosen)), "id long, y int")  # most_rows at most
    rows = ids.join(F.broadcast(wanted), "id").collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.id).encode()), r.id, r.y, r.text or ""))
    model = fit([r.text for r in rows], [r.y for r in rows], params)
    del rows
    give_back()
    return model


class Scorer:
    """Scores texts with a bounded memo of words; long words aren't held in it."""

    def __init__(self, model: Model, most: int = 400_000):
        self.model, self.most, self.memo = model, most, {}
        self.sums, self.counts = [], []

    def _weigh(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The sum of each word's features and their number."""
        sums, counts = np.zeros(len(words)), np.zeros(len(words), np.int64)
        for at, flat, lens in feature_parts(words, self.model.params):
            sums[at : at + len(lens)] += np.add.reduceat(self.model.weight[flat].astype(np.float64), np.cumsum(lens) - lens)
            counts[at : at + len(lens)] += lens
        return sums, counts

    def _learn(self, words: list[bytes]) -> None:
        sums, counts = self._weigh(words)
        at = len(self.memo)
        self.memo.update(zip(words, range(at, at + len(words)), strict=True))
        self.sums, self.counts = np.concatenate((self.sums, sums)), np.concatenate((self.counts, counts))

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        longest = self.model.params.longest
        for at in range(0, len(texts), 64):
            split = [(t or "").encode().split() for t in texts[at : at + 64]]
            split = [w + repeats(w) for w in split]
            if len(self.memo) > self.most:
                self.memo, self.sums, self.counts = {}, [], []
            known = self.memo
            new = sorted({w for words in split for w in words if w not in known})
            long = [w for w in new if len(w) > longest]
            if long:
                new = [w for w in new if len(w) <= longest]
                rare = dict(zip(long, zip(*self._weigh(long), strict=True), strict=True))
            if new:
                self._learn(new)
            for k, words in enumerate(split, at):
                if words:
                    others = [rare[w] for w in words if len(w) > longest] if long else []
                    if others:
                        words = [w for w in words if len(w) <= longest]
                    ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                    total, n = (self.sums[ids].sum(), self.counts[ids].sum()) if words else (0.0, 0)
                    out[k] = (total + sum(x for x, _ in others)) / (n + sum(c for _, c in others))
        return 1 / (1 + np.exp(-np.clip(out + self.model.bias, -500, 500)))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row; nothing but the whole text counts.

    Null and empty texts get the model's score of no features; repeated rows get equal scores.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # fixed size: buckets * 4 bytes

    def run(batches):
        scorer = Scorer(sent.value)
        for b in batches:
            scores = scorer.score(b.column("text").to_pylist())
            yield batch_of(["doc_id", "score"], [pa.int64(), pa.float64()], [b.column("doc_id"), scores])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is ``least`` or more, with all their columns."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(sent.value)
        for b in batches:
            kept = scorer.score(b.column(text_col).to_pylist()) >= least
            if kept.any():
                yield b.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def quarter_held_out(id_column):
    """Rows whose crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 4 == 2, F.lit(False))
