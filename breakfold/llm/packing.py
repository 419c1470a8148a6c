"""Best-fit packing of token sequences under several capacities.

Each bin has a residual vector: tokens, documents and attention cost (the sum of squared
lengths).  Pieces go by falling length into the bin that, under every constraint, scores best:
by the least weighted norm of the residual that would be left, or by the largest weighted dot
product of the piece and the residual.  Bins with equal residuals are one class, and classes
are kept by residual tokens, so choosing is a walk over few classes and not over all bins.

Packing is global and knows only how many pieces there are of each length (at most one number
for each length up to a bin's tokens).  Pieces of one length are alike, so bins that were filled alike
are taken together, as ranges of numbers, and the plan grows with the number of lengths and not of
pieces.  Pieces are numbered among those of their length: in each partition, from what the
partitions before hold.  Only these rows are shuffled, never texts, and ids only where asked for.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import load_ranks
from .common import batch_of, cut, read_file, small_batches


@dataclass(frozen=True)
class Capacities:
    """Of a bin.  The defaults for documents and attention bind only where tokens do, as no
    document is shorter than one token and a sum of squares is at most the square of the sum: then
    bins are as few as tokens allow.  Smaller ones bind by themselves."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048

    def check(self) -> None:
        if min(self.tokens, self.documents) < 1 or self.attention < self.tokens**2:
            raise ValueError("a piece of full length must fit an empty bin")


@dataclass(frozen=True)
class Weights:
    tokens: float = 1.0
    documents: float = 0.01
    attention: float = 0.01
    rule: str = "norm"  # or "dot"


@dataclass(frozen=True)
class Step:
    """``bins`` bins from number ``first`` on get ``each`` pieces of one length from token ``at`` on; the pieces go by number from ``piece`` on."""

    piece: int
    first: int
    bins: int
    each: int
    at: int


def plan(counts: dict[int, int], cap: Capacities = Capacities(), weights: Weights = Weights()) -> tuple[dict[int, list[Step]], int]:
    """For counts[length] pieces of each length: the steps of each length, by first piece, and the number of bins.

    Bins are those of best fit taken piece by piece.  Ties go to the class with fewer free documents, then less free attention.
    """
    cap.check()
    if weights.rule not in ("norm", "dot"):
        raise ValueError("rule must be norm or dot")
    # Classes of bins by free tokens, documents and attention: ranges (first, number) of bins.
    by_tokens: list[dict[tuple[int, int], list[tuple[int, int]]]] = [{} for _ in range(cap.tokens + 1)]
    occupied = 0  # bit t is set if a bin with t free tokens exists
    wt, wd, wa = weights.tokens / cap.tokens**2, weights.documents / cap.documents**2, weights.attention / cap.attention**2
    steps: dict[int, list[Step]] = {}
    bins = 0

    def score_of(t: int, d: int, a: int, size: int, cost: int) -> float:
        if weights.rule == "norm":
            return wt * (t - size) ** 2 + wd * (d - 1) ** 2 + wa * (a - cost) ** 2
        return -(wt * size * t + wd * d + wa * cost * a)

    for size in sorted(counts, reverse=True):
        left, done, own = counts[size], 0, []
        if not 0 < size <= cap.tokens:
            raise ValueError(f"a piece of {size} tokens doesn't fit")
        cost = size * size

        def best_of(but: tuple[int, int, int] | None = None):
            """The best class that holds a bin, as (score, free documents, free attention), and its free tokens."""
            best, where = None, None
            rest = occupied >> size
            t = size
            while rest:
                step = (rest & -rest).bit_length() - 1
                t += step
                rest >>= step + 1
                if weights.rule == "norm" and best is not None and wt * (t - size) ** 2 > best[0]:
                    break
                for d, a in by_tokens[t]:
                    if d < 1 or a < cost or (t, d, a) == but:
                        continue
                    score = score_of(t, d, a, size, cost)
                    if best is None or (score, d, a) < best:
                        best, where = (score, d, a), t
                t += 1
            return best, where

        while left:
            best, where = best_of()
            if where is None:
                t, d, a, first, n = cap.tokens, cap.documents, cap.attention, bins, left
            else:
                t, (_, d, a) = where, best
                first, n = by_tokens[t][d, a][-1]
            # One bin of the class goes on getting pieces while it is itself the best choice.
            rival = best_of((t, d, a))[0] if where is not None else None
            same = None if where is None else (score_of(t, d, a, size, cost), d, a)
            each, now = 1, (t - size, d - 1, a - cost)
            while each < left and now[0] >= size and now[1] >= 1 and now[2] >= cost:
                mine = (score_of(*now, size, cost), now[1], now[2])
                if (rival is not None and rival < mine) or (same is not None and same < mine):
                    break
                each, now = each + 1, (now[0] - size, now[1] - 1, now[2] - cost)
            n = min(n, max(1, left // each))
            if where is None:
                bins += n
            else:
                group = by_tokens[t][d, a]
                f, m = group.pop()
                if m > n:
                    group.append((f + n, m - n))
                if not group:
                    del by_tokens[t][d, a]
                    if not by_tokens[t]:
                        occupied &= ~(1 << t)
            own.append(Step(done, first, n, each, cap.tokens - t))
            done, left = done + n * each, left - n * each
            if now[0] > 0 and now[1] > 0:
                by_tokens[now[0]].setdefault(now[1:], []).append((first, n))
                occupied |= 1 << now[0]
        steps[size] = own
    return steps, bins


class Dealer:
    """Bins and offsets of numbered pieces by the steps of a plan."""

    def __init__(self, steps: dict[int, list[Step]]):
        self.steps = {n: np.array([(s.piece, s.first, s.bins, s.each, s.at) for s in own], np.int64).T for n, own in steps.items()}

    def __call__(self, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        order = np.argsort(lengths, kind="stable")
        sizes, starts = np.unique(lengths[order], return_index=True)
        for size, at in zip(sizes.tolist(), np.split(order, starts[1:]), strict=True):
            piece, first, _, each, offset = self.steps[size]
            k = np.searchsorted(piece, numbers[at], "right") - 1
            inside = numbers[at] - piece[k]
            bins[at] = first[k] + inside // each[k]
            offsets[at] = offset[k] + inside % each[k] * size
        return bins, offsets


def pack(lengths: list[int], cap: Capacities = Capacities(), weights: Weights = Weights()) -> tuple[list[int], int]:
    """The bin of each piece and the number of bins."""
    counts: dict[int, int] = {}
    numbers = []
    for n in lengths:
        numbers.append(counts.get(n, 0))
        counts[n] = numbers[-1] + 1
    steps, bins = plan(counts, cap, weights)
    if not lengths:
        return [], 0
    return Dealer(steps)(np.array(lengths, np.int64), np.array(numbers, np.int64))[0].tolist(), bins


def piece_lengths(total: int, most: int) -> list[int]:
    """A document of total tokens in pieces of ``most``; the first is shorter if need be."""
    if total <= most:
        return [total]
    first = total % most
    return [first] * (first > 0) + [most] * (total // most)


def added_tokens(tokenizer_file: bytes) -> dict[str, int]:
    """The added tokens of a tokenizer's JSON file: they are found in a text before anything else."""
    return {t["content"]: t["id"] for t in json.loads(tokenizer_file).get("added_tokens", [])}


def token_encoder(ranks_file: bytes, pattern: str, added: dict[str, int] | None = None):
    """Ids of a text by the byte-level vocabulary given as ranks; strings of ``added`` in it are tokens of their own.

    The ids are those of the ``tokenizers`` library with the same vocabulary (tests hold them against
    each other), at several times its speed.
    """
    import tiktoken

    enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(ranks_file), special_tokens=added or {})
    return lambda text: enc.encode(text, allowed_special="all", disallowed_special=())


SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, ranks: str, pattern: str, cap: Capacities = Capacities(), weights: Weights = Weights(), end_id: int = 0, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """All rows as pieces in sequences of at most cap.tokens tokens.

    A document is its ids and then ``end_id``; only longer ones are cut, and their first piece may be shorter.
    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for), a row per piece.
    ``tokenizer`` is the vocabulary's JSON file, whose added tokens count; without it there are none.
    Null and empty texts are documents of one token.  Repeated rows are packed like other rows.
    An empty table gives an empty result.  Sequences are numbered from 0 without gaps, and are as many however
    the rows are dealt over partitions.
    """
    cap.check()
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast((read_file(ranks), pattern, added_tokens(read_file(tokenizer)) if tokenizer else {}))  # of fixed size

    ids_too = with_ids * ", ids array<long>"

    def run(batches):
        encoder, most, part = None, cap.tokens, TaskContext.get().partitionId()
        seen: dict[int, int] = {}  # pieces of each length so far: at most ``most`` numbers
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "number"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        for b in batches:
            encoder = encoder or token_encoder(*sent.value)
            head: list[tuple] = []
            kept: list[list[int]] = []
            ids_of = (encoder(t or "") for t in b.column("text").to_pylist())
            for doc, ids in zip(b.column("doc_id").to_pylist(), ids_of, strict=True):
                ids.append(end_id)
                whole = np.array(ids, "<u4")
                at = 0
                for piece, n in enumerate(piece_lengths(len(whole), most)):
                    head.append((doc, piece, at, n, zlib.crc32(whole[at : at + n].tobytes()), part, seen.get(n, 0)))
                    seen[n] = head[-1][-1] + 1
                    if with_ids:
                        kept.append(ids[at : at + n])
                    at += n
            if head:
                more = ([kept], ["ids"], [pa.list_(pa.int64())]) if with_ids else ([], [], [])
                yield batch_of(names + more[1], types + more[2], [*map(list, zip(*head, strict=True)), *more[0]])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # Written, so that numbers stay whatever runs again.
    pieces = cut(rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, number long" + ids_too))
    held = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut(held.select("part", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    counts = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # cap.tokens rows at most
    steps = spark.sparkContext.broadcast(plan(counts, cap, weights)[0])

    def deal(batches):
        dealer = None
        for b in batches:
            dealer = dealer or Dealer(steps.value)
            bins, offsets = dealer(b.column("length").to_numpy(), b.column("number").to_numpy())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            more = ["ids"] * with_ids
            yield batch_of([*names, "sequence_id", "offset", *more], [None] * 5 + [pa.int64(), pa.int64()] + [None] * with_ids, [*[b.column(c) for c in names], pa.array(bins), pa.array(offsets), *[b.column(c) for c in more]])

    numbered = pieces.join(bases.select("part", "length", "base").hint("merge"), ["part", "length"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("base")).alias("number")] + ["ids"] * with_ids
    return numbered.select(*names).mapInArrow(deal, SCHEMA + ids_too)
