"""Byte-level BPE encoding and decoding from a table of ranks.

Two tiers resolve a pre-token.  A minimal perfect hash over the vocabulary finds whole
pre-tokens that are tokens; what it misses is merged by a heap of adjacent pairs over a linked
list of bytes, in time n log n, so that a pre-token of any length is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ChunkEncoder, batch_of, read_file, small_batches


def load_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a file whose lines hold a token in base64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


class PerfectHash:
    """A minimal perfect hash of n keys to 0..n-1, by hashing and displacing.

    Keys fall into about n/2 buckets; the largest go first, each with the least displacement d
    for which its keys' slots, a mix of (a + d * b) modulo n, are free and differ.  A bucket of one key is placed
    straight into a free slot.  The key at a slot is compared, so other keys are not found.
    """

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.width = max(1, n // 2)
        self.keys: list[bytes | None] = [None] * n
        self.shift = np.zeros(self.width, np.int64).tolist()
        buckets: dict[int, list] = {}
        for key in keys:
            h, a, b = self._hash(key)
            buckets.setdefault(h, []).append((key, a, b))
        order = sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0]))
        taken, free = bytearray(n), 0
        for h, group in order:
            if len(group) == 1:
                while taken[free]:
                    free += 1
                slots, self.shift[h] = [free], -free - 1
            else:
                d = 0
                while True:
                    slots = [self._slot(a, b, d) for _, a, b in group]
                    if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                        break
                    d += 1
                self.shift[h] = d
            for s, (key, _, _) in zip(slots, group, strict=True):
                taken[s] = 1
                self.keys[s] = key

    def _hash(self, key: bytes) -> tuple[int, int, int]:
        x = xxhash.xxh3_128_intdigest(key)
        return (x & 0xFFFFFFFF) % self.width, (x >> 32) & 0xFFFFFFFFFF, ((x >> 72) & 0xFFFFFFFFFF) | 1

    def _slot(self, a: int, b: int, d: int) -> int:
        x = ((a + d * b) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        return (x >> 24) % self.n

    def find(self, key: bytes) -> int:
        """The key's slot, or -1."""
        if not self.n:
            return -1
        h, a, b = self._hash(key)
        d = self.shift[h]
        slot = -d - 1 if d < 0 else self._slot(a, b, d)
        return slot if self.keys[slot] == key else -1


class Bpe:
    """Encoder and decoder for the ranks and the pre-token pattern given."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks the bytes {missing[:5]}")
        self.split = regex.compile(pattern).findall
        self.ranks = ranks
        self.table = PerfectHash(sorted(ranks, key=ranks.__getitem__))
        self.slot_ids = [ranks[k] for k in self.table.keys]
        self.pairs = [-1] * 65536
        for token, rank in ranks.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank
        self.tokens = {rank: token for token, rank in ranks.items()}

    def pre_token(self, piece: bytes) -> list[int]:
        slot = self.table.find(piece)
        return [self.slot_ids[slot]] if slot >= 0 else self.merge(piece)

    def merge(self, piece: bytes) -> list[int]:
        """Merges the adjacent pair of least rank, leftmost first, until no pair is a token."""
        rank_of, pairs, n = self.ranks.get, self.pairs, len(piece)
        end = list(range(1, n + 1))  # of the part that starts here; 0 when it was swallowed
        before = list(range(-1, n - 1))
        # A heap entry is one number made of the pair's rank, start and stop.
        w = n.bit_length()
        w2, mask = 2 * w, (1 << w) - 1
        heap = [(r << w2) | (i << w) | (i + 2) for i, (x, y) in enumerate(pairwise(piece)) if (r := pairs[x << 8 | y]) >= 0]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i, stop = (entry >> w) & mask, entry & mask
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue  # one of its parts has changed
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := rank_of(piece[i : end[stop]])) is not None:
                    heappush(heap, (r << w2) | (i << w) | end[stop])
            if (p := before[i]) >= 0 and (r := rank_of(piece[p:stop])) is not None:
                heappush(heap, (r << w2) | (p << w) | stop)
        ranks = self.ranks
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.split(text) for i in self.pre_token(piece.encode())]

    def decode(self, ids) -> bytes:
        """The bytes of the ids; an id outside the vocabulary raises KeyError."""
        return b"".join(map(self.tokens.__getitem__, ids))

    def chunk_encoder(self, most: int = 600_000) -> ChunkEncoder:
        """For many texts: chunks and pre-tokens that were met before are not encoded again."""
        known: dict[str, list[int]] = {}

        def encode(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
            if len(known) > most:
                known.clear()
            ids: list[int] = []
            counts = []
            for group, pieces in split_together(chunks, self.split):
                at = 0
                for chunk in group:
                    left, was = len(chunk), len(ids)
                    while left:
                        piece = pieces[at]
                        found = known.get(piece)
                        if found is None:
                            found = self.pre_token(piece.encode())
                            if len(piece) < 64:
                                known[piece] = found
                        ids += found
                        left -= len(piece)
                        at += 1
                    counts.append(len(ids) - was)
            return np.array(ids, np.uint32), np.array(counts, np.int64)

        return ChunkEncoder(encode)


def split_together(chunks: list[str], split):
    """Pre-tokens of chunks: plain chunks, which start with a space, are split as one text; others alone."""
    plain: list[str] = []
    for chunk in chunks:
        if chunk[0] == " " and not chunk[-1].isspace() and len(chunk) > 1:
            plain.append(chunk)
            continue
        if plain:
            yield plain, split("".join(plain))
            plain = []
        yield [chunk], split(chunk)
    if plain:
        yield plain, split("".join(plain))


class ByteTable:
    """All tokens' bytes in one array, to decode many ids at once."""

    def __init__(self, tokens: dict[int, bytes]):
        self.size = max(tokens) + 1
        lens = np.zeros(self.size, np.int64)
        lens[list(tokens)] = [len(t) for t in tokens.values()]
        self.lens, self.off = lens, np.cumsum(lens) - lens
        self.flat = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(self.size)), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        lens = self.lens[ids]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.off[ids] - (ends - lens), lens) + np.arange(total)].tobytes()


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, and the ids and decoded bytes if asked for.

    ids_sha256 is of the ids as little-endian unsigned 32-bit integers, decoded_sha256 of the bytes that the
    ids decode to, both in lowercase hex.  Null texts count as empty (no ids).  Special tokens'
    strings in a text are ordinary text.  Repeated rows get equal results.  An empty table gives an empty result.
    ``vocabulary`` is read on the driver and sent as bytes of fixed size.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast((read_file(vocabulary), pattern))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int64()), pa.binary()] * with_ids

    def run(batches):
        data, pat = sent.value
        bpe = Bpe(load_ranks(data), pat)
        chunks, table = bpe.chunk_encoder(), ByteTable(bpe.tokens)
        for b in batches:
            cols: list[list] = [[] for _ in names[1:]]
            for ids in chunks.texts([t or "" for t in b.column("text").to_pylist()]):
                back = table.decode(ids)
                row = [len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(back).hexdigest()]
                for c, v in zip(cols, row + [ids.tolist(), back] * with_ids, strict=True):
                    c.append(v)
            yield batch_of(names, types, [b.column("doc_id"), *cols])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded binary" * with_ids
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema)
