"""Words, their hashes and hashes of runs of words, vectorised by document."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
_B = 0x9E3779B97F4A7C15
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """Runs of characters other than [\\x20\\x09-\\x0D], in UTF-8; A-Z in lower case if asked for."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.translate(LOWER) if lower else raw).split()  # bytes.split parts at exactly these six characters


class WordHashes:
    """64-bit hashes of words through a memo of bounded size; ``both`` gives two halves of a 128-bit hash."""

    def __init__(self, most: int = 500_000):
        self.memo, self.most = {}, most
        self.parts = np.zeros((2, 0), U)

    def _places(self, found: list[bytes]) -> np.ndarray:
        memo = self.memo
        if len(memo) > self.most:
            memo.clear()
            self.parts = self.parts[:, :0]
        new = list(set(found).difference(memo))
        if new:
            at = len(memo)
            if at + len(new) > self.parts.shape[1]:
                grown = np.zeros((2, 2 * (at + len(new))), U)
                grown[:, :at] = self.parts[:, :at]
                self.parts = grown
            raw = b"".join(map(xxhash.xxh3_128_digest, new))
            self.parts[:, at : at + len(new)] = np.frombuffer(raw, ">u8").reshape(-1, 2).T[::-1]
            memo.update(zip(new, range(at, at + len(new)), strict=True))
        return np.fromiter(map(memo.__getitem__, found), np.int64, len(found))

    def __call__(self, found: list[bytes]) -> np.ndarray:
        at = self._places(found)  # may replace parts
        return self.parts[0][at]

    def both(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        at = self._places(found)
        return self.parts[0][at], self.parts[1][at]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive word hashes, by doubling: a run of 2k words is made of two of k."""
    if len(h) < n:
        return h[:0]
    out, width, at, bit = None, 0, h, 1
    while True:
        if n & bit:
            if out is None:
                out, width = at, bit
            else:
                m = len(h) - width - bit + 1
                out = out[:m] * U(pow(_B, bit, 1 << 64)) + at[width : width + m]
                width += bit
        if width == n:
            return mixed(out)
        m = len(h) - 2 * bit + 1
        at = at[:m] * U(pow(_B, bit, 1 << 64)) + at[bit : bit + m]
        bit *= 2


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of every n consecutive values."""
    if len(x) < n:
        return x[:0]
    at, width = x, 1
    while 2 * width <= n:
        at = np.minimum(at[: len(at) - width], at[width:])
        width *= 2
    rest = n - width
    return np.minimum(at[: len(at) - rest], at[rest:]) if rest else at
