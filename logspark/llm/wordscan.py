"""Words of many texts at once, in numpy.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r.  UTF-8
continuation bytes are never among these, so runs of bytes are runs of
characters.  A word's 64-bit hash is a polynomial in its bytes, taken as
a difference of running sums; prefixes of words are hashed the same way.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    for out, base in ((up, _P), (down, _P_INV)):
        out[0] = 1
        done = 1
        while done < n:
            step = min(done, n - done)
            np.multiply(out[:step], np.uint64(pow(base, done, 1 << 64)), out=out[done : done + step])
            done += step
    return up, down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(16, (n - 1).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all others."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Words:
    """starts, ends: byte offsets in buf; doc: index of the text; first: each text's first word, and the end."""

    def __init__(self, texts: list[bytes | None], lower: bool = False, separators: np.ndarray = SPACE):
        raw = [t or b"" for t in texts]
        self.buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        if lower:
            self.buf = LOWER[self.buf]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.text_start = np.concatenate(([0], np.cumsum(sizes + 1)))
        space = separators[self.buf]  # \n, which stands between texts, must be one
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate(([0], edge))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.starts, self.text_start)
        self.doc = np.repeat(np.arange(len(raw)), np.diff(self.first))
        self._sum: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of bytes [start, end) for each pair; equal bytes have equal hashes wherever they lie."""
        if self._sum is None:
            up, _ = powers(len(self.buf) + 1)
            self._sum = np.zeros(len(self.buf) + 1, np.uint64)
            np.cumsum(_VALUE[self.buf] * up[: len(self.buf)], out=self._sum[1:])
        _, down = powers(len(self.buf) + 1)
        h = (self._sum[ends] - self._sum[starts]) * down[starts]
        return mix(h + (ends - starts).astype(np.uint64))

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)


def text_hash(text: str | bytes) -> int:
    """The hash that span_hash gives these bytes."""
    raw = text.encode() if isinstance(text, str) else text
    h = 0
    for k, b in enumerate(raw):
        h = (h + int(_VALUE[b]) * pow(_P, k, 1 << 64)) % (1 << 64)
    return int(mix(np.array([(h + len(raw)) % (1 << 64)], np.uint64))[0])
