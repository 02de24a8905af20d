"""Hashes of spans of a byte buffer, vectorised: differences of a running polynomial, moved to a common power."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _POWERS[k] = np.multiply.accumulate(table)
    return _POWERS[0], _POWERS[1]


class SpanHashes:
    """64-bit hashes of spans of ``data``, a uint8 array; zero bytes at a span's end don't count."""

    def __init__(self, data: np.ndarray, block: int = 1 << 20) -> None:
        self.data, self.block = data, block

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of spans in ascending order of their starts, some ``block`` bytes at a time: a hash tells nothing of
        where its span stands, so that what is held grows with the longest span and not with the data."""
        out, at = np.empty(len(starts), np.uint64), 0
        while at < len(starts):
            first = int(starts[at])
            upto = int(np.searchsorted(starts, first + self.block, "right"))
            out[at:upto] = self._of(first, starts[at:upto] - first, ends[at:upto] - first)
            at = upto
        return out

    def _of(self, first: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        data = self.data[first : first + int(ends.max())]
        up, down = _powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data.astype(np.uint64) * up[: len(data)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.diff(inside.view(np.int8), prepend=0, append=0)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def text_ends(texts: list[bytes]) -> np.ndarray:
    """Where each text ends, its separator included, in the texts joined by one byte with one at the end."""
    return np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
