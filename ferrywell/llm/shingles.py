"""Hashed word shingles of many texts at once, with NumPy over the bytes of a whole block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_rng = np.random.default_rng(20240229)
#: A value for each byte; A-Z have those of a-z.
VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
VALUES[ord("A"):ord("Z") + 1] = VALUES[ord("a"):ord("z") + 1]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASE = 0x9E3779B97F4A7C15
BLOCK = 1 << 19


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as many as the longest block needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            inverse = pow(BASE, -1, 1 << 64)
            self.up, self.down = (self._made(b, n) for b in (BASE, inverse))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _made(base: int, n: int) -> np.ndarray:
        made = np.full(n, base, np.uint64)
        made[0] = 1
        return np.cumprod(made, dtype=np.uint64)


_powers = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~SPACE[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begins, ends = edges[::2], edges[1::2]
    up, down = _powers.get(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(VALUES[raw] * up[:-1], out=sums[1:])
    hashes = (sums[ends] - sums[begins]) * down[begins]
    return mix(hashes + (ends - begins).astype(np.uint64)), begins


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > BLOCK:
            yield begin, i
            begin, size = i, 0
        size += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


def _long_words(text: bytes) -> np.ndarray:
    """Word hashes of one long text, a stretch at a time."""
    found, at = [], 0
    while at < len(text):
        end = at + BLOCK
        while end < len(text) and not SPACE[text[end]]:
            end += 1
        found.append(word_hashes(np.frombuffer(text[at:end], np.uint8))[0])
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: runs of ``width`` lower-cased words.

    A text with fewer words has its whole sequence as one; one without words has none.
    """
    raw = [(t or "").encode() for t in texts]
    for begin, end in _blocks(raw):
        if end - begin == 1 and len(raw[begin]) > 2 * BLOCK:
            words = _long_words(raw[begin])
            bounds = np.array([0, len(words)])
        else:
            joined = np.frombuffer(b"\n".join(raw[begin:end]), np.uint8)
            words, places = word_hashes(joined)
            lengths = np.fromiter((len(t) + 1 for t in raw[begin:end]), np.int64, end - begin)
            bounds = np.searchsorted(places, np.concatenate([[0], np.cumsum(lengths)]))
        rolled = _rolled(words, width)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= width:
                found = np.sort(rolled[a:b - width + 1])
                yield found[np.concatenate([[True], found[1:] != found[:-1]])]
            elif b > a:
                yield mix(_rolled(words[a:b], b - a) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def _rolled(words: np.ndarray, width: int) -> np.ndarray:
    n = max(0, len(words) - width + 1)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[k:k + n]
    return mix(total)
