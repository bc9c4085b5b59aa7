"""Vectorised word and shingle hashes over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that are hashed at a time.
GROUP_BYTES = 1 << 20

#: Powers that are kept between calls, at most; more are made for a call, so that idle workers do not hold them.
KEPT_POWERS = 1 << 20

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > KEPT_POWERS:
        return _first_powers(n)
    if len(_powers[0]) < n:
        _powers[:] = _first_powers(1 << int(n - 1).bit_length())
    return _powers[0][:n], _powers[1][:n]


def _first_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, INVERSE):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, inverse powers): (sums[j] - sums[i]) * inverse[i] is a polynomial hash of raw[i:j]."""
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return sums, down


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the words of raw bytes."""
    word = np.zeros(len(raw) + 2, np.int8)
    word[1:-1] = ~SPACE[raw]
    edge = np.diff(word)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums, down = prefix(raw)
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)), start


def groups(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) with about GROUP_BYTES together."""
    at, first, size = 0, 0, 0
    for at, t in enumerate(texts):
        if size and size + len(t) > GROUP_BYTES:
            yield first, texts[first:at]
            first, size = at, 0
        size += len(t)
    if texts:
        yield first, texts[first:]


def words_of(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, word hashes, where each text's words begin, with the end) by groups of texts."""
    for first, part in groups(texts):
        raw = np.frombuffer(b"\n".join(part), np.uint8)
        hashes, starts = word_hashes(raw)
        ends = np.cumsum([len(t) + 1 for t in part])
        yield first, hashes, np.r_[0, np.searchsorted(starts, ends - 1)]


def shingles(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """The distinct hashes of every k words in a row, sorted; of all words where there are fewer."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64)
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = out * BASE + hashes[i : n - k + 1 + i]
    return np.unique(mix(out))
