"""Vectorised hashes of words and of windows of words, over groups of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Each byte's random value, the base over bytes and two bases over words; odd, so that they have inverses modulo 2**64.
_BYTES = np.random.default_rng(20_240_601).integers(0, 2**64, 256, dtype=np.uint64)
OVER_BYTES, OVER_WORDS, OVER_WORDS_2 = 0x9E3779B97F4A7C1B, 0xD1342543DE82EF93, 0xA0761D6478BD642B
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    held = _tables.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16), base, np.uint64)
        held[0] = 1
        _tables[base] = held = np.cumprod(held, dtype=np.uint64)
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _block(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words."""
    a = np.frombuffer(data, np.uint8)
    space = np.concatenate([[True], _SPACE[a], [True]])
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTES[a] * _powers(OVER_BYTES, len(a)), out=sums[1:])
    inverse = _powers(pow(OVER_BYTES, -1, 2**64), len(a) + 1)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def word_hashes(texts: list[bytes], most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts``, one text behind another, and the number of words in each text."""
    if len(texts) == 1:
        data, found, at = texts[0], [], 0
        while at < len(data):
            cut = at + most
            while cut < len(data) and not _SPACE[data[cut]]:
                cut += 1
            found.append(_block(data[at:cut])[0])
            at = cut
        hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
        return hashes, np.array([len(hashes)])
    hashes, starts = _block(b"\n".join(texts))
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.diff(np.searchsorted(starts, first))


def word_hashes_at(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, the number of the text each is in and its first byte there."""
    hashes, starts = _block(b"\n".join(texts))
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    text = np.searchsorted(first, starts, "right") - 1
    return hashes, text, starts - first[text]


def windows(hashes: np.ndarray, length: int, base: int = OVER_WORDS) -> np.ndarray:
    """The hash of each ``length`` words in a row, texts' borders not heeded."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _powers(base, len(hashes)), out=sums[1:])
    return mix((sums[length:] - sums[:-length]) * _powers(pow(base, -1, 2**64), n))


def inside(counts: np.ndarray, length: int) -> np.ndarray:
    """True for each window that lies in one text."""
    total = int(counts.sum())
    if total < length:
        return np.zeros(0, bool)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(total)
    return left[: total - length + 1] >= length


def groups(texts: list[bytes], most: int = 1 << 20) -> Iterator[range]:
    """Places of texts that are dealt with together: up to ``most`` bytes, or one longer text."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > most:
            yield range(first, i)
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield range(first, len(texts))
