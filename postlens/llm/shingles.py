"""Sets of word shingles as sorted 64-bit hashes, made from whole batches of texts with numpy.

Words are what stands between ASCII white space, with A-Z lower-cased. A text with fewer words than the width is one
shingle; a text without words has an empty set. Hashes are fixed: the same on every machine and in every run.
"""

from __future__ import annotations

import numpy as np

from postlens.llm.common import by_bytes

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256)
    lower[65:91] += 32
    gap = np.zeros(256, bool)
    gap[[0x20, *range(0x09, 0x0E)]] = True
    return mix((lower + 1).astype(np.uint64) * _U(_ODD)), gap


_VALUE, _GAP = _byte_tables()
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        base = 0xD6E8FEB86659FD93
        up = np.full(n, base, np.uint64)
        down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts in order, and the number of words of each text."""
    data = np.frombuffer(b" ".join(t or b"" for t in texts) + b" ", np.uint8)
    lengths = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
    up, down = _power_tables(len(data) + 1)
    word = ~_GAP[data]
    edge = np.flatnonzero(np.diff(word, prepend=False))
    starts, ends = edge[0::2], edge[1::2]
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUE[data] * up[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    bounds = np.concatenate(([0], np.cumsum(lengths + 1)))
    return hashes, np.diff(np.searchsorted(starts, bounds))


def _runs(hashes: np.ndarray, count: int, k: int) -> np.ndarray:
    """The hash of the k words from each of the first ``count`` places on."""
    x = np.full(count, _U(k), np.uint64)
    for j in range(k):
        x = x * _U(0xD1342543DE82EF95) + hashes[j : j + count]
    return mix(x)


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """For each text its distinct shingles, as hashes in ascending order."""
    out: list[np.ndarray] = []
    for part in by_bytes(texts, _CHUNK):
        hashes, words = word_hashes(texts[part])
        shingles = _runs(hashes, max(0, len(hashes) - width + 1), width)
        at = 0
        for n in words.tolist():
            if n >= width:
                found = np.sort(shingles[at : at + n - width + 1])
                out.append(found[np.concatenate(([True], found[1:] != found[:-1]))])
            else:
                out.append(_runs(hashes[at : at + n], 1, n) if n else hashes[:0])
            at += n
    return out


def set_id(shingles: np.ndarray) -> int:
    """A 64-bit name of a set, as a signed number: equal sets have equal names."""
    total = int(mix(shingles ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) + len(shingles) * _ODD
    return int(mix(np.array([total & ((1 << 64) - 1)], np.uint64)).view(np.int64)[0])
