"""Word shingles of whole texts as 64-bit codes, computed on Arrow batches."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from rinkflow.llm.batches import flat_bytes, mix

#: Bytes hashed at once; longer texts are taken in several parts.
PART = 1 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
TOP = np.uint64(1 << 63)


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse, modulo 2 to the 64."""
    up, down = np.full(n, BASE, np.uint64), np.full(n, INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    return lower, space


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes of at most PART or len(data) bytes."""
    up, _ = powers(max(PART, len(data)))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for every word of the texts that lie end to end in ``data``, and the text of each word."""
    lower, space = _tables()
    gap = space[data]
    # A word starts at a byte that is no space and follows a space or the start of its text.
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets[:-1]] = True
    inner = ~gap
    before = np.concatenate([[True], gap[:-1]]) | fresh[:-1]
    starts = np.flatnonzero(inner & before)
    after = np.concatenate([gap[1:], [True]])
    ends_text = np.zeros(len(data) + 1, bool)
    ends_text[offsets[1:]] = True
    ends = np.flatnonzero(inner & (after | ends_text[1:])) + 1
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, base + PART, "right")))
        h = prefix_hashes(lower[data[base : ends[stop - 1]]])
        _, down = powers(max(PART, len(h)))
        s, e = starts[at:stop] - base, ends[at:stop] - base
        hashes[at:stop] = (h[e] - h[s]) * down[s] + (e - s).astype(np.uint64)
        at = stop
    return mix(hashes), np.searchsorted(offsets, starts, "right") - 1


def shingle_hashes(texts: pa.Array, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """63-bit hashes of all shingles (with repeats) and the text of each. A text of fewer words is one shingle."""
    data, offsets = flat_bytes(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, text = word_hashes(data, offsets)
    counts = np.bincount(text, minlength=len(texts)) if len(text) else np.zeros(len(texts), np.int64)
    n = len(h) - words + 1
    if n > 0:
        full = text[:n] == text[words - 1 :]
        value = np.full(n, words, np.uint64)
        for k in range(words):
            value = mix(value * np.uint64(BASE) + h[k : k + n])
        value, owner = value[full], text[:n][full]
    else:
        value, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    extra, at = [], np.flatnonzero((counts > 0) & (counts < words))
    for t in at:
        v = np.array([counts[t]], np.uint64)
        for x in h[firsts[t] : firsts[t + 1]]:
            v = mix(v * np.uint64(BASE) + x)
        extra.append(v[0])
    value = np.concatenate([value, np.array(extra, np.uint64)]) & (TOP - np.uint64(1))
    return value, np.concatenate([owner, at])


def distinct_pairs(value: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, in ascending order, and the offsets of the texts."""
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=texts))])


def ordered(value: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Codes whose order is the global one: rare shingles by hash, then the frequent ones by their rank."""
    if not len(frequent):
        return value
    at = np.minimum(np.searchsorted(frequent, value), len(frequent) - 1)
    return np.where(frequent[at] == value, TOP | rank[at], value)
