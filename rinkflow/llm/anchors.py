"""Anchors of long repeats: positions chosen by content alone, so that equal strings have the same ones.

Of every window of ``length`` bytes the anchor is the leftmost of its ``gram``-byte strings with the smallest hash. Each window
start belongs to one anchor; the starts of one anchor follow each other. Equal windows have their anchors at the same offset.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from rinkflow.llm.batches import mix
from rinkflow.llm.shingles import PART, powers

LENGTH, GRAM = 100, 32
#: Bits of a hash that give way to a position inside a part.
PLACE = np.uint64((1 << 21) - 1)


def prefix(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes, modulo 2 to the 64."""
    up, _ = powers(max(PART, len(data) + 1))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def spans_hash(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]; equal strings get equal ones wherever they stand."""
    _, down = powers(max(PART, len(hashes)))
    return (hashes[end] - hashes[start]) * down[start]


@dataclass
class Anchors:
    """For each anchor: its position, the first and the last window start it stands for, the hash of its gram and of all its windows."""

    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    gram: np.ndarray
    context: np.ndarray


def anchors(data: np.ndarray, part: int = PART) -> Anchors:
    """Anchors of one text, in parts of bounded size that overlap by a window."""
    found = []
    windows = len(data) - LENGTH + 1
    for base in range(0, max(0, windows), part):
        stop = min(windows, base + part)
        found.append((base, _anchors(data[base : stop + LENGTH - 1])))
    if not found:
        none = np.zeros(0, np.int64)
        return Anchors(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    parts = [(x.at + b, x.low + b, x.high + b, x.gram, x.context) for b, x in found]
    return Anchors(*(np.concatenate(c) for c in zip(*parts, strict=True)))


def _anchors(data: np.ndarray) -> Anchors:
    hashes = prefix(data)
    n, width = len(data) - LENGTH + 1, LENGTH - GRAM + 1
    starts = np.arange(len(data) - GRAM + 1)
    gram = mix(spans_hash(hashes, starts, starts + GRAM))
    # The place in the lower bits breaks ties by the leftmost, which is the same in equal windows.
    value, reach = gram & ~PLACE | starts.astype(np.uint64), 1
    while reach * 2 <= width:
        value = np.minimum(value[:-reach], value[reach:])
        reach *= 2
    at = (np.minimum(value[:n], value[width - reach : width - reach + n]) & PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [n]]) - 1
    place = at[first]
    around = mix(spans_hash(hashes, first, last + LENGTH) ^ ((place - first) << 8 | (last - first)).astype(np.uint64))
    return Anchors(place, first, last, gram[place], around)
