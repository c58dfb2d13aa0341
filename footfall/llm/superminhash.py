"""SuperMinHash signatures: every component is the least of values drawn by correlated permutations, one level at a time.

Element e draws at level j one component, the j-th of its own random permutation, and the value j plus a random fraction. A
component filled at one level can't fall at a later one, so a set is done as soon as all its components are filled.
"""

from __future__ import annotations

import numpy as np

from footfall.llm.kernels import U, Words, mix, windows

EMPTY = U(0xFFFFFFFFFFFFFFFF)
LEVEL_STEP = U(0xD6E8FEB86659FD93)
SLICE = 16_384  # shingles whose permutations are held at a time; a set is never divided


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text (A-Z as a-z): hash and text, ordered by text, then hash. A text of fewer words has one
    shingle, all of them; a text without words has none."""
    hashes = words.hashes(lower=True)
    keys, at = windows(words, hashes, width)
    owner = words.text[at]
    few = np.flatnonzero((words.count > 0) & (words.count < width))
    whole = np.zeros(len(few), U)
    for k in range(width - 1):
        more = words.count[few] > k
        spot = words.bounds[few[more]] + k
        whole[more] = mix(whole[more] * U(3) + hashes[spot])
    keys = np.concatenate([keys, mix(whole + words.count[few].astype(U))])
    owner = np.concatenate([owner, few])
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return keys[new], owner[new]


def signatures(keys: np.ndarray, owner: np.ndarray, n: int, size: int) -> np.ndarray:
    """An (n, size) table of signatures; rows of empty sets hold ``EMPTY``. ``owner`` ascends.

    A few sets at a time, since each shingle of a set that is still open has a permutation of ``size`` numbers.
    """
    out = np.full((n, size), EMPTY, U)
    ends = np.searchsorted(owner, np.arange(n), "right")
    first = begin = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, begin + SLICE, "right")))
        end = int(ends[last - 1])
        out[first:last] = _signatures(keys[begin:end], owner[begin:end] - first, last - first, size)
        first, begin = last, end
    return out


def _signatures(keys: np.ndarray, owner: np.ndarray, n: int, size: int) -> np.ndarray:
    out = np.full(n * size, EMPTY, U)
    order = None
    for level in range(size):
        if not len(keys):
            break
        drawn = mix(keys + U(int(LEVEL_STEP) * (level + 1) % 2**64))
        pick = level + (((drawn >> U(32)) * U(size - level)) >> U(32)).astype(np.int64)
        if level:
            rows = np.arange(len(keys))
            part = order[rows, pick]
            order[rows, pick] = order[:, level]
            order[:, level] = part
        else:
            part = pick
        np.minimum.at(out, owner * size + part, U(level << 32) | (drawn & U(0xFFFFFFFF)))
        open_ = (out.reshape(n, size) == EMPTY).any(1)[owner]
        if not level and open_.any():
            order = np.tile(np.arange(size, dtype=np.uint16), (int(open_.sum()), 1))
            rows = np.arange(len(order))
            order[rows, pick[open_]] = 0
            order[:, 0] = pick[open_]
        elif level:
            order = order[open_]
        keys, owner = keys[open_], owner[open_]
    return out.reshape(n, size)


def band_keys(table: np.ndarray, rows: int) -> np.ndarray:
    """One key for each band of ``rows`` components; equal keys in a band mean equal components."""
    n, size = table.shape
    out = np.zeros((n, size // rows), U) + np.arange(size // rows, dtype=U) * U(0x9E3779B97F4A7C15)
    for k in range(rows):
        out = mix(out * U(3) + table[:, k::rows][:, : size // rows])
    return out
