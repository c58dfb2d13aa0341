"""Numpy helpers shared by the operators: words of a batch of texts, their hashes, and Arrow batches cut to a bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text that one numpy step works on; a longer text makes a step of its own.
STEP_BYTES = 2_000_000
SLICE_BYTES = 200_000  # that are hashed at a time
BLANKS = tuple([0x20, *range(0x09, 0x0E)])
U = np.uint64


def blank_table() -> np.ndarray:
    """True for bytes that part words: ``[\\x20\\x09-\\x0D]``."""
    table = np.zeros(256, bool)
    table[list(BLANKS)] = True
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of the public-domain splitmix64 generator: spreads the bits of unsigned 64-bit numbers."""
    x = np.asarray(x, U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


# One random number per byte value and the powers of an odd multiplier, from a rule.
BYTE_KEYS = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
POWER_SPAN = 65_521
with np.errstate(over="ignore"):
    POWERS = np.cumprod(np.full(POWER_SPAN, 0x5851F42D4C957F2D, U), dtype=U)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row and the offsets of each (one more than texts); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(batches: Iterator[pa.RecordBatch], *columns: str, size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``size`` bytes of text (of ``columns``, else of ``text``) at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = sum(text_bytes(batch.column(batch.schema.get_field_index(c)))[1] for c in columns or ("text",))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def give_back() -> None:
    """Return what Arrow has freed to the system: a Python worker outlives its task, and the next one may be another step's."""
    pa.default_memory_pool().release_unused()


class Words:
    """Words of a batch of texts: where each starts and ends in the bytes, and which text it belongs to."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, part: np.ndarray | None = None):
        part = blank_table() if part is None else part
        inside = ~part[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        filled = np.flatnonzero(np.diff(offsets) > 0)
        heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
        first[heads], last[tails] = inside[heads], inside[tails]
        self.data, self.offsets = data, offsets
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        # words of text i: bounds[i] up to bounds[i + 1]
        self.bounds = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.bounds)
        self.text = np.repeat(np.arange(len(offsets) - 1), self.count)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes, A-Z as a-z when ``lower``."""
        return span_hashes(self.data, self.start, self.end, lower)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of each span (none of them empty), A-Z as a-z when ``lower``."""
    if not len(start):
        return np.zeros(0, U)
    size = end - start
    ends = np.cumsum(size)
    if ends[-1] > 2 * SLICE_BYTES and len(start) > 1:  # as each byte needs several numbers, which should stay near the processor
        cut = np.unique(np.searchsorted(ends, np.arange(SLICE_BYTES, ends[-1], SLICE_BYTES)))
        parts = zip(np.append(0, cut).tolist(), np.append(cut, len(start)).tolist(), strict=True)
        return np.concatenate([span_hashes(data, start[a:b], end[a:b], lower) for a, b in parts])
    place = np.arange(ends[-1]) - np.repeat(ends - size, size)
    byte = data[np.repeat(start, size) + place]
    keyed = BYTE_KEYS[LOWER[byte] if lower else byte]
    far = int(size.max()) > POWER_SPAN
    keyed *= POWERS[place % POWER_SPAN if far else place]
    if far:  # only there, so that a span's hash doesn't depend on the others
        beyond = np.flatnonzero(place >= POWER_SPAN)
        keyed[beyond] = mix(keyed[beyond] + (place[beyond] // POWER_SPAN).astype(U))
    return mix(np.add.reduceat(keyed, ends - size) + size.astype(U))


def windows(words: Words, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside one text, and the index of each run's first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    at = np.flatnonzero(words.text[:n] == words.text[width - 1 :])
    out = np.zeros(len(at), U)
    for k in range(width):
        out = mix(out * U(3) + hashes[at + k])
    return out, at


