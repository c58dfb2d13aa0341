"""Fill-in-the-middle rows, their cuts found by counting units chunk by chunk and remembering each chunk's count.

A unit is a word with the blanks before it, or the blanks that end a text, so units end where words end. A gear hash of the last
``WINDOW`` bytes cuts text into chunks, and passages that texts share fall into the same chunks. Of a chunk a worker keeps, found by
its bytes (so a hit is checked against the content), what its neighbours need to know:

    ends inside it, whether it starts with a word byte, whether it ends with one, characters, places of the ends

A word that runs up to the end of a chunk ends there only if the next chunk starts with a blank, or the text stops. Sums of the
chunks' counts then say in which chunk a cut falls, and the chunk's own table says where.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import texts
from footfall.llm.kernels import BYTE_KEYS, U, blank_table, steps, text_bytes

WINDOW = 16
LEAST, MOST = 128, 4096
MASK = np.uint32(0b111111111 << 23)  # a chunk of about 512 bytes more than the least
SLICE = 1 << 21  # bytes hashed at a time
REMEMBERED_BYTES = 48_000_000  # of chunks and their tables, beyond which a worker starts anew
GEAR = (BYTE_KEYS >> U(32)).astype(np.uint32)
BLANK = blank_table()
SEED = 42
PLAIN_BELOW, SPM_BELOW = 50, 80  # of 100: rows that are changed, and of those the rows with the suffix first
MARKS = ("<P>", "<S>", "<M>")
COLUMNS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, n_chunks long"


def boundaries(data: np.ndarray) -> np.ndarray:
    """Where the hash of the ``WINDOW`` bytes before allows a chunk to end; bytes before the first count as none."""
    found = []
    for a in range(0, len(data), SLICE):
        lead = min(a, WINDOW - 1)
        h = GEAR[data[a - lead : a + SLICE]]
        width = 1
        while width < WINDOW:
            older = np.zeros_like(h)
            older[width:] = h[:-width]
            h = h + (older << np.uint32(width))
            width *= 2
        # the last byte's key is unshifted: the middle bits have seen the whole window
        found.append(np.flatnonzero((h[lead:] << np.uint32(7)) & MASK == 0) + a + 1)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """For each text the places in ``data`` where its chunks end; an empty text has none."""
    allowed = boundaries(data).tolist()
    allowed.append(len(data) + MOST + 1)
    out, i = [], 0
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        ends = []
        while a < b:
            i = bisect_left(allowed, a + LEAST, i)
            a = min(allowed[i], a + MOST, b)
            ends.append(a)
        out.append(ends)
    return out


class Summary:
    """What the neighbours of a chunk need to know of it."""

    __slots__ = ("chars", "ends", "starts_in_word", "stops_in_word")

    def __init__(self, starts_in_word: bool, stops_in_word: bool, chars: int, ends: np.ndarray):
        self.starts_in_word, self.stops_in_word, self.chars, self.ends = starts_in_word, stops_in_word, chars, ends


def summaries(chunks: list[bytes]) -> list[Summary]:
    """Summaries of many chunks at once."""
    data = np.frombuffer(b"".join(chunks), np.uint8)
    bounds = np.concatenate([[0], np.cumsum(list(map(len, chunks)))])
    word = ~BLANK[data]
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
    last = np.zeros(len(data), bool)
    last[:-1] = word[:-1] & ~word[1:]
    last[bounds[1:] - 1] = False  # whether a word ends at the border the next chunk tells
    at = np.flatnonzero(last) + 1
    first = np.searchsorted(at, bounds, "right")
    out = []
    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        ends = (at[first[k] : first[k + 1]] - a).astype(np.uint16)
        out.append(Summary(bool(word[a]), bool(word[b - 1]), int(chars[k + 1] - chars[k]), ends))
    return out


class Memory:
    """Summaries of chunks seen before, by their bytes."""

    def __init__(self, room: int = REMEMBERED_BYTES):
        self.room, self.used, self.known = room, 0, {}

    def look_up(self, chunks: list[bytes]) -> list[Summary]:
        if self.used > self.room:
            self.used, self.known = 0, {}
        new = list({c for c in chunks if c not in self.known})
        for a in range(0, len(new), 4096):
            some = new[a : a + 4096]
            self.known.update(zip(some, summaries(some), strict=True))
            self.used += sum(3 * len(c) for c in some)
        return [self.known[c] for c in chunks]


class Units:
    """Units of one text, from the summaries of its chunks. ``ends[k]``: units that end in its first k + 1 chunks."""

    def __init__(self, raw: bytes, places: list[int], parts: list[Summary]):
        self.raw, self.places, self.parts = raw, places, parts
        nexts = [*(p.starts_in_word for p in parts[1:]), False]
        # a word's end at the border of two chunks is the last of the first
        self.ends = list(accumulate(len(p.ends) + (p.stops_in_word and not n) for p, n in zip(parts, nexts, strict=False)))  # no part: no next
        self.words = self.ends[-1] if parts else 0
        self.n = self.words + (bool(parts) and not parts[-1].stops_in_word)

    def cut(self, m: int) -> tuple[int, int]:
        """Where the first ``m`` units end: bytes and characters."""
        if m == 0:
            return 0, 0
        if m > self.words:
            return len(self.raw), sum(p.chars for p in self.parts)
        k = bisect_left(self.ends, m)
        part, begin = self.parts[k], self.places[k - 1] if k else 0
        nth = m - (self.ends[k - 1] if k else 0) - 1
        end = begin + int(part.ends[nth]) if nth < len(part.ends) else self.places[k]
        inside = np.frombuffer(self.raw, np.uint8, end - begin, begin)
        return end, sum(p.chars for p in self.parts[:k]) + int(np.count_nonzero((inside & 0xC0) != 0x80))


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits that depend on the id alone."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def arrange(doc_id: int | None, text: str, units: Units) -> tuple[str, int | None, int | None, str | bytes]:
    """Form, characters of prefix and middle, and the text as it is trained on."""
    h = draws(doc_id)
    if not text or h[2] % 100 >= PLAIN_BELOW or any(m in text for m in MARKS):
        return "plain", None, None, text
    (a, a_chars), (b, b_chars) = sorted(units.cut(x % (units.n + 1)) for x in h[:2])
    raw = units.raw
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    if h[3] % 100 < SPM_BELOW:
        return "spm", a_chars, b_chars - a_chars, b"".join((b"<S>", suffix, b"<P>", prefix, b"<M>", middle))
    return "psm", a_chars, b_chars - a_chars, b"".join((b"<P>", prefix, b"<S>", suffix, b"<M>", middle))


def transform(docs: DataFrame) -> DataFrame:
    """Every document as it is trained on: ``output`` with its ``form``, units and the characters of prefix and middle.

    Rows with the same id and text come out the same, and rows without id draw as one id of no digits. A null text counts as empty,
    and an empty one, like a text that has a mark already, stays plain. A text of any length is hashed a slice at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory()
        for batch in steps(batches):
            data, offsets = text_bytes(batch.column(1))
            cut, whole, rows = chunk_ends(data, offsets), data.tobytes(), []
            heads, stops = [], []
            for a, ends in zip(offsets[:-1].tolist(), cut, strict=True):
                heads += [a, *ends[:-1]] if ends else []
                stops += ends
            parts = memory.look_up([whole[a:b] for a, b in zip(heads, stops, strict=True)])
            at = 0
            ids, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, text, a, b, ends in zip(ids, values, offsets[:-1].tolist(), offsets[1:].tolist(), cut, strict=True):
                units = Units(whole[a:b], [e - a for e in ends], parts[at : at + len(ends)])
                at += len(ends)
                form, prefix, middle, output = arrange(doc, text, units)
                rows.append((doc, units.n, form, prefix, middle, output if isinstance(output, str) else output.decode(), len(ends)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in COLUMNS.split(", ")])

    return texts(docs).mapInArrow(run, COLUMNS)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from. Marks stand in no changed text, and none can arise where two parts meet."""
    body = F.substring(output, 4, 2**31 - 1)

    def after(text: Column, mark: str) -> Column:
        return text.substr(F.locate(mark, text) + 3, F.length(text))

    psm_rest, spm_rest = after(body, "<S>"), after(body, "<P>")
    psm = F.concat(F.substring_index(body, "<S>", 1), after(psm_rest, "<M>"), F.substring_index(psm_rest, "<M>", 1))
    spm = F.concat(F.substring_index(spm_rest, "<M>", 1), after(spm_rest, "<M>"), F.substring_index(body, "<P>", 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """``transform`` with SHA-256 digests instead of the texts: of the output, and of the text restored from it."""
    out = transform(docs)
    columns = [c for c in out.columns if c != "output"]
    return out.select(*columns, F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
