"""Quality rules: repetition inside a text, measured on an enhanced suffix array of its words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from footfall.llm.common import texts
from footfall.llm.kernels import Words, mix, steps, text_bytes, windows
from footfall.llm.suffixes import RepeatArray, longest_at, maximal_repeats, union

SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 8
MOST_COVERED = 0.4
MOST_REPEAT = 200
COLUMNS = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, covered double, longest_repeat long"
)


def per_text(words: Words) -> np.ndarray:
    """Word codes that are equal only for equal words of the same text."""
    return mix(words.hashes() + mix(words.text.astype(np.uint64)))


def repetition(words: Words, codes: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Per text: the fraction of its word bytes inside maximal repeats of ``least`` words or more, and the longest, in words.

    Every occurrence counts, the first one and overlapping ones too.
    """
    n = len(words.count)
    longest = longest_at(RepeatArray(codes, least), len(codes))
    starts = np.flatnonzero(longest)
    inside = union(starts, longest[starts], len(codes))
    size = (words.end - words.start).astype(float)
    total = np.bincount(words.text, size, minlength=n)
    part = np.bincount(words.text[inside], size[inside], minlength=n)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, words.text[starts], longest[starts])
    return part / np.maximum(total, 1), most


def repeats(text: str, least: int = LEAST_WORDS) -> list[tuple[int, list[int]]]:
    """The maximal repeats of one text: (length in words, word numbers where it starts)."""
    words = Words(*text_bytes(pa.array([text])))
    codes = per_text(words)
    before = np.append(np.uint64(0), codes[:-1]) if len(codes) else codes
    return [(size, sorted(at.tolist())) for size, at in maximal_repeats(RepeatArray(codes, least), before)]


def measure(data: np.ndarray, offsets: np.ndarray, least_words: int, covered: float, longest: int) -> list[np.ndarray]:
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    words = Words(data, offsets)
    codes = per_text(words)
    lead = (data & 0xC0) != 0x80
    letters = np.zeros(256, bool)
    letters[list(SYMBOLS)] = True
    blank = np.zeros(256, bool)
    blank[[0x20, *range(0x09, 0x0E)]] = True
    chars = np.bincount(owner[lead & ~blank[data]], minlength=n)
    symbols = np.bincount(owner[letters[data]], minlength=n)
    newline = np.zeros(256, bool)
    newline[10] = True
    lines = Words(data, offsets, newline)
    filled = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    keys, line_text = per_text(lines)[filled], lines.text[filled]
    again = np.ones(len(keys), bool)
    again[np.unique(keys, return_index=True)[1]] = False
    dup_lines = np.bincount(line_text[again], minlength=n)
    threes, at = windows(words, codes, 3)
    _, inverse, count = np.unique(threes, return_inverse=True, return_counts=True)
    twice = at[count[inverse] > 1]
    repeated = union(twice, np.full(len(twice), 3), len(codes))
    repeat_words = np.bincount(words.text[repeated], minlength=n)
    failed = (words.count < least_words) | (100 * repeat_words > 50 * words.count)
    fraction, most = repetition(words, codes)
    kept = ~failed & (fraction <= covered) & (most <= longest)
    return [words.count, chars, symbols, dup_lines, repeat_words, failed, kept, fraction, most]


def judge(docs: DataFrame, least_words: int = 50, covered: float = MOST_COVERED, longest: int = MOST_REPEAT) -> DataFrame:
    """Counts and verdict for every text, in one scan without a shuffle.

    A text passes if it has ``least_words`` words, at most half of them in 3-word windows found twice, at most ``covered`` of
    its word bytes inside repeats of 8 words or more, and no repeat longer than ``longest`` words. A null or empty text has no
    words and fails. Repeated rows are judged each; matches never cross texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            columns = measure(*text_bytes(batch.column(1)), least_words, covered, longest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c if c.dtype in (bool, float) else c.astype(np.int64)) for c in columns)],
                [c.split()[0] for c in COLUMNS.split(", ")],
            )

    return texts(docs).mapInArrow(run, COLUMNS)
