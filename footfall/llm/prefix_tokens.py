"""Token counts of every prefix, by dynamic programming over the last token of each.

The tokens of a prefix are those of a shorter one and one last token behind them. Which, is settled by a property of merging by rank:
a row of tokens is what the tokenizer gives for its text exactly if that holds for every two neighbours in it. So

    count[i] = count[i - |t|] + 1    for the one piece t ending at i that is stable behind the last token of prefix i - |t|

An automaton over all pieces lists those that end at each place, the longest first. Whether two tokens are stable side by side is
asked of the library once and remembered. The work is linear in the text, however long its words are.

No merge joins two characters that stand side by side in none of the pieces. Cut there, a text falls into segments (mostly words)
whose counts do not depend on what surrounds them; each distinct one is worked out once by a worker, in a bounded table, and sums over
segments give the counts of the text. They answer how many tokens any cut has and where a budget ends, without encoding again.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import texts
from footfall.llm.kernels import steps, text_bytes

LIMIT = 4096
# What a worker remembers before it starts anew: characters of segments, pairs of tokens. Both change speed only.
REMEMBERED = 12_000_000
PAIRS = 2_000_000
STEP_BYTES = 4_000_000
SPACE = "▁"  # what the tokenizer writes for a blank
COLUMNS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, limit_chars long"
_loaded: dict[str, PrefixCounter] = {}


class Counts:
    """Of a batch of texts: the segments of all texts in a row, and the counts inside the distinct ones.

    ``first`` and ``size``: where each segment's counts begin in ``inner`` and how many; ``bounds``: the segments of each text."""

    def __init__(self, inner: np.ndarray, first: np.ndarray, size: np.ndarray, bounds: np.ndarray):
        self.inner, self.first, self.size, self.bounds = inner, first, size, bounds
        self.ahead = np.append(0, np.cumsum(inner[first + size - 1], dtype=np.int64))

    def totals(self) -> np.ndarray:
        """Tokens of each whole text."""
        return self.ahead[self.bounds[1:]] - self.ahead[self.bounds[:-1]]

    def prefixes(self, k: int) -> np.ndarray:
        """count[i]: tokens of the first i + 1 characters of text k."""
        a, b = self.bounds[k], self.bounds[k + 1]
        size, first = self.size[a:b], self.first[a:b]
        at = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
        # the first place is the blank in front, which is no character of the text
        return (self.inner[at] + np.repeat(self.ahead[a:b] - self.ahead[a], size))[1:]


class PrefixCounter:
    """Counts for the pieces of one tokenizer file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.library.get_piece_size())
        self.pieces = {i: self.library.id_to_piece(i) for i in ids if not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i))}
        # side by side in some piece: only then a merge may cross
        beside = {a + b for p in self.pieces.values() for a, b in zip(p, p[1:], strict=False)}
        self.words_end_at_blanks = not any(p[1] == SPACE and p[0] != SPACE for p in beside)
        self.lines_stand_alone = not any("\n" in p for p in beside)
        known = set(self.pieces.values())
        if not {c for p in known for c in p} <= known:
            raise ValueError("a piece has a character that is no piece")
        self.automaton = ahocorasick.Automaton()
        for i, p in self.pieces.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.lead = self.library.encode("\n")
        # of two neighbours, id * id: stable or not. Behind nothing, or a character that is no piece (0), a piece need only give itself
        self.pairs: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.table: dict[bytes, int] = {}
        self.inner = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.first: list[int] = []
        self.size: list[int] = []

    def stable(self, left: int, right: int) -> bool:
        """Whether the library gives these two tokens for their text."""
        if len(self.pairs) > PAIRS:
            self.pairs = {}
        text = (self.pieces[left] if left else "") + self.pieces[right]
        found = self.library.encode("\n" + text.replace(SPACE, " ")) == [*self.lead, *([left] if left else []), right]
        self.pairs[left << 32 | right] = found
        return found

    def counts(self, segment: str) -> list[int]:
        """Tokens of every beginning of a segment."""
        n, done, pairs = len(segment), 0, self.pairs
        last, count = [0] * (n + 1), [0] * (n + 1)
        for end, (piece, length) in self.automaton.iter(segment):
            if end < done:  # a longer piece was stable
                continue
            while done < end:  # characters that are no piece stand as bytes
                count[done + 1] = count[done] + len(segment[done].encode())
                done += 1
            begin = end + 1 - length
            fits = pairs.get(last[begin] << 32 | piece)
            if fits is None:
                fits = self.stable(last[begin], piece)
                pairs = self.pairs
            if fits:
                done = end + 1
                last[done], count[done] = piece, count[begin] + 1
        while done < n:
            count[done + 1] = count[done] + len(segment[done].encode())
            done += 1
        return count[1:]

    def segments(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All segments of the texts, a blank in front of each text, and the number of each text's first (one more than texts)."""
        spaced = pc.replace_substring(column.cast(pa.large_string()).fill_null(""), SPACE, " ")
        data, offsets = text_bytes(pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), spaced, pa.scalar("", pa.large_string())))
        start = np.zeros(len(data) + 1, bool)
        start[offsets] = True
        if self.words_end_at_blanks and self.lines_stand_alone:
            # a word has the blanks before it; a line end stands alone
            blank, line = data == 0x20, data == 0x0A
            start[:-1] |= line
            start[1:-1] |= line[:-1] | (blank[1:] & ~blank[:-1])
        at = np.flatnonzero(start)
        cut = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
        return cut, np.searchsorted(at, offsets)

    def of(self, column: pa.Array) -> Counts:
        """Counts of all texts of a column."""
        if self.used > REMEMBERED:
            self.forget()
        cut, bounds = self.segments(column)
        each = cut.dictionary_encode()
        known = each.dictionary.to_pylist()
        numbers = list(map(self.table.get, known))
        new, flat = [k for k, number in enumerate(numbers) if number is None], []
        for k in new:
            numbers[k] = self.table[known[k]] = len(self.first)
            counts = self.counts(known[k].decode().replace(" ", SPACE))
            self.first.append(self.used + len(flat))
            self.size.append(len(counts))
            flat += counts
        self.keep(flat)
        which = np.array(numbers, np.int64)[each.indices.to_numpy()] if len(cut) else np.zeros(0, np.int64)
        return Counts(self.inner, np.array(self.first, np.int64)[which], np.array(self.size, np.int64)[which], bounds)

    def keep(self, counts: list[int]) -> None:
        end = self.used + len(counts)
        if end > len(self.inner):
            self.inner = np.concatenate([self.inner, np.zeros(end, np.int32)])
        self.inner[self.used : end] = counts
        self.used = end


def counter(path: str) -> PrefixCounter:
    if path not in _loaded:
        _loaded[path] = PrefixCounter(path)
    return _loaded[path]


def longest_prefix(counts: np.ndarray, budget: int) -> int:
    """How many characters of a text, from its start, have at most ``budget`` tokens. Counts may fall by a character, so the last
    place counts."""
    fit = np.flatnonzero(counts <= budget)
    return int(fit[-1]) + 1 if len(fit) else 0


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``counts``: the token count of every prefix, by characters. An empty or null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, size=STEP_BYTES):
            found = counter(path).of(batch.column(1))
            counts = [found.prefixes(k).astype(np.int32) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.list_(pa.int32()))], ["doc_id", "counts"])

    return texts(docs).mapInArrow(run, "doc_id long, counts array<int>")


def tokens_at(counted: DataFrame, chars: int) -> DataFrame:
    """From ``prefix_counts``: tokens of each text cut after ``chars`` characters."""
    size = F.least(F.size("counts"), F.lit(chars))
    return counted.select("doc_id", F.when(size > 0, F.element_at("counts", size)).otherwise(0).cast("long").alias("n_tokens"))


def count(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Bytes, tokens, whether they exceed ``limit``, and the longest prefix (in characters) within it.

    No special tokens are added. Null and empty texts have no tokens; repeated rows are counted each. Time is linear in the text, and
    a text needs memory of about 20 times its bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, size=STEP_BYTES):
            column = batch.column(1)
            found = counter(path).of(column)
            # an empty text is the blank in front alone, which the library drops
            chars = pc.utf8_length(column).to_numpy().astype(np.int64)
            total = np.where(chars > 0, found.totals(), 0)
            over = total > limit
            fit = chars.copy()
            for k in np.flatnonzero(over).tolist():
                fit[k] = longest_prefix(found.prefixes(k), limit)
            columns = [pc.binary_length(column).cast(pa.int64()), pa.array(total), pa.array(over), pa.array(fit)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [c.split()[0] for c in COLUMNS.split(", ")])

    return texts(docs).mapInArrow(run, COLUMNS)
