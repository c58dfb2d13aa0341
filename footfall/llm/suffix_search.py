"""Benchmark decontamination: every suffix of the test items is searched in suffix arrays of the training text.

Training documents are read in shards of about ``SHARD_BYTES``. A shard's words become codes of the test items' vocabulary; a word
that no item has equals nothing, itself included, so only suffixes that start with a known word are sorted, by prefix doubling. All
test suffixes are then searched together, word by word: the run of suffixes that share the first k words is narrowed by two binary
searches to those that share k + 1. Where a test suffix's run gets empty, its longest verbatim match in the shard is known, and
while it has a window's width the run is the list of all its places. Words of every place found are compared byte by byte.

Test items travel to the shards in blocks of a bounded size, one pass over the documents for each block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import settle, texts
from footfall.llm.kernels import LOWER, U, Words, steps, text_bytes

WIDTH = 10
SHARD_BYTES = 8_000_000
BLOCK_BYTES = 8_000_000  # of test items searched in one pass
# word bytes: digits, letters, and all of non-ASCII characters
APART = np.ones(256, bool)
APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
FOUND = "doc_id long, text string, spans binary, items array<string>"
COLUMNS = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
MATCHES = "item_id string, start int, length int, doc_id long, place long"


def lowered(words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some words one behind the other, A-Z as a-z, and the length of each."""
    size = words.end[chosen] - words.start[chosen]
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(words.start[chosen], size)
    return LOWER[words.data[inner]], size


@dataclass
class Tests:
    """A block of test items as codes, one number behind each item's words (-1), and what is searched for in them."""

    names: list[str | None]
    hashes: np.ndarray  # of the vocabulary, sorted: a word's code is its place here
    spelling: np.ndarray  # bytes of all words of the vocabulary, and where each begins
    spelling_at: np.ndarray
    codes: np.ndarray
    item: np.ndarray  # of each code
    suffixes: np.ndarray  # where suffixes start
    width: np.ndarray  # words of the window that starts there, 0 for none
    window: np.ndarray  # its number, equal windows having the same
    holders: np.ndarray  # items of the windows, in order of window
    holders_at: np.ndarray
    depth: int  # words of the longest item

    @classmethod
    def of(cls, items: list[tuple[str | None, str | None]], width: int) -> Tests:
        data, offsets = text_bytes(pa.array([t for _, t in items], pa.string()))
        words = Words(data, offsets, APART)
        hashes = words.hashes(lower=True)
        vocabulary, first = np.unique(hashes, return_index=True)
        spelling, size = lowered(words, first)
        n = len(words) + len(items)
        place = np.arange(len(words)) + words.text
        codes, item = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        codes[place], item[place] = np.searchsorted(vocabulary, hashes), words.text
        left = (words.bounds[1:] - 1)[words.text] - np.arange(len(words)) + 1  # words from here to the item's end
        short = (words.count[words.text] < width) & (left == words.count[words.text])
        wide = np.where(left >= width, width, np.where(short, left, 0))
        numbers: dict[bytes, int] = {}
        window, pairs = np.full(len(words), -1, np.int64), []
        for k in np.flatnonzero(wide).tolist():
            p = place[k]
            window[k] = numbers.setdefault(codes[p : p + wide[k]].tobytes(), len(numbers))
            pairs.append((window[k], item[p]))
        held = np.unique(np.array(pairs, np.int64).reshape(-1, 2), axis=0)
        return cls(
            [i for i, _ in items], vocabulary, spelling, np.concatenate([[0], np.cumsum(size)]), codes, item, place, wide, window,
            held[:, 1], np.searchsorted(held[:, 0], np.arange(len(numbers) + 1)), int(words.count.max(initial=0)),
        )


class SuffixArray:
    """Suffixes that begin with a known word, sorted by their first ``depth`` symbols. Unknown symbols (-1) stand before all others
    and equal nothing, so that none is matched."""

    def __init__(self, symbols: np.ndarray, depth: int):
        n = len(symbols)
        self.value = np.where(symbols < 0, -2 - np.arange(n), symbols)
        known = np.flatnonzero(symbols >= 0)
        kind = np.uint16 if symbols.max(initial=0) < 1 << 16 else np.int64
        order = known[np.argsort(symbols[known].astype(kind), kind="stable")]
        rank = np.append(self.value, -1)
        start, twin = self._groups(symbols[order])
        rank[order] = start
        slots, width = np.flatnonzero(twin), 1
        while len(slots) and width < depth:
            active = order[slots]
            key = rank[active] * np.int64(2 * n + 4) + rank[np.minimum(active + width, n)] + (n + 2)
            by = np.argsort(key, kind="stable")
            active = active[by]
            order[slots] = active
            start, twin = self._groups(key[by])
            rank[active] = slots[start]
            slots, width = slots[twin], 2 * width
        self.order = order

    @staticmethod
    def _groups(ranked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted keys: the place where each one's group of equals begins, and whether it has equals."""
        n = len(ranked)
        new = np.ones(n + 1, bool)
        new[1:n] = ranked[1:] != ranked[:-1]
        heads = np.flatnonzero(new)
        size = np.diff(heads)
        return np.repeat(heads[:-1], size), np.repeat(size > 1, size)

    def bound(self, low: np.ndarray, high: np.ndarray, k: int, code: np.ndarray) -> np.ndarray:
        """For each run [low, high) of suffixes with k symbols in common: the first whose next symbol is ``code`` or above."""
        low, high = low.copy(), high.copy()
        last = len(self.value) - 1
        while len(todo := np.flatnonzero(low < high)):
            middle = (low[todo] + high[todo]) >> 1
            below = self.value[np.minimum(self.order[middle] + k, last)] < code[todo]
            low[todo] = np.where(below, middle + 1, low[todo])
            high[todo] = np.where(below, high[todo], middle)
        return low

    def search(self, codes: np.ndarray, starts: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, ...]:
        """For the suffixes of ``codes`` at ``starts``: symbols of the longest match, one of its places, and the run of all places
        that share the first ``width`` symbols (empty where the match is shorter)."""
        n = len(starts)
        longest, place = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        first, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
        alive, low, high = np.arange(n), np.zeros(n, np.int64), np.full(n, len(self.order), np.int64)
        k = 0
        while len(alive):
            code = codes[starts[alive] + k]  # -1 behind an item's words: no symbol of a suffix equals it
            end = self.bound(low, high, k, code + 1)
            low = np.where(code < 0, end, self.bound(low, end, k, code))
            keep = np.flatnonzero((low < end) & (code >= 0))
            alive, low, high = alive[keep], low[keep], end[keep]
            k += 1
            longest[alive], place[alive] = k, self.order[low]
            full = width[alive] == k
            first[alive[full]], last[alive[full]] = low[full], high[full]
        return longest, place, first, last


class Shard:
    """Documents whose suffixes are searched for a block of test items."""

    def __init__(self, column: pa.Array, tests: Tests):
        data, offsets = text_bytes(column)
        self.words, self.tests = Words(data, offsets, APART), tests
        hashes = self.words.hashes(lower=True)
        at = np.searchsorted(tests.hashes, hashes)
        known = at < len(tests.hashes)
        known[known] = tests.hashes[at[known]] == hashes[known]
        place = np.arange(len(self.words)) + self.words.text  # one symbol between texts
        self.symbols = np.full(len(self.words) + len(self.words.count), -1, np.int64)
        self.symbols[place[known]] = at[known]
        self.text = np.repeat(np.arange(len(self.words.count)), self.words.count + 1)
        while True:
            array = SuffixArray(self.symbols, tests.depth)
            self.longest, self.place, first, last = array.search(tests.codes, tests.suffixes, tests.width)
            # one of the equal windows stands for all
            number, one = np.unique(tests.window, return_index=True)
            one = one[number >= 0]
            size = last[one] - first[one]
            at = array.order[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[one], size)]
            self.window, self.at, self.wide = np.repeat(tests.window[one], size), at, np.repeat(tests.width[one], size)
            edge = np.bincount(at, minlength=len(self.symbols) + 1) - np.bincount(at + self.wide, minlength=len(self.symbols) + 1)
            self.hit = np.cumsum(edge)[:-1] > 0
            if not len(false := self.misread()):
                break
            self.symbols[false] = -1

    def misread(self) -> np.ndarray:
        """Hit words whose bytes aren't those of their code, that is, whose hash only is equal."""
        spots = np.flatnonzero(self.hit)
        found, size = lowered(self.words, spots - self.text[spots])
        code, at = self.symbols[spots], self.tests.spelling_at
        wanted = at[code + 1] - at[code]
        same = size == wanted
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        expected = self.tests.spelling[np.minimum(np.repeat(at[code], size) + inner, max(0, len(self.tests.spelling) - 1))]
        if len(spots):
            same &= np.add.reduceat((found != expected).astype(np.int64), np.cumsum(size) - size) == 0
        return spots[~same]

    def items(self) -> list[set[int]]:
        """For each document the items of which a window occurs."""
        out: list[set[int]] = [set() for _ in self.words.count]
        pairs = np.unique(self.text[self.at] * np.int64(len(self.tests.holders_at)) + self.window)
        at = self.tests.holders_at
        for p in pairs.tolist():
            text, window = divmod(p, len(at))
            out[text].update(self.tests.holders[at[window] : at[window + 1]].tolist())
        return out


def blocks(benchmark: DataFrame, width: int) -> Iterator[Tests]:
    """The test items in blocks of about ``BLOCK_BYTES``; equal rows count once. At least one block, empty for an empty table."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text") + 16).alias("n")).first()["n"] or 0
    count = max(1, -(-size // BLOCK_BYTES))
    for k in range(count):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        yield Tests.of(sorted(((r["item_id"], r["text"]) for r in mine.collect()), key=lambda r: (r[0] is None, r[0] or "", r[1])), width)


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Of every document: words, words inside any occurrence of a window of a test item, how many items have occurring windows and the
    SHA-256 of their ids (sorted as strings, joined by commas), and whether any word is hit.

    A window is ``width`` consecutive words of an item, or all words of an item that has fewer. Null and empty texts have no words.
    Repeated documents are searched each; rows of one item id are one item, and items without id hit words but aren't counted. A
    document is never split, so the longest one needs memory of about 40 times its bytes.
    """
    rows = texts(docs).select("doc_id", "text", F.lit(b"").alias("spans"), F.array().cast("array<string>").alias("items"))
    before, parts = None, blocks(benchmark, width)
    for tests in parts:
        if before is not None:  # another pass follows: keep what the last one found
            rows = settle(rows.mapInArrow(searching(rows, before, False), FOUND))
        before = tests
    return rows.mapInArrow(searching(rows, before, True), COLUMNS)


def searching(rows: DataFrame, tests: Tests, finish: bool):
    """A pass over documents for one block: adds spans of hit words and items to those found before, or says what comes of them."""
    sent = rows.sparkSession.sparkContext.broadcast(tests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, size=SHARD_BYTES):
            shard = Shard(batch.column(1), sent.value)
            hit, words = shard.hit, shard.words
            names = [{sent.value.names[i] for i in found} - {None} | set(was) for found, was in zip(shard.items(), batch.column(3).to_pylist(), strict=True)]
            starts = words.bounds[:-1] + np.arange(len(words.count))  # a symbol between texts
            for k, was in enumerate(batch.column(2).to_pylist()):
                for a, b in np.frombuffer(was, np.int32).reshape(-1, 2).tolist():
                    hit[starts[k] + a : starts[k] + b] = True
            if finish:
                n_hit = np.bincount(shard.text[hit], minlength=len(words.count))
                joined = [hashlib.sha256(",".join(sorted(n)).encode()).hexdigest() for n in names]
                columns = [words.count, n_hit, np.array(list(map(len, names)), np.int64), joined, n_hit > 0]
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], [c.split()[0] for c in COLUMNS.split(", ")])
            else:
                spans = [runs_of(hit[a : a + n]) for a, n in zip(starts.tolist(), words.count.tolist(), strict=True)]
                found = [pa.array(spans, pa.binary()), pa.array([sorted(n) for n in names], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found], [c.split()[0] for c in FOUND.split(", ")])

    return run


def runs_of(hit: np.ndarray) -> bytes:
    """First and last + 1 of each run of True, as 32-bit numbers."""
    edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1).astype(np.int32).tobytes()


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window of a test item occurs."""
    place = docs.columns.index("text")

    def keeping(tests: Tests):
        sent = docs.sparkSession.sparkContext.broadcast(tests)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in steps(batches, size=SHARD_BYTES):
                shard = Shard(batch.column(place), sent.value)
                affected = np.bincount(shard.text[shard.hit], minlength=batch.num_rows) > 0
                yield batch.filter(pa.array(~affected))

        return run

    for tests in blocks(benchmark, width):
        docs = docs.mapInArrow(keeping(tests), docs.schema)
    return docs


def longest_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For every suffix of every test item (by the number of its first word) that matches anywhere: the words of its longest verbatim
    match in any document, and where one stands: document and word."""

    def matching(tests: Tests):
        sent = docs.sparkSession.sparkContext.broadcast(tests)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in steps(batches, size=SHARD_BYTES):
                tests, shard = sent.value, Shard(batch.column(1), sent.value)
                some = np.flatnonzero(shard.longest)
                at = shard.place[some]
                text = shard.text[at]
                item = tests.item[tests.suffixes[some]]
                head = np.searchsorted(tests.item[tests.suffixes], item)
                ids = batch.column(0).take(pa.array(text))
                place = at - (shard.words.bounds[text] + text)
                names = pa.array([tests.names[i] for i in item.tolist()], pa.string())
                numbers = [pa.array((some - head).astype(np.int32)), pa.array(shard.longest[some].astype(np.int32)), ids, pa.array(place)]
                yield pa.RecordBatch.from_arrays([names, *numbers], [c.split()[0] for c in MATCHES.split(", ")])

        return run

    out = None
    for tests in blocks(benchmark, 1):
        found = texts(docs).mapInArrow(matching(tests), MATCHES)
        out = found if out is None else out.unionByName(found)
    best = F.max(F.struct("length", -F.col("doc_id"), -F.col("place"))).alias("best")
    return out.groupBy("item_id", "start").agg(best).select("item_id", "start", F.col("best.length"), (-F.col("best.col2")).alias("doc_id"), (-F.col("best.col3")).alias("place"))
