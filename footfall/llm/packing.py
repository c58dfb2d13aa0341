"""Best-fit packing planned on the histogram of lengths.

How many pieces there are of each length is a table of at most ``SIZE`` numbers, whatever the corpus. Best fit, longest first, is
run over these counts: it says for the pieces of one length, ordered by rank, which sequence and place each gets, in runs of equal
steps. The plan's size depends on the number of lengths only, so every task can hold it; the pieces then take their places by rank
within their length.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import partitions, settle, texts
from footfall.llm.kernels import steps

SIZE = 4096
END_ID = 1
REMEMBERED = 1_000_000
TOGETHER = 500  # words of letters that the library gets at a time
STEP_BYTES = 6_000_000
# Small letters that no normal form changes, and that large ones turn into by any rule.
LETTERS = re.compile("[a-zà-öø-ÿ]+").fullmatch
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
_loaded: dict[str, WordTokenizer] = {}


class WordTokenizer:
    """Ids by the tokenizers library, word by word, for a tokenizer that drops white space and joins nothing across it.

    The ids of a word between blanks or line ends do not depend on its neighbours. So a step's words are told apart first, and each
    worker keeps the ids of those it has seen in a bounded table. Words of Latin letters, which any rule turns into the same small
    letters, are given to the library many at a time, and the ids that end a word tell them apart; any other word goes alone.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.table: dict[str, bytes] = {"": b""}
        self.marks = {m: self._encode([m])[0] for m in (".", ",")}

    def _encode(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(parts, add_special_tokens=False)]

    def _learn_letters(self, words: list[str]) -> None:
        words = list(dict.fromkeys(words))
        for a in range(0, len(words), TOGETHER):
            some = words[a : a + TOGETHER]
            raw = self._encode([" ".join(some)])[0]
            stops = (4 * np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 4).tolist()
            if len(stops) == len(some) and len(raw) == stops[-1]:
                self.table.update(zip(some, map(raw.__getitem__, map(slice, [0, *stops], stops)), strict=True))
            else:
                self.table.update(zip(some, self._encode(some), strict=True))

    def ids_of(self, words: list[str]) -> list[bytes]:
        """The ids of each word. A word that ends with a mark is what stands before it, and the mark."""
        if len(self.table) > REMEMBERED:
            self.table = {"": b""}
        table, marks, other = self.table, self.marks, []
        found = list(map(table.get, words))
        new = [k for k, raw in enumerate(found) if raw is None]
        cores = [words[k][:-1] if words[k][-1] in marks else words[k] for k in new]
        low = " ".join(cores).lower().split(" ") if new else []
        letters = list(map(LETTERS, low))
        self._learn_letters([c for c, fit in zip(low, letters, strict=True) if fit and c not in table])
        for k, core, small, fit in zip(new, cores, low, letters, strict=True):
            word = words[k]
            if fit or not core:
                found[k] = table[word] = table[small] + marks[word[-1]] if len(word) > len(core) else table[small]
            else:
                other.append(k)
        raw = self._encode([words[k] for k in other])
        for k, ids in zip(other, raw, strict=True):
            found[k] = table[words[k]] = ids
        return found

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (one more than texts)."""
        words = pc.split_pattern(pc.replace_substring(column.fill_null(""), "\n", " "), " ")
        bounds = words.offsets.to_numpy()
        each = words.flatten().dictionary_encode()
        raw = self.ids_of(each.dictionary.to_pylist())
        size = np.array(list(map(len, raw)), np.int64) // 4
        first = np.cumsum(size) - size
        which = each.indices.to_numpy()
        wide = size[which]
        ends = np.append(0, np.cumsum(wide))
        at = np.arange(ends[-1], dtype=np.int32) + np.repeat((first[which] - ends[:-1]).astype(np.int32), wide)
        return np.frombuffer(b"".join(raw), "<u4")[at], ends[bounds - bounds[0]]


def tokenizer(path: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def pieces(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Cut the ids of every text, ``end_id`` behind them, into pieces of ``size`` (the last may be shorter)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(path)
        tail = np.array([end_id], "<u4")
        for batch in steps(batches, size=STEP_BYTES):
            rows = []
            every, bounds = words.encode(batch.column(1))
            for doc, a, b in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                ids = np.concatenate([every[a:b], tail])
                rows += [(doc, k, a, len(p := ids[a : a + size]), zlib.crc32(p)) for k, a in enumerate(range(0, len(ids), size))]
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in PIECES.split(", ")])

    return texts(docs).mapInArrow(run, PIECES)


@dataclass
class Runs:
    """Of one length: the pieces from ``rank`` on go ``each`` to a sequence, starting with sequence ``first`` at ``offset``."""

    rank: np.ndarray
    each: np.ndarray
    first: np.ndarray
    offset: np.ndarray


def best_fit(counts: dict[int, int], size: int = SIZE) -> tuple[dict[int, Runs], int]:
    """Best fit, longest first, over counts of lengths: the runs of each length and the number of sequences.

    Open sequences with the same room are one or a few ranges of numbers. A length goes to the least room that holds it, as many
    to a sequence as fit there, which is what best fit does piece by piece.
    """
    ranges: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    total = 0
    out: dict[int, list[tuple[int, int, int, int]]] = {}

    def give_back(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in ranges:
                ranges[room] = []
                insort(rooms, room)
            ranges[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank, runs = counts[length], 0, []
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = ranges[room].pop()
                if not ranges[room]:
                    del ranges[room], rooms[at]
            else:
                room, each = size, size // length
                first, n = total, -(-left // each)
                total += n
            each = room // length
            whole = min(n, left // each)
            if whole:
                runs.append((rank, each, first, size - room))
                rank, left = rank + whole * each, left - whole * each
                give_back(room - each * length, first, whole)
            if whole < n:
                if left:  # fewer than fit: they end in one sequence
                    runs.append((rank, left, first + whole, size - room))
                    give_back(room - left * length, first + whole, 1)
                    rank, left, whole = rank + left, 0, whole + 1
                give_back(room, first + whole, n - whole)
        out[length] = runs
    return {k: Runs(*(np.array(c, np.int64) for c in zip(*v, strict=True))) for k, v in out.items()}, total


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Give every piece a sequence and an offset there. ``cut`` has a ``length`` (1 to ``size``) and is read more than once."""
    counts = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan, _ = best_fit(counts, size)
    # ranks within a length: counts of small parts first, then rows inside a part, so a common length is no single task's
    parts = max(64, 4 * partitions(cut.sparkSession))
    rows = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    sums = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    ahead = sums.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    names = [c for c in cut.columns]
    ranked = rows.withColumn("inside", inside).join(ahead, ["length", "part"]).select(*names, (F.col("ahead") + F.col("inside")).cast("long").alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(names.index("length")).to_numpy(), batch.column(len(names)).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            heads = np.flatnonzero(np.append(True, np.diff(length[order]) != 0)) if len(order) else []
            for rows_ in np.split(order, heads[1:]) if len(order) else []:
                runs = plan[int(length[rows_[0]])]
                at = np.searchsorted(runs.rank, rank[rows_], "right") - 1
                step = rank[rows_] - runs.rank[at]
                sequence[rows_] = runs.first[at] + step // runs.each[at]
                offset[rows_] = runs.offset[at] + step % runs.each[at] * length[rows_]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in cut.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def pack_texts(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Tokenize, cut and pack all texts. A null or empty text is a piece of the end id alone; repeated rows are packed each."""
    return pack(settle(pieces(docs, path, size, end_id)), size).select(*[c.split()[0] for c in PACKED.split(", ")])
