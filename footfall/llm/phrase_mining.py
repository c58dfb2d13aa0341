"""Collocations of two to five words, by Rabin-Karp fingerprints of all n-grams.

Words of a step of text are hashed, and one prefix polynomial over these hashes gives the fingerprint of every n-gram as a difference
of two of its values. The shuffle adds up fingerprints that tasks have counted. A phrase is at most as frequent as its parts, so

1. all words are counted,
2. pairs of frequent words,
3. runs of three to five words of which all neighbours are frequent pairs.

What the next pass needs to know of a count is whether it reached the limit: one bit in a bitmap of a fixed size, found by the
fingerprint. A wrong bit lets more through and leaves nothing out, so bits and fingerprints may collide. The last pass reads the
texts once more: occurrences whose bit is set are compared, word by word, with the text of the one that their fingerprint points
to, and only these phrases are written out and counted by their text, with a document that has them. All further numbers come
from these exact counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import groupby, pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import partitions, settle
from footfall.llm.kernels import LOWER, U, Words, mix, steps, text_bytes
from footfall.llm.suffix_dedup import loosen, squeeze

LONGEST = 5
LEAST = 100
ABSORBED = 100  # percent of a phrase's occurrences that a longer one needs to replace it
FIRST = 2000
BITS = 1 << 27
SHARD_BYTES = 4_000_000
FLUSH = 4_000_000  # fingerprints that a task gathers before it counts them
ROWS = 300_000  # phrases that a task gathers before it sends them
# What meets in one bucket: fingerprints of so much text, so many bits' phrases. The number of buckets follows from the data.
BUCKET_BYTES = 16_000_000
BUCKET_PHRASES = 20_000
PARTS = 64
MULTIPLIER = 0x5851F42D4C957F2D
NOBODY = np.iinfo(np.int64).max
FOUND = "lang string, size int, phrase string, f long, doc_id long"
LISTED = "bucket int, lang array<string>, size array<int>, phrase array<string>, f array<long>, doc_id array<long>"
NAMES = ["lang", "size", "phrase", "f", "doc_id"]
ARROW = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("f", pa.int64()), ("doc_id", pa.int64())])

BREAK = np.zeros(256, bool)
BREAK[[*map(ord, ".,;:!?"), *range(0x0A, 0x0E)]] = True
APART = BREAK.copy()
APART[[0x20, 0x09]] = True


class Powers:
    """Powers of the multiplier and of its inverse, as many as the largest step asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.cumprod(np.append(U(1), np.full(n - 1, m, U)), dtype=U) for m in (MULTIPLIER, pow(MULTIPLIER, -1, 2**64)))
        return self.up[:n], self.down[:n]


POWERS = Powers()


class Bitmap:
    """Which fingerprints were frequent, a bit each."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells

    def test(self, prints: np.ndarray) -> np.ndarray:
        at = prints & U(BITS - 1)
        return (self.cells[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1) == 1

    def __getstate__(self) -> bytes:
        return zstandard.ZstdCompressor(level=1).compress(self.cells.tobytes())

    def __setstate__(self, state: bytes) -> None:
        self.cells = np.frombuffer(zstandard.ZstdDecompressor().decompress(state), U)


class Grams:
    """All n-grams of a step: word hashes, the pieces they stand in, and the prefix polynomial over them."""

    def __init__(self, batch: pa.RecordBatch):
        data, offsets = text_bytes(batch.column(1))
        self.words = words = Words(data, offsets, APART)
        n = len(words)
        languages = batch.column(2).dictionary_encode()
        self.languages, self.language = languages.dictionary.to_pylist(), languages.indices.to_numpy()[words.text]
        # words left in the piece, this one included
        breaks = np.searchsorted(np.flatnonzero(BREAK[data]), words.start)
        new = np.ones(n + 1, bool)
        new[1:n] = (breaks[1:] != breaks[:-1]) | (words.text[1:] != words.text[:-1])
        heads = np.flatnonzero(new)
        self.left = np.repeat(heads[1:], np.diff(heads)) - np.arange(n)
        up, self.down = POWERS.get(max(n, 1))
        self.sums = np.append(U(0), np.cumsum(words.hashes(lower=True) * up[:n], dtype=U))
        self.language_key = np.array([int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.languages], U)

    def prints(self, at: np.ndarray, size: int) -> np.ndarray:
        """Fingerprints of the n-grams of ``size`` words that start at the given words; they depend on the language too."""
        return mix((self.sums[at + size] - self.sums[at]) * self.down[at] + self.language_key[self.language[at]] + U(size))

    def candidates(self, bitmap: Bitmap | None, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
        """For each size where n-grams start whose words, and if longer whose pairs of neighbours, are frequent by the bitmap."""
        every = np.arange(len(self.words))
        if bitmap is None:
            return {1: every}
        known = np.append(bitmap.test(self.prints(every, 1)), False)
        two = np.flatnonzero((self.left >= 2) & known[:-1] & known[1:])
        out = {1: np.flatnonzero(known[:-1]), 2: two}
        if max(sizes) > 2:
            pair = np.zeros(len(self.words) + LONGEST, bool)
            pair[two[bitmap.test(self.prints(two, 2))]] = True
            run = np.flatnonzero(pair[:-LONGEST])
            for size in range(3, LONGEST + 1):
                run = run[pair[run + size - 2]]
                out[size] = run
        return {s: out[s] for s in sizes}


def with_language(docs: DataFrame) -> DataFrame:
    """Only what counts: id, text and language; a null text is an empty one, a null language ``und``."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), lang)


def dealt(pieces: DataFrame, answer, schema: str) -> DataFrame:
    """Deal rows out by their first column, a bucket, and give ``answer`` one bucket's batches at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b, batch.slice(k, 1)) for batch in batches for k, b in enumerate(batch.column(0).to_pylist()))
        for _, mine in groupby(rows, key=lambda r: r[0]):
            yield answer(row for _, row in mine)

    return pieces.repartition(partitions(pieces.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def frequent(rows: DataFrame, bitmap: Bitmap | None, sizes: tuple[int, ...], least: int, buckets: int) -> Bitmap:
    """Count the fingerprints of all candidates of the given sizes, and add a bit for each that occurs ``least`` times.

    Tasks send sorted fingerprints with their counts, packed, to buckets by the highest bits."""
    sent = rows.sparkSession.sparkContext.broadcast(bitmap)
    heads = np.array([(k << 64) // buckets for k in range(1, buckets)], U)

    def packed(gathered: list[np.ndarray]) -> pa.RecordBatch:
        prints, n = np.unique(np.concatenate(gathered), return_counts=True)
        cut = np.concatenate([[0], np.searchsorted(prints, heads), [len(prints)]]).tolist()
        spans = [(k, a, b) for k, (a, b) in enumerate(pairwise(cut)) if a < b]
        payloads = [squeeze(np.diff(prints[a:b], prepend=U(0)), n[a:b]) for _, a, b in spans]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in spans], pa.int32()), pa.array(payloads, pa.binary())], ["bucket", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, held = [], 0
        for batch in steps(batches, size=SHARD_BYTES):
            grams = Grams(batch)
            for size, at in grams.candidates(sent.value, sizes).items():
                gathered.append(grams.prints(at, size))
                held += len(at)
            if held > FLUSH:
                yield packed(gathered)
                gathered, held = [], 0
        if held:
            yield packed(gathered)

    def reach(mine: Iterator[pa.RecordBatch]) -> pa.RecordBatch:
        parts = [loosen(row.column(1)[0].as_py(), U, np.int64) for row in mine]
        prints = np.concatenate([np.cumsum(p[0], dtype=U) for p in parts])
        order = np.argsort(prints, kind="stable")
        prints, n = prints[order], np.concatenate([p[1] for p in parts])[order]
        first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
        bits = np.unique(prints[first[np.add.reduceat(n, first) >= least]] & U(BITS - 1))
        return pa.RecordBatch.from_arrays([pa.array(bits.astype(np.int64))], ["bit"])

    bits = dealt(rows.mapInArrow(run, "bucket int, payload binary"), reach, "bit long")
    cells = bits.groupBy(F.shiftright("bit", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    found = cells.toArrow()  # at most BITS / 64 rows
    out = np.zeros(BITS // 64, U) if bitmap is None else bitmap.cells.copy()
    out[found["cell"].to_numpy()] |= found["bits"].to_numpy().view(U)
    return Bitmap(out)


def spelled(grams: Grams, bitmap: Bitmap, ids: np.ndarray) -> Iterator[tuple]:
    """Language, size, phrase, count and smallest document of the step's frequent n-grams, compared with the text; and with size 0
    the words of each language."""
    words = grams.words
    total = np.bincount(grams.language, minlength=len(grams.languages))
    yield from ((lang, 0, "", n, None) for lang, n in zip(grams.languages, total.tolist(), strict=True) if n)
    chosen = grams.candidates(bitmap, tuple(range(1, LONGEST + 1)))
    # exact codes of the frequent words, from their bytes
    one = chosen[1]
    size = words.end[one] - words.start[one]
    ends = np.cumsum(size)
    inner = np.arange(size.sum()) - np.repeat(ends - size, size) + np.repeat(words.start[one], size)
    buffers = [None, pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(LOWER[words.data[inner]])]
    spelling = pa.Array.from_buffers(pa.large_binary(), len(one), buffers).dictionary_encode()
    names = [w.decode() for w in spelling.dictionary.to_pylist()]
    code = np.full(len(words), -1, np.int64)
    code[one] = spelling.indices.to_numpy()
    doc = ids[words.text]
    for width, at in chosen.items():
        prints = grams.prints(at, width)
        if width > 1:
            keep = bitmap.test(prints)
            at, prints = at[keep], prints[keep]
        while len(at):
            _, pointer, group = np.unique(prints, return_index=True, return_inverse=True)
            pointer = at[pointer]
            same = grams.language[at] == grams.language[pointer][group]
            for j in range(width):
                same &= code[at + j] == code[pointer + j][group]
            n = np.bincount(group[same], minlength=len(pointer))
            least = np.full(len(pointer), NOBODY)
            np.minimum.at(least, group[same], doc[at[same]])
            spelt = [code[pointer + j].tolist() for j in range(width)]
            texts_ = [" ".join([names[c] for c in cs]) for cs in zip(*spelt, strict=True)] if width > 1 else [names[c] for c in spelt[0]]
            for k, lang in enumerate(grams.language[pointer].tolist()):
                yield grams.languages[lang], width, texts_[k], int(n[k]), None if least[k] == NOBODY else int(least[k])
            at, prints = at[~same], prints[~same]  # others of the same fingerprint, if any


def phrases(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """All phrases of one to five words that occur ``least`` times in their language, counted by their text; with size 0 and an empty
    phrase the words of each language."""
    rows, bitmap = with_language(docs), None
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    few = partitions(rows.sparkSession)
    for sizes in ((1,), (2,), (3, 4, 5)):
        bitmap = frequent(rows, bitmap, sizes, least, max(few, size // BUCKET_BYTES))
    sent = rows.sparkSession.sparkContext.broadcast(bitmap)
    buckets = max(few, int(np.bitwise_count(bitmap.cells).sum()) // BUCKET_PHRASES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[tuple, tuple] = {}
        for batch in steps(batches, size=SHARD_BYTES):
            ids = batch.column(0).fill_null(NOBODY).to_numpy()
            add(table, spelled(Grams(batch), sent.value, ids))
            if len(table) > ROWS:
                yield listed(table, buckets)
                table = {}
        if table:
            yield listed(table, buckets)

    def total(mine: Iterator[pa.RecordBatch]) -> pa.RecordBatch:
        table: dict[tuple, tuple] = {}
        for row in mine:
            add(table, zip(*(c[0].as_py() for c in row.columns[1:]), strict=True))
        return pa.RecordBatch.from_pylist([dict(zip(NAMES, (*k, *v), strict=True)) for k, v in table.items() if v[0] >= least or not k[1]], ARROW)

    return dealt(rows.mapInArrow(run, LISTED), total, FOUND)


def add(table: dict[tuple, tuple], found) -> None:
    for lang, size, phrase, n, doc in found:
        have = table.get((lang, size, phrase))
        if have is not None:
            n, doc = n + have[0], have[1] if doc is None else doc if have[1] is None else min(doc, have[1])
        table[lang, size, phrase] = n, doc


def listed(table: dict[tuple, tuple], buckets: int) -> pa.RecordBatch:
    """Lists of what goes to each bucket, by the phrase's own hash."""
    parts: dict[int, list[tuple]] = {}
    for key, value in table.items():
        parts.setdefault(crc32(repr(key).encode()) % buckets, []).append((*key, *value))
    columns = list(zip(*(zip(*rows, strict=True) for rows in parts.values()), strict=True))
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
    lists = [pa.array(list(map(list, c)), pa.list_(k)) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), *lists], ["bucket", *NAMES])


def collocations(docs: DataFrame, least: int = LEAST, first: int | None = FIRST, absorbed: int = ABSORBED) -> DataFrame:
    """Each language's ``first`` phrases (all for None) of two to five words by score, with their counts and a document that has them.

    A phrase's score is the least over its cuts in two of floor(1000 * f * n / (l * r)); of equal cuts the first counts. A phrase
    inside a longer one with ``absorbed`` percent of its occurrences is left out. Numbers are exact up to f * n of 10^35. Texts without words, null
    texts and empty tables give nothing; repeated rows count each.
    """
    known = settle(phrases(docs, least))
    words = known.where("size > 0").select("lang", "phrase", "f")
    long_ = known.where("size > 1").withColumn("words", F.split("phrase", " "))
    # the score of every cut
    cuts = long_.withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
    cuts = cuts.select(
        "lang", "phrase", F.col("f").alias("a"), "doc_id", "k", F.expr("array_join(slice(words, 1, k), ' ')").alias("one"),
        F.expr("array_join(slice(words, k + 1, size - k), ' ')").alias("two"),
    )
    cuts = cuts.join(words.select("lang", F.col("phrase").alias("one"), F.col("f").alias("l")), ["lang", "one"])
    cuts = cuts.join(words.select("lang", F.col("phrase").alias("two"), F.col("f").alias("r")), ["lang", "two"])
    # totals meet the phrases by language and part, so a language with most phrases is no single task's
    totals = known.where("size = 0").select("lang", F.col("f").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    cuts = cuts.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).cast("int")).join(totals, ["lang", "part"])
    wide = [f"cast({c} as decimal(19, 0))" for c in ("a", "n", "l", "r")]
    cuts = cuts.withColumn("score", F.expr("1000 * ({} * {}) div ({} * {})".format(*wide)).cast("long"))
    scored = cuts.groupBy("lang", "part", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n", "doc_id")).alias("best")).select("lang", "part", "phrase", "best.*")
    # what stands inside a longer one
    inner = long_.where("size > 2").withColumn("size_", F.explode(F.expr("sequence(2, size - 1)"))).withColumn("at", F.explode(F.expr("sequence(1, size - size_ + 1)")))
    inner = inner.groupBy("lang", F.expr("array_join(slice(words, at, size_), ' ')").alias("phrase")).agg(F.max("f").alias("around"))
    scored = scored.join(inner, ["lang", "phrase"], "left").where(F.col("around").isNull() | (F.lit(100) * F.col("around") < F.lit(absorbed) * F.col("a")))
    # the first of each part, then the first of those
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if first is not None:
        scored = scored.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= first)
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if first is not None:
        out = out.where(F.col("rank") <= first)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "doc_id")
