"""Document fingerprints from content-defined chunks.

A gear hash of the last ``WINDOW`` bytes decides where chunks end, so an insertion moves no boundary but those next to it. Two
masks even out the sizes: a strict one up to the normal size, a loose one beyond it. A fingerprint is the list of chunk digests
with their lengths; two texts are as alike as the length of the digests they share, measured against the shorter of both sets.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import partitions, texts
from footfall.llm.kernels import BYTE_KEYS, U, mix, span_hashes, steps, text_bytes

WINDOW = 16
LEAST, NORMAL, MOST = 16, 32, 128
STRICT, LOOSE = np.uint32(0b111111 << 26), np.uint32(0b1111 << 28)
GEAR = (BYTE_KEYS >> U(32)).astype(np.uint32)
DIGEST_BYTES = 5
COLUMNS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
    "n_chunks long"
)


def ends_allowed(data: np.ndarray) -> tuple[list[int], list[int]]:
    """Where a chunk may end by the strict and by the loose mask. Windows may reach into the text before, but no chunk is shorter."""
    h = GEAR[data]
    width = 1
    while width < WINDOW:
        older = np.zeros_like(h)
        older[width:] = h[:-width]
        h = h + (older << np.uint32(width))
        width *= 2
    # the highest bits have seen the whole window
    h = h << np.uint32(32 - WINDOW - 8) if WINDOW + 8 < 32 else h
    return (np.flatnonzero((h & STRICT) == 0) + 1).tolist(), (np.flatnonzero((h & LOOSE) == 0) + 1).tolist()


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """For each text the places, counted from its start, where its chunks end."""
    strict, loose = ends_allowed(data)
    strict.append(len(data) + MOST + 1)
    loose.append(len(data) + MOST + 1)
    out, i, j = [], 0, 0
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        s, ends = a, []
        while s < b:
            i = bisect_left(strict, s + LEAST, i)
            e = strict[i]
            if e >= s + NORMAL:
                j = bisect_left(loose, s + NORMAL, j)
                e = min(loose[j], s + MOST)
            s = min(e, b)
            ends.append(s - a)
        out.append(ends)
    return out


class Chunks:
    """Digests and lengths of the chunks of many texts, in order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ends: list[list[int]]):
        self.count = np.array([len(e) for e in ends], np.int64)
        flat = np.array([x for e in ends for x in e], np.int64)
        self.text = np.repeat(np.arange(len(ends)), self.count)
        end = flat + offsets[:-1][self.text]
        start = np.empty_like(end)
        start[1:] = end[:-1]
        first = np.cumsum(self.count) - self.count
        filled = self.count > 0
        start[first[filled]] = offsets[:-1][filled]
        self.length = end - start
        self.digest = span_hashes(data, start, end) >> U(64 - 8 * DIGEST_BYTES)

    def strings(self) -> list[str]:
        """The fingerprints: for each chunk five bytes of digest and one of length, in base64; empty for an empty text."""
        packed = (self.digest << U(8)) | self.length.astype(U)
        raw = packed.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - DIGEST_BYTES - 1 :].tobytes()
        at = np.concatenate([[0], np.cumsum(self.count)]) * (DIGEST_BYTES + 1)
        return [base64.b64encode(raw[a:b]).decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def sets(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's distinct digests: text, digest, length."""
        keep = np.unique(mix(self.digest + mix(self.text.astype(U))), return_index=True)[1]
        return self.text[keep], self.digest[keep], self.length[keep]


def likeness(a: Chunks, b: Chunks, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For pairs of texts (left[i] of a, right[i] of b): the length of shared digests over that of the shorter set. Two empty texts
    are alike, an empty and another one are not."""
    n = len(left)

    def of(chunks: Chunks, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        text, digest, length = chunks.sets()
        order = np.argsort(text, kind="stable")
        text, digest, length = text[order], digest[order], length[order]
        first, last = np.searchsorted(text, chosen), np.searchsorted(text, chosen, "right")
        size = last - first
        pair = np.repeat(np.arange(n), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
        return pair, mix(digest[at] + mix(pair.astype(U))), length[at], np.bincount(pair, length[at], minlength=n)

    pair, key, length, total_a = of(a, left)
    _, other, _, total_b = of(b, right)
    shared = np.bincount(pair[both := np.isin(key, other)], length[both], minlength=n)
    least = np.minimum(total_a, total_b)
    return np.where(least > 0, np.minimum(shared / np.maximum(least, 1), 1.0), (total_a == total_b).astype(float))


def measure(rows: list[tuple[int | None, str]], follow: list[str]) -> list:
    """Columns of the result for texts and the texts that follow them."""
    values = [t for _, t in rows]
    own = text_bytes(pa.array([*values, *follow[-1:]], pa.string()))
    ends = chunk_ends(*own)
    chunks = Chunks(*own, ends)
    cut = [len(t) - len(t) // 4 for t in values]
    edited = [t[:k] + f[: len(t) - k] for t, k, f in zip(values, cut, follow, strict=True)]
    # chunks that end ahead of the edit stay; only what follows them is cut anew
    kept, tails = [], []
    for t, k, e, at in zip(values, cut, edited, ends[: len(values)], strict=True):
        raw = e.encode()
        same = len(t[:k].encode())
        kept.append(at[: bisect_left(at, same + 1)])
        tails.append((raw, kept[-1][-1] if kept[-1] else 0))
    tail = pa.array([raw[a:] for raw, a in tails], pa.binary())
    more = chunk_ends(*text_bytes_raw(tail))
    new_ends = [k + [a + x for x in m] for k, (_, a), m in zip(kept, tails, more, strict=True)]
    changed = Chunks(*text_bytes_raw(pa.array([raw for raw, _ in tails], pa.binary())), new_ends)
    n = np.arange(len(values))
    prints = chunks.strings()
    return [
        pa.array([i for i, _ in rows], pa.int64()), pa.array([len(t) for t in values], pa.int64()),
        pa.array([hashlib.sha256(raw).hexdigest() for raw, _ in tails]), pa.array(prints[: len(values)]), pa.array(changed.strings()),
        pa.array(likeness(chunks, changed, n, n)), pa.array(likeness(chunks, chunks, n, n + 1)), pa.array(chunks.count[: len(values)]),
    ]


def text_bytes_raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in column.to_pylist()], np.int64)
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    return data, np.concatenate([[0], np.cumsum(size)])


def neighbours(docs: DataFrame) -> DataFrame:
    """Texts dealt out by ranges of ids, each range with the first text of the next one behind it (``lent``).

    Only the first id of each range, one number for each, comes to the driver; the texts are shuffled once.
    """
    rows = texts(docs)
    parts = 4 * partitions(docs.sparkSession)
    ranges = rows.select("doc_id").where("doc_id is not null").repartitionByRange(parts, "doc_id")
    heads = ranges.groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("head")).orderBy("head").collect()
    first = np.array([r["head"] for r in heads], np.int64)

    @F.pandas_udf("int")
    def part_of(ids):
        known = ids.notna().to_numpy()
        out = np.full(len(ids), max(len(first) - 1, 0), np.int32)
        out[known] = np.searchsorted(first, ids[known].astype("int64"), "right") - 1
        return type(ids)(out)

    heads = rows.sparkSession.createDataFrame([(int(x),) for x in first], "head long")
    rows = rows.withColumn("part", part_of("doc_id")).join(F.broadcast(heads), F.col("doc_id") == F.col("head"), "left")
    # the ranges without ids: the null ids come last of all, and are lent nothing but the first text
    before = F.pmod(F.col("part") - 1, F.lit(max(len(first), 1)))
    places = F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("lent")), F.struct(before.alias("part"), F.lit(1).alias("lent")))
    lends = F.col("head").isNotNull() | F.lit(not len(first))
    dealt = rows.withColumn("to", F.explode(F.when(lends, places).otherwise(F.slice(places, 1, 1)))).select("doc_id", "text", "to.part", "to.lent")
    return dealt.repartition(partitions(docs.sparkSession), "part").sortWithinPartitions("part", "lent", F.asc_nulls_last("doc_id"), F.xxhash64("text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter is the start of the next text by id.

    Rows with the same id follow each other by a hash of the text, rows without id come last; the text after the last one is the
    first. A null or empty text has an empty fingerprint.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple | None = None
        for batch in steps(batches):
            rows, follow = [], []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if waiting and not waiting[3] and waiting[2] == row[2]:
                    rows.append(waiting[:2])
                    follow.append(row[1])
                waiting = row
            # texts that follow must stand behind their own in one list: true here, but for the last of a range
            for a, b in pieces(rows, follow):
                yield pa.RecordBatch.from_arrays(measure(rows[a:b], follow[a:b]), [c.split()[0] for c in COLUMNS.split(", ")])

    return neighbours(docs).mapInArrow(run, COLUMNS)


def pieces(rows: list[tuple], follow: list[str]) -> Iterator[tuple[int, int]]:
    """Runs in which each text is followed by the next one of the run."""
    a = 0
    for k in range(1, len(rows) + 1):
        if k == len(rows) or follow[k - 1] is not rows[k][1]:
            yield a, k
            a = k
