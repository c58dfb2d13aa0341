"""Exact substring deduplication across documents, on suffix arrays of the text around shared anchors.

Every string of ``LEAST`` bytes contains an anchor: the 18-byte string in it whose hash is least. Equal strings have the same anchor
at the same place, so all occurrences of a repeat meet where their anchor does:

1. Texts are packed into units of about 4 MB, written once to the shared folder; a unit is the address results come back to.
2. Hashes of each unit's anchors, each once, are dealt out by ranges of the hash, one range a task; those of several documents go back
   to their units. Digests of whole texts tell which documents are copies of a smaller one: those are covered wholly and take no further part.
3. Units send the bytes of the strings that chose a shared anchor (each distinct context once, with the smallest document that has
   it) to the anchor's bucket. Contexts that share enough on one side of the anchor with another get an enhanced suffix array, which is
   scanned with a stack for common-prefix intervals; those that differ in what stands ahead are the maximal repeats, with all their
   occurrences, and the smallest document owns each.
4. Units get the owners of their contexts, and bytes covered by a string that a smaller document owns are removed.

What a unit sends is one piece for each bucket, so pieces grow with the square of the input: units and buckets are large, and a piece
costs a few slices. An anchor that stands very often (``HOT_UNITS``) is not gathered in one bucket: there each string of ``LEAST``
bytes around it is a context of its own and goes by its own hash. Text crosses the network twice, packed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import partitions, settle, texts
from footfall.llm.kernels import BYTE_KEYS, U, give_back, mix, steps, text_bytes
from footfall.llm.suffixes import StartArray, maximal_intervals

LEAST = 50
GRAM = 18
REACH = LEAST - GRAM  # how far ahead of its anchor a string may start
HALF = REACH // 2  # two contexts with a string in common share so much at least on one side of their anchor
HOT_UNITS = 50_000  # that have an anchor; a unit where it stands 16, 64, 256, ... times counts as so many
UNIT_BYTES = 4_000_000
SLICE_BYTES = 40_000
BUCKET_BYTES = 16_000_000  # of text, whose anchors meet in one bucket on average
SYMBOLS = 200_000  # bytes that go into one array
SPANS = 8192  # that are looked at together
UNIT_LEVEL = 3  # of compression: units are on disk three times
LEVEL = 6  # of payloads that are squeezed alone
KEY_BITS = 48  # of an anchor's hash
LOW = U((1 << 36) - 1)  # those that are sent, as the bucket tells the others
NOBODY = np.iinfo(np.int64).max
UNIT = "unit long, blob binary, digests binary"
COPY = "high long, low long, doc long, unit long, place int"
PIECE = "bucket int, unit long, payload binary"
REPLY = "unit long, payload binary"
CONTEXT = (bool, np.uint8, np.uint8, np.int64, np.int64, np.int32, np.int32, np.uint8, np.int64)
OWNERS = (np.int32, np.uint8, bool, np.int32, np.int64, (np.int64, REACH + 1))
COLUMNS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
MULTIPLIER = 0x5851F42D4C957F2D
WIDE = -(-(LEAST + REACH) // 8) * 8  # bytes of the longest context, as whole words
INSIDE = np.arange(WIDE) < np.arange(LEAST + REACH + 1)[:, None]  # by length
MASKS = (INSIDE * np.uint8(255)).view(U)
SEEDS = mix(np.arange(1, WIDE // 8 + 1, dtype=U) * U(MULTIPLIER))


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays one behind the other, each with its length, first bytes of all numbers first, compressed."""
    raw = b"".join(a.nbytes.to_bytes(8, "little") + np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=LEVEL).compress(raw)


def loosen(payload: bytes, *kinds) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(payload), 0, []
    for kind in kinds:
        size = int.from_bytes(raw[at : at + 8], "little")
        planes = np.frombuffer(raw, np.uint8, count=size, offset=at + 8).reshape(np.dtype(kind).itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(-1))
        at += 8 + size
    return out


def pieces_of(*columns: tuple[np.ndarray, np.ndarray]) -> Iterator[bytes]:
    """For each piece its part of all columns, first bytes of all numbers first, compressed. A column: values, and where pieces begin in it."""
    compress = zstandard.ZstdCompressor(level=UNIT_LEVEL).compress
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize * (c.size // max(1, len(c)))).T) for c, _ in columns]
    cuts = np.stack([cut for _, cut in columns], 1)
    sizes = np.diff(cuts, axis=0).astype(np.int32)
    for n, first, last in zip(sizes, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield compress(b"".join([n.tobytes(), *(p[:, a:b].tobytes() for p, a, b in zip(planes, first, last, strict=True))]))


def columns_of(payloads: list[bytes], kinds: tuple) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns of all pieces, one behind the other, and how much of each a piece has."""
    expand = zstandard.ZstdDecompressor().decompress
    kinds = [k if isinstance(k, tuple) else (k, 1) for k in kinds]
    widths = [np.dtype(kind).itemsize * k for kind, k in kinds]
    parts, sizes = [[np.zeros((w, 0), np.uint8)] for w in widths], []
    for payload in payloads:
        raw, at = np.frombuffer(expand(payload), np.uint8), 4 * len(kinds)
        sizes.append(raw[:at].view(np.int32).tolist())
        for part, w, n in zip(parts, widths, sizes[-1], strict=True):
            part.append(raw[at : at + w * n].reshape(w, n))
            at += w * n
    values = [np.ascontiguousarray(np.concatenate(part, 1).T).view(kind) for part, (kind, _) in zip(parts, kinds, strict=True)]
    return [v if k > 1 else v[:, 0] for v, (_, k) in zip(values, kinds, strict=True)], np.array(sizes, np.int64).reshape(-1, len(kinds))


def put(numbers: np.ndarray, begin: np.ndarray) -> pa.Array:
    """Pieces of numbers below 2**40, five bytes each."""
    raw = np.ascontiguousarray(numbers.astype(U).view(np.uint8).reshape(-1, 8)[:, :5])
    return pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, pa.py_buffer((begin * 5).astype(np.int32)), pa.py_buffer(raw)])


def taken(payloads: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all pieces, and how many each has."""
    offsets = np.frombuffer(payloads.buffers()[1], np.int32)[payloads.offset : payloads.offset + len(payloads) + 1]
    out = np.zeros(((offsets[-1] - offsets[0]) // 5, 8), np.uint8)
    if len(out):
        out[:, :5] = np.frombuffer(payloads.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, 5)
    return out.view(U)[:, 0], np.diff(offsets) // 5


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``count`` numbers from each of ``first`` on."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by key, where each key's rows begin in it, and how many it has."""
    order = np.argsort(keys)
    ranked = keys[order]
    heads = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])[: len(keys)])
    return order, heads, np.diff(np.append(heads, len(keys)))


def pack_units(rows: DataFrame) -> DataFrame:
    """Runs of rows with all their columns, as compressed Arrow streams of about 4 MB of text, settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(steps(batches, size=UNIT_BYTES)):
            sink = pa.BufferOutputStream()
            codec = pa.Codec("zstd", compression_level=UNIT_LEVEL)
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=codec)) as out:
                out.write_batch(batch)
            blob = sink.getvalue().to_pybytes()
            data, offsets = text_bytes(batch.column(batch.schema.get_field_index("text")))
            cut = zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
            ids = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()).fill_null(NOBODY).to_pylist()
            digests = b"".join(hashlib.blake2b(data[a:b], digest_size=16).digest() + i.to_bytes(8, "little", signed=True) for (a, b), i in zip(cut, ids, strict=True))
            yield rows_of(UNIT, [(first + k, blob, digests)])
        give_back()

    return settle(rows.mapInArrow(run, UNIT))


class Unit:
    """The texts of a unit, with their ids (no id: above all others) and where their anchors stand."""

    def __init__(self, blob: bytes):
        self.batch = pa.ipc.open_stream(pa.BufferReader(blob)).read_all().combine_chunks().to_batches()[0]
        self.data, self.offsets = text_bytes(self.batch.column(self.batch.schema.get_field_index("text")))
        ids = self.batch.column(self.batch.schema.get_field_index("doc_id")).cast(pa.int64())
        self.ids = ids.fill_null(NOBODY).to_numpy(zero_copy_only=False)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions and hashes of the anchors of all strings of ``LEAST`` bytes, and the first and last start of their strings."""
        found, a = [], 0
        last = len(self.offsets) - 1
        while a < last:
            b = max(a + 1, int(np.searchsorted(self.offsets, self.offsets[a] + SLICE_BYTES, "right")) - 1)
            at, key, first, last_start = anchors_of(self.data[self.offsets[a] : self.offsets[b]], self.offsets[a : b + 1] - self.offsets[a])
            found.append((at + self.offsets[a], key, first + self.offsets[a], last_start + self.offsets[a]))
            a = b
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (none, none.astype(U), none, none)

    def texts_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, "right") - 1

    def contexts(self, shared: np.ndarray, copies: np.ndarray) -> Contexts:
        """Contexts of the anchors that are in ``shared`` (sorted, lowest bit: hot), but for texts that are copies."""
        at, key, first, last = self.anchors()
        key = short(key)
        names, wanted = shared >> U(4), key & LOW
        hit = np.minimum(np.searchsorted(names, wanted), max(len(names) - 1, 0))
        own = np.ones(len(self.ids), bool)
        own[copies] = False
        take = np.flatnonzero((names[hit] == wanted) & own[self.texts_of(at)]) if len(names) else np.zeros(0, np.int64)
        hot = (shared[hit[take]] & U(1)) == 1 if len(names) else np.zeros(0, bool)
        at, first, last = at[take], first[take], last[take]
        # of a hot anchor each string of LEAST bytes stands alone
        size = np.where(hot, last - first + 1, 1)
        start = ranges(first, size)
        end = np.where(np.repeat(hot, size), start, np.repeat(last, size)) + LEAST
        return Contexts(self, start, end - start, np.repeat(at, size) - start, np.repeat(hot, size), np.repeat(key[take], size))


class Contexts:
    """The bytes of the strings that chose an anchor: where they start, how many, and how far in the anchor stands."""

    def __init__(self, unit: Unit, start, size, left, hot, key):
        self.start, self.size, self.left, self.hot, self.key = start, size, left, hot, key
        self.text, self.data = unit.texts_of(start), padded(unit.data)
        self.mark = marks_of(self.data, start, size, left)


def padded(data: np.ndarray) -> np.ndarray:
    """With room for a span at any place."""
    return np.concatenate([data, np.zeros(WIDE, np.uint8)])


def words_of(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The bytes of each span as a row of words, zeros behind them, some spans at a time: the first one, their words and lengths."""
    rows = np.lib.stride_tricks.sliding_window_view(data, WIDE)
    for a in range(0, len(start), SPANS):
        n = size[a : a + SPANS]
        yield a, rows[start[a : a + SPANS]].view(U) & MASKS[n], n


def marks_of(data: np.ndarray, start: np.ndarray, size: np.ndarray, left: np.ndarray | int = 0) -> np.ndarray:
    """A hash of each span of padded bytes, and of where in it the anchor stands."""
    out = np.empty(len(start), U)
    for a, words, n in words_of(data, start, size):
        out[a : a + len(n)] = mix(words + SEEDS).sum(1, dtype=U) + n.astype(U)
    return mix(out + mix(np.asarray(left).astype(U)))


def bytes_of(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of spans, one behind the other."""
    parts = [words.view(np.uint8)[INSIDE[n]] for _, words, n in words_of(data, start, size)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8)


def short(key: np.ndarray) -> np.ndarray:
    """The bits of a hash that buckets are ranges of."""
    return key >> U(64 - KEY_BITS)


def anchors_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LEAST:
        return none, none.astype(U), none, none
    # hashes of strings of 2, 4, 8, 16 bytes, then of GRAM = 16 + 2
    grown, width, power, kept = BYTE_KEYS[data], 1, MULTIPLIER, {}
    while width * 2 <= GRAM:
        longer = grown[:-width] * U(power)
        longer += grown[width:]
        power, width, grown = power * power % 2**64, width * 2, longer
        kept[width] = grown
    rest = GRAM - width
    m = n - GRAM + 1
    key = grown[:m] * U(pow(MULTIPLIER, rest, 2**64))
    key += kept[rest][width : width + m]
    # least hash among the REACH + 1 strings of each window; of equal ones the last
    low = key & ~U(0xFFFFFFFF)
    low |= U(0xFFFFFFFF) - np.arange(m, dtype=U)
    span = 1
    while span * 2 <= REACH + 1:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < REACH + 1:
        rest = REACH + 1 - span
        low = np.minimum(low[:-rest], low[rest:])
    chosen = low.astype(np.uint32)
    # without the strings that would run over the end of a text
    over = (offsets[1:-1, None] - np.arange(1, LEAST)).reshape(-1)
    chosen[over[(over >= 0) & (over < len(chosen))]] = 0
    change = chosen[1:] != chosen[:-1]
    there = chosen > 0
    first, last = np.flatnonzero(there & np.append(True, change)), np.flatnonzero(there & np.append(change, True))
    at = 0xFFFFFFFF - chosen[first].astype(np.int64)
    return at, mix(key[at]), first, last


def limits(buckets: int) -> np.ndarray:
    """Where in the range of short hashes each bucket begins."""
    return np.array([k * 2**KEY_BITS // buckets for k in range(buckets + 1)], U)


def rows_of(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def send_anchors(units: DataFrame, buckets: int) -> DataFrame:
    """For each unit and bucket the unit's anchor hashes, sorted: their lower bits, three for how often it stands there and one set if
    several of its documents have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = limits(buckets)
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                unit = Unit(blob.as_buffer())
                at, key, _, _ = unit.anchors()
                key, text = short(key), unit.texts_of(at)
                order, heads, count = groups(key)
                if not len(heads):
                    continue
                key, text = key[order[heads]], text[order]
                several = np.minimum.reduceat(text, heads) != np.maximum.reduceat(text, heads)
                often = np.clip(np.log2(count).astype(np.int64) // 2 - 1, 0, 7)
                begin = np.searchsorted(key, edges)
                some = np.flatnonzero(np.diff(begin))
                payloads = put((key & LOW) << U(4) | often.astype(U) << U(1) | several.astype(U), begin[np.append(some, buckets)])
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), name)), payloads], ["bucket", "unit", "payload"])
            give_back()

    return units.select("unit", "blob").mapInArrow(run, PIECE)


def find_copies(units: DataFrame) -> DataFrame:
    """For each unit the places of its texts that a document with a smaller id has too, as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, digests in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = np.frombuffer(digests, np.int64).reshape(-1, 3)
                columns = [*(pa.array(c) for c in rows.T.copy()), pa.array(np.full(len(rows), name)), pa.array(np.arange(len(rows), dtype=np.int32))]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in COPY.split(", ")])

    texts_ = units.select("unit", "digests").mapInArrow(run, COPY)
    # settled, so that both sides of the join are plain shuffles, of which AQE splits a partition with a huge group of copies
    least = settle(texts_.groupBy("high", "low").agg(F.min("doc").alias("least"), F.count("*").alias("n")).where("n > 1"))
    copies = texts_.join(least, ["high", "low"]).where("doc > least")
    return settle(copies.groupBy("unit").agg(F.collect_list("place").alias("copies")))


def per_bucket(pieces: DataFrame, buckets: int, answer: Callable[[pa.Array, pa.Array], pa.RecordBatch]) -> DataFrame:
    """Deal the pieces out, a task for each bucket, and answer its pieces together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if rows:
            yield answer(*(pa.concat_arrays([b.column(k) for b in rows]) for k in (1, 2)))
        give_back()

    return pieces.repartitionById(buckets, F.col("bucket")).mapInArrow(run, REPLY)


def find_shared(names: pa.Array, payloads: pa.Array) -> pa.RecordBatch:
    """Tell each unit which of its anchors other documents have too; the lowest bit marks hot ones."""
    numbers, size = taken(payloads)
    order, heads, count = groups(numbers >> U(4))
    codes = (numbers & U(15)).astype(np.int64)[order]
    often = codes >> 1
    weight = np.add.reduceat(np.where(often > 0, 4 << 2 * often, 1), heads)
    shared = (count > 1) | (np.maximum.reduceat(codes & 1, heads) > 0)
    keep, hot = np.empty(len(order), bool), np.empty(len(order), U)
    keep[order], hot[order] = np.repeat(shared, count), np.repeat(weight > HOT_UNITS, count)
    begin = np.append(0, np.cumsum(keep))[np.append(0, np.cumsum(size))]
    some = np.flatnonzero(np.diff(begin))
    kept = put((numbers[keep] >> U(4) << U(4)) | hot[keep], begin[np.append(some, len(size))])
    return pa.RecordBatch.from_arrays([names.take(pa.array(some)), kept], ["unit", "payload"])


def send_contexts(units: DataFrame, replies: DataFrame, copies: DataFrame, buckets: int) -> DataFrame:
    """For each unit and bucket the distinct contexts: whether hot, place of the anchor, length, smallest and largest document, how
    often, where each time, and bytes.

    What the bucket can work out from the bytes isn't sent; documents count from the unit's smallest, the last column.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = limits(buckets)
        for batch in batches:
            columns = (batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3).to_pylist())
            for name, blob, payloads, places in zip(*columns, strict=True):
                unit = Unit(blob.as_buffer())
                found = unit.contexts(np.sort(taken(payloads.values)[0]), np.array(places or [], np.int64))
                if not len(found.start):
                    continue
                by_mark, heads, times = groups(found.mark)
                # the places of a context in ascending order
                by_mark = by_mark[np.lexsort((found.start[by_mark], np.repeat(np.arange(len(heads)), times)))]
                first, doc = by_mark[heads], unit.ids[found.text[by_mark]]
                least, most = np.minimum.reduceat(doc, heads), np.maximum.reduceat(doc, heads)
                # contexts of a plain anchor meet at the anchor, single strings of a hot one at their own hash
                place = np.where(found.hot[first], short(mix(found.mark[first])), found.key[first])
                bucket = np.searchsorted(edges, place, "right") - 1
                order = np.lexsort((found.start[first], bucket))
                first, least, most, times, heads, bucket = (c[order] for c in (first, least, most, times, heads, bucket))
                some, begin = np.unique(bucket, return_index=True)
                cut = np.append(begin, len(first))
                small = (found.hot[first], found.left[first].astype(np.uint8), found.size[first].astype(np.uint8))
                spots, after = found.start[by_mark[ranges(heads, times)]], np.append(0, np.cumsum(times))
                gaps = np.diff(spots, prepend=0)
                gaps[after[begin]] = spots[after[begin]]
                base = unit.ids.min(initial=NOBODY)
                by_context = (*small, least - base, most - least, times.astype(np.int32))
                parts = pieces_of(
                    *((c, cut) for c in by_context), (gaps.astype(np.int32), after[cut]), (bytes_of(found.data, found.start[first], found.size[first]), np.append(0, np.cumsum(found.size[first]))[cut]),
                    (np.full(len(some), base), np.arange(len(some) + 1)),
                )
                yield rows_of(PIECE, [(b, name, part) for b, part in zip(some.tolist(), parts, strict=True)])
            give_back()

    gathered = replies.groupBy("unit").agg(F.collect_list("payload").alias("payloads"))
    joined = units.join(gathered, "unit").join(copies, "unit", "left")
    return joined.select("unit", "blob", "payloads", "copies").mapInArrow(run, PIECE)


def own_windows(data: np.ndarray, size: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For contexts laid one behind the other, the smallest document that has the ``LEAST`` bytes starting at each byte.

    The contexts' suffixes of ``LEAST`` bytes and more get an enhanced suffix array; its maximal repeats give all occurrences of what
    they cover to the smallest document among them.
    """
    first = np.cumsum(size) - size
    number = np.repeat(np.arange(len(size)), size)
    starts = ranges(first, size - LEAST + 1)
    lengths = (first + size)[number[starts]] - starts
    words = [w for _, w, _ in words_of(padded(data), starts, lengths)]
    array = StartArray(starts, np.concatenate(words).byteswap(), lengths, LEAST)
    # what stands ahead; ends differ from all
    before = np.append(0, data[:-1].astype(np.int64))
    before[first] = 256 + np.arange(len(size))
    owner = least[number]
    groups = maximal_intervals(array, before)
    if len(groups):
        wide, begin, count = groups[:, 0] - LEAST + 1, groups[:, 1], groups[:, 2] - groups[:, 1] + 1
        found = array.order[ranges(begin, count)]
        lowest = np.minimum.reduceat(least[number[found]], np.cumsum(count) - count)
        # every string of LEAST bytes inside an occurrence
        wide, lowest = np.repeat(wide, count), np.repeat(lowest, count)
        np.minimum.at(owner, ranges(found, wide), np.repeat(lowest, wide))
    return owner


def with_partner(data: np.ndarray, anchor: np.ndarray, left: np.ndarray, size: np.ndarray) -> np.ndarray:
    """True for contexts that share the anchor and ``HALF`` bytes on one side of it with another, as any do that share a string."""
    found = np.zeros(len(anchor), bool)
    for enough, shift in ((left >= HALF, HALF), (size - left - GRAM >= HALF, 0)):
        some = np.flatnonzero(enough)
        order, _, count = groups(marks_of(data, anchor[some] - shift, np.full(len(some), GRAM + HALF)))
        found[some[order]] |= np.repeat(count > 1, count)
    return found


def owners_by_hash(data: np.ndarray, begin: np.ndarray, left: np.ndarray, size: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For contexts of one anchor that are too many for an array, the owner of each string, by the strings' hashes."""
    owners = np.full((len(begin), REACH + 1), NOBODY)
    for ahead in range(REACH + 1):
        some = np.flatnonzero((left >= ahead) & (size - left + ahead >= LEAST))
        order, heads, count = groups(marks_of(data, begin[some] + left[some] - ahead, np.full(len(some), LEAST)))
        if len(heads):
            some = some[order]
            owners[some, left[some] - ahead] = np.repeat(np.minimum.reduceat(least[some], heads), count)
    return owners


def find_owners(names: pa.Array, payloads: pa.Array) -> pa.RecordBatch:
    """Tell each unit, for contexts in which a smaller document owns something, who owns the string at each place.

    A context that shares no string with others of its anchor needs no array, in however many documents: its smallest one owns all.
    """
    (hot, left, size, least, most, times, gaps, data, base), counts = columns_of(payloads.to_pylist(), CONTEXT)
    count, spots = counts[:, 0], counts[:, 6]
    least = least + np.repeat(base, count)
    most = most + least
    starts = np.cumsum(gaps.astype(np.int64))
    starts -= np.repeat(np.append(0, starts)[np.cumsum(spots) - spots], spots)
    size, left = size.astype(np.int64), left.astype(np.int64)
    begin, data = np.cumsum(size) - size, padded(data)
    order, heads, same = groups(marks_of(data, begin, size, left))
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.repeat(np.arange(len(heads)), same)
    index, lowest = order[heads], np.minimum.reduceat(least[order], heads)
    # distinct contexts by anchor: those of one anchor go into one array, with others as long as there is room
    plain = np.flatnonzero(~hot[index])
    one = index[plain]
    anchor = begin[one] + left[one]
    chosen = np.flatnonzero(with_partner(data, anchor, left[one], size[one]))
    by_key, heads, same = groups(marks_of(data, anchor[chosen], np.full(len(chosen), GRAM)))
    mixed = plain[chosen[by_key]]
    row = np.full(len(index), -1)
    row[mixed] = np.arange(len(mixed))
    owners = np.full((len(mixed), REACH + 1), NOBODY)
    total = np.cumsum(size[index[mixed]])
    last = heads + same  # where arrays may end
    a = 0
    while a < len(mixed):
        done = total[a - 1] if a else 0
        fit = np.searchsorted(total[last - 1], done + SYMBOLS, "right")
        b = int(last[max(np.searchsorted(last, a, "right"), fit - 1)])
        chosen = index[mixed[a:b]]
        n = size[chosen]
        if total[b - 1] - done > SYMBOLS:
            owners[a:b] = owners_by_hash(data, begin[chosen], left[chosen], n, lowest[mixed[a:b]])
        else:
            ahead = np.cumsum(n) - n
            owner = own_windows(bytes_of(data, begin[chosen], n), n, lowest[mixed[a:b]])
            for k in range(REACH + 1):
                fit = np.flatnonzero(k + LEAST <= n)
                owners[a + fit, k] = owner[ahead[fit] + k]
        a = b
    first_owner = lowest.copy()
    first_owner[mixed] = owners.min(1, initial=NOBODY)
    take = np.flatnonzero(first_owner[inverse] < most)
    cut = np.searchsorted(take, np.append(0, np.cumsum(count)))
    some = np.flatnonzero(np.diff(cut))
    cut = cut[np.append(some, len(count))]
    which, n = inverse[take], times[take]
    alone = row[which] < 0
    at = starts[ranges((np.cumsum(times) - times)[take], n)].astype(np.int32)
    before, spent = np.append(0, np.cumsum(alone))[cut], np.append(0, np.cumsum(n))[cut]
    parts = pieces_of(
        (n, cut), (size[take].astype(np.uint8), cut), (alone, cut), (at, spent), (lowest[which[alone]], before), (owners[row[which[~alone]]], cut - before),
    )
    return pa.RecordBatch.from_arrays([names.take(pa.array(some)), pa.array(list(parts), pa.binary())], ["unit", "payload"])


def covered(unit: Unit, payloads: list[bytes], copies: list[int]) -> np.ndarray:
    """True for every byte of the unit's texts inside a string that a smaller document owns."""
    edge = np.zeros(len(unit.data) + 1, np.int32)

    def cover(start: np.ndarray, length: np.ndarray | int) -> None:
        np.add.at(edge, start, 1)
        np.subtract.at(edge, start + length, 1)

    whole = np.array(copies, np.int64)
    whole = whole[np.diff(unit.offsets)[whole] >= LEAST]
    cover(unit.offsets[whole], np.diff(unit.offsets)[whole])
    (times, size, alone, at, owner, owners), _ = columns_of(payloads, OWNERS)
    at, doc = at.astype(np.int64), unit.ids[unit.texts_of(at)]
    context = np.repeat(np.arange(len(times)), times)
    # one owner: the whole context
    one = np.flatnonzero(alone[context])
    mine = one[owner[(np.cumsum(alone) - 1)[context[one]]] < doc[one]]
    cover(at[mine], size[context[mine]].astype(np.int64))
    # an owner for each string
    own, row = np.flatnonzero(~alone[context]), np.cumsum(~alone) - 1
    for a in range(0, len(own), SPANS):
        some = own[a : a + SPANS]
        which, step = np.nonzero(owners[row[context[some]]] < doc[some][:, None])
        cover(at[some[which]] + step, LEAST)
    return np.cumsum(edge, out=edge)[:-1] > 0


def _owned(rows: DataFrame, answer: Callable, schema) -> DataFrame:
    """Run the four steps and answer every unit with the bytes to remove."""
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(partitions(rows.sparkSession), -(-size // BUCKET_BYTES))
    units = pack_units(rows)
    copies = find_copies(units)
    shared = per_bucket(send_anchors(units, buckets), buckets, find_shared)
    owners = per_bucket(send_contexts(units, shared, copies, buckets), buckets, find_owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, payloads, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                unit = Unit(blob)
                yield answer(unit, covered(unit, payloads or [], places or []))
            give_back()

    gathered = owners.groupBy("unit").agg(F.collect_list("payload").alias("payloads"))
    joined = units.join(gathered, "unit", "left").join(copies, "unit", "left")
    return joined.select("blob", "payloads", "copies").mapInArrow(run, schema)


def dedup(docs: DataFrame) -> DataFrame:
    """What is left of every text: bytes, removed bytes, removed runs, and the SHA-256 of the remaining bytes.

    A byte goes if a string of 50 bytes that covers it also starts in a document with a smaller id. Null counts as empty; texts
    below 50 bytes lose nothing. Rows with the same id don't count as smaller than each other; rows without id come after all
    others, and lose nothing to each other.
    """

    def answer(unit: Unit, gone: np.ndarray) -> pa.RecordBatch:
        runs = np.zeros(len(gone) + 1, bool)
        runs[:-1] = gone
        rows = []
        for doc, a, b in zip(unit.batch.column(0).to_pylist(), unit.offsets[:-1].tolist(), unit.offsets[1:].tolist(), strict=True):
            out = gone[a:b]
            spans = int(out[:1].sum() + (out[1:] & ~out[:-1]).sum())
            rows.append((doc, b - a, int(out.sum()), spans, hashlib.sha256(unit.data[a:b][~out].tobytes()).hexdigest()))
        return rows_of(COLUMNS, rows)

    return _owned(texts(docs), answer, COLUMNS)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, their texts without the repeated bytes. A text stays null where it was; a
    character of which only some bytes went goes too. ``n_chars``, where there is one, is counted anew."""
    place = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def answer(unit: Unit, gone: np.ndarray) -> pa.RecordBatch:
        was = unit.batch.column(place).is_valid().to_pylist()
        left = [
            unit.data[a:b][~gone[a:b]].tobytes().decode(errors="ignore") if v else None
            for v, a, b in zip(was, unit.offsets[:-1].tolist(), unit.offsets[1:].tolist(), strict=True)
        ]
        columns = list(unit.batch.columns)
        columns[place] = pa.array(left, columns[place].type)
        if chars is not None:
            columns[chars] = pa.array([None if t is None else len(t) for t in left], columns[chars].type)
        return pa.RecordBatch.from_arrays(columns, unit.batch.schema.names)

    return _owned(docs, answer, docs.schema)
