"""Repeated passages: the exchange between units and buckets, run in this process, so that its limits can be set."""

import random
import time
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from test_exact import removed

from footfall.llm import suffix_dedup
from footfall.llm.suffixes import StartArray

BUCKETS = 7


class Rows:
    """Record batches that stand for a DataFrame."""

    def __init__(self, batches):
        self.batches = [b for b in batches if b.num_rows]

    def select(self, *names):
        return Rows(b.select(list(names)) for b in self.batches)

    def mapInArrow(self, run, schema):  # noqa: N802
        return Rows(run(iter(self.batches)))

    def rows(self):
        return [row for b in self.batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]


def answers(pieces, answer):
    """What each unit hears from all buckets."""
    out = {}
    for bucket in range(BUCKETS):
        mine = [(unit, payload) for b, unit, payload in pieces if b == bucket]
        if mine:
            reply = answer(pa.array([u for u, _ in mine]), pa.array([p for _, p in mine], pa.binary()))
            for unit, payload in Rows([reply]).rows():
                out.setdefault(unit, []).append(payload)
    return out


def exchanged(texts, monkeypatch):
    """Covered bytes by document, each document being a unit, and the pieces sent."""
    monkeypatch.setattr(suffix_dedup, "settle", lambda df: df)
    monkeypatch.setattr(suffix_dedup, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(suffix_dedup, "UNIT_BYTES", 1)
    ids, raw = zip(*texts, strict=True)
    units = suffix_dedup.pack_units(Rows([pa.RecordBatch.from_arrays([pa.array(ids), pa.array(raw)], ["doc_id", "text"])]))
    blobs = {unit: blob for unit, blob, _ in units.rows()}
    anchors = suffix_dedup.send_anchors(units, BUCKETS).rows()
    shared = answers(anchors, suffix_dedup.find_shared)

    class Joined:
        def __getattr__(self, name):
            return lambda *args: self

        def mapInArrow(self, run, schema):  # noqa: N802
            arrays = [list(shared), [blobs[u] for u in shared], list(shared.values()), [None] * len(shared)]
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32())]
            return Rows(run(iter([pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(arrays, kinds, strict=True)], list("abcd"))])))

    monkeypatch.setattr(suffix_dedup, "F", SimpleNamespace(collect_list=lambda c: Joined()))
    contexts = suffix_dedup.send_contexts(Joined(), Joined(), Joined(), BUCKETS).rows()
    owners = answers(contexts, suffix_dedup.find_owners)
    gone = {}
    for unit, blob in blobs.items():
        one = suffix_dedup.Unit(blob)
        gone[int(one.ids[0])] = suffix_dedup.covered(one, owners.get(unit, []), [])
    return gone, anchors, contexts


def patched(n, seed, passages=6):
    """Texts of few words and of common passages, some cut or with a letter changed."""
    rng = random.Random(seed)
    common = ["".join(rng.choices("abcdé \n", k=rng.randrange(40, 200))) for _ in range(passages)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            part = list(rng.choice(common))
            if rng.random() < 0.5:
                part[rng.randrange(len(part))] = rng.choice("abxy")
            parts += ["".join(part)[rng.randrange(20) :], "".join(rng.choices("ab ", k=rng.randrange(0, 80)))]
        out.append((i, "".join(parts)))
    return out


@pytest.mark.parametrize(("hot", "symbols"), [(50_000, 200_000), (50_000, 500), (3, 200_000), (0, 200_000)])
def test_repeats_however_they_are_dealt(monkeypatch, hot, symbols):
    """Arrays, strings by their hash where an anchor has too many contexts for one, and hot anchors give the same."""
    monkeypatch.setattr(suffix_dedup, "HOT_UNITS", hot)
    monkeypatch.setattr(suffix_dedup, "SYMBOLS", symbols)
    texts = patched(150, 5)
    gone, _, _ = exchanged(texts, monkeypatch)
    for i, _, expected in removed(texts):
        assert (gone[i] == expected).all()


def test_a_passage_of_many_units_stays_whole(monkeypatch):
    """A passage that 400 units have is sent as a few contexts of its anchors, not as one for each string of 50 bytes."""
    rng = random.Random(1)
    passage = "".join(rng.choices("abcdefgh ", k=2000))
    texts = [(i, "".join(rng.choices("ijklmnop ", k=100)) + passage) for i in range(400)]
    _, _, contexts = exchanged(texts, monkeypatch)
    values, _ = suffix_dedup.columns_of([p for _, _, p in contexts], suffix_dedup.CONTEXT)
    assert len(values[0]) < 400 * 2000 / 8


def test_pieces_are_cheap():
    """Their number grows with the square of the input."""
    rng, n = np.random.default_rng(3), 20_000
    cut = np.arange(n + 1) * 5
    columns = [(rng.integers(0, 100, 5 * n).astype(k), cut) for k in (np.uint8, np.int64, np.int32, np.int64)]
    start = time.process_time()
    values, counts = suffix_dedup.columns_of(list(suffix_dedup.pieces_of(*columns)), tuple(c.dtype for c, _ in columns))
    assert time.process_time() - start < 3
    assert (counts == 5).all() and all((v == c).all() for v, (c, _) in zip(values, columns, strict=True))
    keys = rng.integers(0, 2**40, 5 * n).astype(np.uint64)
    found, size = suffix_dedup.taken(suffix_dedup.put(keys, cut))
    assert (found == keys).all() and (size == 5).all()


def test_arrays_of_starts_are_sorted():
    rng = np.random.default_rng(4)
    data = rng.choice(np.array([0, 7, 255], np.uint8), 4000)
    data[2000:2600] = data[100:700]
    starts = rng.permutation(3900)
    lengths = rng.integers(50, 83, len(starts))
    words = np.concatenate([w for _, w, _ in suffix_dedup.words_of(suffix_dedup.padded(data), starts, lengths)])
    array = StartArray(starts, words.byteswap(), lengths, 50)
    size = dict(zip(starts.tolist(), lengths.tolist(), strict=True))
    found = [data[a : a + size[a]].tobytes() for a in array.order.tolist()]
    assert [f[:50] for f in found] == sorted(f[:50] for f in found)
    for a, b, n in zip(found[:-1], found[1:], array.shared[1:].tolist(), strict=True):
        same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert n == (same if same >= 50 else 0)
    every = [data[a : a + 50].tobytes() for a in starts.tolist()]
    assert {w for w in every if every.count(w) > 1} <= {f[:50] for f in found}
