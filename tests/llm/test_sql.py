"""Operators 11 to 13 against SQL, on given tables and on odd rows, and their parts against brute force."""

import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from checking import connect, difference
from conftest_llm import items_of
from pyspark.sql import functions as F

from footfall.llm import fill_in_middle, kernels, oracles, phrase_mining, suffix_search
from footfall.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def tables():
    return connect("/root/testdata/sf0.01")


@pytest.mark.parametrize("name", list(ORACLES))
def test_queries(spark, tables, name):
    assert difference(QUERIES[name](spark, "/root/testdata/sf0.01"), tables, ORACLES[name]) is None


@pytest.fixture(scope="module")
def odd(odd):
    return odd.where("doc_id is null or doc_id != 4")  # SQL is slow on its 30,000 words


@pytest.fixture(scope="module")
def odd_tables(odd):
    con = duckdb.connect()
    for name, df in (("documents", odd.select("doc_id", "text", "lang", "source")), ("benchmark", items_of(odd))):
        con.register(name, pa.Table.from_pylist([r.asDict() for r in df.collect()]))
    return con


def test_fill_in_middle_of_odd_rows(odd, odd_tables):
    assert difference(fill_in_middle.digests(odd).drop("n_chunks"), odd_tables, oracles.FILL_IN_MIDDLE) is None


def test_fill_in_middle_output_is_the_text_rearranged(docs):
    out = {r["doc_id"]: r for r in fill_in_middle.transform(docs).collect()}
    forms = set()
    for r in docs.collect():
        o = out[r["doc_id"]]
        forms.add(o["form"])
        if o["form"] != "plain":
            p, m = o["prefix_chars"], o["prefix_chars"] + o["middle_chars"]
            prefix, middle, suffix = r["text"][:p], r["text"][p:m], r["text"][m:]
            assert o["output"] == (f"<P>{prefix}<S>{suffix}<M>{middle}" if o["form"] == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}")
    assert forms == {"plain", "psm", "spm"}


@pytest.mark.parametrize("least", [1, 3, 128])
def test_units_over_chunk_borders(monkeypatch, least):
    """Every cut of random texts, whose chunks end anywhere, also inside words, blanks and characters."""
    monkeypatch.setattr(fill_in_middle, "LEAST", least)
    monkeypatch.setattr(fill_in_middle, "MOST", 4 * least)
    monkeypatch.setattr(fill_in_middle, "MASK", np.uint32(0b11 << 30))
    rng, memory = random.Random(least), fill_in_middle.Memory(500)
    texts = ["".join(rng.choices("ab é日😀 \t\n", k=rng.randrange(300))) for _ in range(60)] + ["", " ", "x", "x ", " x"]
    for text in texts:
        raw = text.encode()
        ends = fill_in_middle.chunk_ends(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        chunks = [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
        assert b"".join(chunks) == raw
        units = fill_in_middle.Units(raw, ends, memory.look_up(chunks))
        expected = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
        assert units.n == len(expected)
        for m in range(len(expected) + 1):
            head = "".join(expected[:m])
            assert units.cut(m) == (len(head.encode()), len(head))


def test_phrases_of_odd_rows(odd, odd_tables):
    sql = oracles.COLLOCATIONS.replace("count(*) >= 100", "count(*) >= 2")
    assert difference(phrase_mining.collocations(odd, 2).drop("doc_id"), odd_tables, sql) is None
    assert phrase_mining.collocations(odd.where("false"), 2).count() == 0


@pytest.mark.parametrize("bits", [1 << 6, 1 << 12])
def test_colliding_bits_change_nothing(docs, bits, monkeypatch):
    """A bitmap that is nearly full lets everything through, and the counts stay those of the texts."""
    expected = sorted(map(tuple, phrase_mining.collocations(docs, 20).collect()))
    plain = phrase_mining.frequent

    def full(*args):
        found = plain(*args)
        return phrase_mining.Bitmap(found.cells | phrase_mining.U(0x5555555555555555 if bits > 64 else 2**64 - 1))

    monkeypatch.setattr(phrase_mining, "frequent", full)
    assert sorted(map(tuple, phrase_mining.collocations(docs, 20).collect())) == expected


def test_colliding_fingerprints_are_told_apart(monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b c. a b", "A B x"]), pa.array(["en", "fr"])], ["doc_id", "text", "lang"])
    monkeypatch.setattr(phrase_mining.Grams, "prints", lambda self, at, size: np.zeros(len(at), np.uint64))
    found = {}
    everything = phrase_mining.Bitmap(np.full(phrase_mining.BITS // 64, 2**64 - 1, np.uint64))
    for lang, _, phrase, n, doc in phrase_mining.spelled(phrase_mining.Grams(batch), everything, np.array([1, 2])):
        found[lang, phrase] = found.get((lang, phrase), 0) + n
    assert found == {
        ("en", ""): 5, ("fr", ""): 3, ("en", "a"): 2, ("en", "b"): 2, ("en", "c"): 1, ("fr", "a"): 1, ("fr", "b"): 1, ("fr", "x"): 1,
        ("en", "a b"): 2, ("en", "b c"): 1, ("fr", "a b"): 1, ("fr", "b x"): 1, ("en", "a b c"): 1, ("fr", "a b x"): 1,
    }


def test_many_buckets(docs, monkeypatch):
    expected = sorted(map(tuple, phrase_mining.collocations(docs, 5).collect()))
    for name, value in (("BUCKET_BYTES", 5000), ("BUCKET_PHRASES", 40), ("FLUSH", 3000), ("ROWS", 100), ("SHARD_BYTES", 20_000)):
        monkeypatch.setattr(phrase_mining, name, value)
    assert sorted(map(tuple, phrase_mining.collocations(docs, 5).collect())) == expected


def test_scores_beyond_64_bits(spark):
    """floor(1000 * a * n / (l * r)) with products above 2^64, and the floor of a quotient just below a whole number."""
    row = spark.sql("SELECT 1000 * (cast(a as decimal(19, 0)) * cast(n as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0))) AS s FROM VALUES (3000000000000, 90000000000000000, 3000000000001, 5000000000000) AS t(a, n, l, r)").first()
    assert row["s"] == 1000 * 3000000000000 * 90000000000000000 // (3000000000001 * 5000000000000)


def test_decontamination_of_odd_rows(odd, odd_tables):
    assert difference(suffix_search.scan(odd, items_of(odd)), odd_tables, oracles.DECONTAMINATION) is None


def test_decontamination_in_blocks(odd, odd_tables, spark, tables, monkeypatch):
    monkeypatch.setattr(suffix_search, "BLOCK_BYTES", 400)
    assert difference(suffix_search.scan(odd, items_of(odd)), odd_tables, oracles.DECONTAMINATION) is None
    monkeypatch.setattr(suffix_search, "BLOCK_BYTES", 4000)
    assert difference(QUERIES["op13_suffix_decontamination"](spark, "/root/testdata/sf0.01"), tables, ORACLES["op13_suffix_decontamination"]) is None


def test_decontaminated_documents_have_no_window(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    left = suffix_search.clean(docs, items)
    assert left.columns == docs.columns
    hit = {r["doc_id"] for r in suffix_search.scan(docs, items).where("contaminated").collect()}
    assert hit and {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in left.collect()} == hit


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "x A b C d"), (2, "b c d e. f"), (3, "a b"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([("q", "a b c d e f g"), ("r", "zzz"), (None, "")], "item_id string, text string")
    found = {(r["item_id"], r["start"]): (r["length"], r["doc_id"], r["place"]) for r in suffix_search.longest_matches(docs, items).collect()}
    assert found == {
        ("q", 0): (4, 1, 1), ("q", 1): (5, 2, 0), ("q", 2): (4, 2, 1), ("q", 3): (3, 2, 2), ("q", 4): (2, 2, 3), ("q", 5): (1, 2, 4),
    }


def test_words_of_equal_hash_do_not_match(monkeypatch):
    tests = suffix_search.Tests.of([("q", "one two")], 10)
    real = suffix_search.Words.hashes
    twin = {k: h for k, h in zip(("one", "two"), real(suffix_search.Words(*suffix_search.text_bytes(pa.array(["one two"]))), True), strict=True)}

    def hashes(self, lower=False):
        out = real(self, lower)
        for k in range(len(self)):
            if bytes(self.data[self.start[k] : self.end[k]]) == b"false":
                out[k] = twin["two"]
        return out

    monkeypatch.setattr(suffix_search.Words, "hashes", hashes)
    shard = suffix_search.Shard(pa.array(["one false one two", "one false"]), tests)
    assert shard.items() == [{0}, set()] and shard.hit.tolist() == [False, False, True, True, False, False, False, False]


def test_hashes_do_not_depend_on_other_words():
    words = ["one", "x" * 70_000, "é" * 40_000, "two"]
    alone = [kernels.Words(*kernels.text_bytes(pa.array([w]))).hashes()[0] for w in words]
    assert kernels.Words(*kernels.text_bytes(pa.array([" ".join(words)]))).hashes().tolist() == alone
    many = " ".join(words[:1] * 2_000_000)  # more than one step of bytes
    assert np.unique(kernels.Words(*kernels.text_bytes(pa.array([many]))).hashes()).tolist() == alone[:1]


def test_suffix_arrays_are_sorted():
    rng = np.random.default_rng(2)
    for _ in range(20):
        symbols = np.append(rng.integers(-1, 4, 200), -1)  # a text's end
        array = suffix_search.SuffixArray(symbols, 200)
        suffixes = [array.value[k:].tolist() for k in array.order.tolist()]
        assert suffixes == sorted(suffixes) and sorted(array.order.tolist()) == np.flatnonzero(symbols >= 0).tolist()
