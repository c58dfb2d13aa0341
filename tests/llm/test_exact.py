"""Operators against brute force on the smallest given tables, and round trips."""

import collections
import hashlib
import random
import re
import time
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from conftest_llm import PIECES, WORDS
from tokenizers import Tokenizer

from footfall.llm import (
    chunk_fingerprints,
    license_join,
    minhash_dedup,
    packing,
    prefix_tokens,
    quality_rules,
    source_mix,
    suffix_dedup,
    superminhash,
)
from footfall.llm.suffixes import RepeatArray, intervals, maximal_repeats

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_fingerprints(docs, texts):
    rows = by_id(chunk_fingerprints.fingerprints(docs))
    prints = {}
    for k, (i, text) in enumerate(texts):
        follow = texts[(k + 1) % len(texts)][1]
        n = len(text) // 4
        edited = text[: len(text) - n] + follow[:n]
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[i]["edited_fingerprint"] == chunk_fingerprints.measure([(0, edited)], [""])[3][0].as_py()
        assert rows[i]["n_chars"] == len(text) and 0 <= rows[i]["near_edited"] <= 1
        assert prints.setdefault(text, rows[i]["fingerprint"]) == rows[i]["fingerprint"]
        if len(text) > 300:
            assert rows[i]["near_edited"] > 0.5
            assert rows[i]["near_next"] < 0.3 or text[:50] in follow or follow[:50] in text


def test_shifted_text_keeps_its_chunks():
    text = " ".join(f"w{i * 7919 % 1000}" for i in range(400))
    assert chunk_fingerprints.measure([(0, "moved " + text), (1, text)], [text, ""])[6][0].as_py() > 0.9


def test_token_counts(docs, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = by_id(prefix_tokens.count(docs, PIECES, 500))
    for i, text in texts:
        n = len(library.encode(text))
        assert (rows[i]["n_bytes"], rows[i]["n_tokens"], rows[i]["over_limit"]) == (len(text.encode()), n, n > 500)
        if n > 500:
            assert len(library.encode(text[: rows[i]["limit_chars"]])) <= 500


@pytest.mark.parametrize("text", ["", " ", "  ", "\n", " \n ", "a  b", "a\n\nb", "▁", "a▁b", "日本 😀é", "x" * 100, "a\tb", "<s> </s> [INST]", "trail   ", "\r\n x"])
def test_every_prefix(text):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = prefix_tokens.counter(PIECES).of(pa.array([text])).prefixes(0).tolist()
    assert found == [len(library.encode(text[:k])) for k in range(1, len(text) + 1)]


def odd_texts(n, seed):
    """Random texts over all scripts, signs and blanks, mostly of common letters."""
    rng = random.Random(seed)
    signs = [chr(k) for k in range(1, 0x3000) if unicodedata.category(chr(k))[0] in "LMNPSZC"] + list("日本語한국어😀🏽İΣςſẞKǺ\u0308▁")
    signs += list("aeiouAEIOUthnrs  .,'\n\t▁") * 80
    return ["".join(rng.choices(signs, k=rng.randrange(1, 40))) for _ in range(n)]


def test_every_prefix_of_odd_texts():
    library, texts = sentencepiece.SentencePieceProcessor(model_file=PIECES), odd_texts(500, 1)
    found = prefix_tokens.counter(PIECES).of(pa.array(texts))
    for k, text in enumerate(texts):
        assert found.prefixes(k).tolist() == [len(library.encode(text[:j])) for j in range(1, len(text) + 1)]
        assert found.totals()[k] == len(library.encode(text))


def test_long_words_take_linear_time():
    library, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(2)
    word = "".join(rng.choices("abcdefgh01/+", k=1_000_000))
    start = time.process_time()
    assert prefix_tokens.counter(PIECES).of(pa.array([word])).totals().tolist() == [len(library.encode(word))]
    assert time.process_time() - start < 10


def test_forgetting_changes_nothing(monkeypatch):
    texts = odd_texts(300, 3)
    expected = prefix_tokens.PrefixCounter(PIECES).of(pa.array(texts)).totals().tolist()
    monkeypatch.setattr(prefix_tokens, "REMEMBERED", 200)
    monkeypatch.setattr(prefix_tokens, "PAIRS", 20)
    counter = prefix_tokens.PrefixCounter(PIECES)
    assert [n for k in range(0, 300, 50) for n in counter.of(pa.array(texts[k : k + 50])).totals().tolist()] == expected


def test_counts_of_cut_texts(docs, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = by_id(prefix_tokens.tokens_at(prefix_tokens.prefix_counts(docs, PIECES), 100))
    assert {i: r["n_tokens"] for i, r in rows.items()} == {i: len(library.encode(t[:100])) for i, t in texts}


def test_ids_of_odd_texts(monkeypatch):
    """Each sign in and between words, final sigmas, composed and decomposed letters, special tokens, words with a mark behind them."""
    texts = ["", " ", ".", ".,", "ΑΣ", "ΑΣ. x", "A'S 'll don't.", "x<|endoftext|>y.", "<|startoftext|>,", "é .", "İstanbul. ﬁne", "x,. 1,000."]
    texts += ["Ab" + chr(k) + "cD. " + chr(k) + " x" + chr(k) + "," for k in range(0x3100) if not 0xD800 <= k < 0xE000] + odd_texts(2000, 4)
    words = packing.WordTokenizer(WORDS)
    monkeypatch.setattr(packing, "REMEMBERED", 5000)
    for a in range(0, len(texts), 5000):
        ids, bounds = words.encode(pa.array(texts[a : a + 5000]))
        for text, i, j in zip(texts[a : a + 5000], bounds[:-1], bounds[1:], strict=True):
            assert ids[i:j].tolist() == words.library.encode(text, add_special_tokens=False).ids


def removed(texts, least=50):
    seen = {}
    for i, text in texts:
        raw = (text or "").encode()
        gone, own = np.zeros(len(raw), bool), []
        for k in range(len(raw) - least + 1):
            if seen.get(raw[k : k + least], i) < i:
                gone[k : k + least] = True
            own.append(raw[k : k + least])
        for w in own:
            seen.setdefault(w, i)
        yield i, raw, gone


@pytest.mark.parametrize("hot", [256, 0])
def test_repeated_bytes(docs, texts, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_UNITS", hot)
    rows = by_id(suffix_dedup.dedup(docs))
    for i, raw, gone in removed(texts):
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        sha = hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()
        assert (rows[i]["n_bytes"], rows[i]["n_removed"], rows[i]["n_spans"], rows[i]["kept_sha256"]) == (len(raw), gone.sum(), spans, sha)


def test_repeated_bytes_of_uniform_texts(odd):
    rows = by_id(suffix_dedup.dedup(odd))
    assert rows[13]["n_removed"] == 0 and rows[14]["n_removed"] == 69_999 and rows[11]["n_removed"] == 0


def test_ends_do_not_part_repeats():
    """Contexts that end inside what others share, more than a byte can number: an end must not sort among bytes."""
    rng = np.random.default_rng(2)
    base = rng.choice(np.array([0, 1, 97, 255], np.uint8), 120)
    cut = [(a, a + int(rng.integers(50, 83))) for a in rng.integers(0, 37, 3000).tolist()]
    parts = [base[a:b].copy() for a, b in cut]
    for part in parts[::3]:
        part[rng.integers(len(part))] = rng.integers(256)
    least = rng.permutation(len(parts))
    first = {}
    windows = [[p[k : k + 50].tobytes() if k + 50 <= len(p) else None for k in range(len(p))] for p in parts]
    for own, doc in zip(windows, least.tolist(), strict=True):
        for w in own:
            first[w] = min(first.get(w, doc), doc)
    owner = suffix_dedup.own_windows(np.concatenate(parts), np.array([len(p) for p in parts]), least)
    wrong = [k for k, w in enumerate(w for own in windows for w in own) if w is not None and owner[k] != first[w]]
    assert not wrong


def test_intervals_and_maximal_repeats():
    text = "banana$"
    array = RepeatArray(np.frombuffer(text.encode(), np.uint8).astype(np.int64), 1)
    assert sorted(intervals(array.shared)) == [(1, 0, 2), (2, 3, 4), (3, 1, 2)]
    before = np.array([-1, *text.encode()[:-1]])
    found = {(text[at[0] : at[0] + size], tuple(sorted(at.tolist()))) for size, at in maximal_repeats(array, before)}
    assert found == {("a", (1, 3, 5)), ("ana", (1, 3))}


def shingle_sets(texts, width=5):
    for i, text in texts:
        words = BLANK.findall((text or "").translate(LOWER))
        yield i, {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


@pytest.mark.parametrize("threshold", [85, 80])
def test_near_duplicates(docs, texts, threshold):
    rows = by_id(minhash_dedup.group(docs, threshold))
    sets = dict(shingle_sets(texts))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    for i in ids:
        assert (rows[i]["n_shingles"], rows[i]["component_id"], rows[i]["kept"]) == (len(sets[i]), find(i), find(i) == i)


def test_signatures_do_not_depend_on_slices(monkeypatch):
    rng = np.random.default_rng(3)
    sizes = np.concatenate([[0], rng.integers(0, 90, 40), [3000, 0, 1]])
    owner, keys = np.repeat(np.arange(len(sizes)), sizes), rng.integers(0, 2**63, sizes.sum()).astype(np.uint64)
    whole = superminhash.signatures(keys, owner, len(sizes), 168)
    monkeypatch.setattr(superminhash, "SLICE", 50)
    assert (superminhash.signatures(keys, owner, len(sizes), 168) == whole).all()
    assert (whole[sizes == 0] == superminhash.EMPTY).all() and (whole[sizes > 0] != superminhash.EMPTY).all()


def test_links_beside_the_centre(spark):
    """Copies that are alike only to each other, in a bucket whose centre is alike to none of them."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for family in range(3):
        own = list(base)
        for k in rng.choice(300, 12, replace=False):
            own[k] = f"f{family}x{k}"
        for copy in range(4):
            text = list(own)
            for k in rng.choice(300, 2, replace=False):
                text[k] = f"c{family}y{copy}z{k}"
            rows.append((len(rows), " ".join(text)))
    found = by_id(minhash_dedup.group(spark.createDataFrame(rows, "doc_id long, text string")))
    sets = dict(shingle_sets(rows))
    root = list(range(len(rows)))
    for _ in rows:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert [found[i]["component_id"] for i in range(len(rows))] == root


@pytest.mark.parametrize("sizes", [(30, 25), (60, 50)])
def test_similar_families_make_few_candidates(spark, monkeypatch, sizes):
    """Two large families whose members share buckets, though none is linked to one of the other family."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(400)]
    rows = []
    for family, members in enumerate(sizes):
        own = list(base)
        for k in range(10 * family):
            own[40 * k + 7] = f"f{family}x{k}"
        for copy in range(members):
            text = list(own)
            for k in rng.choice(400, 3, replace=False):
                text[k] = f"c{family}y{copy}z{k}"
            rows.append((len(rows), " ".join(text)))
    made = []
    old = minhash_dedup.candidates

    def counted(edges, threshold):
        found = old(edges, threshold)
        made.append(found.count())
        return found

    monkeypatch.setattr(minhash_dedup, "candidates", counted)
    found = by_id(minhash_dedup.group(spark.createDataFrame(rows, "doc_id long, text string")))
    sets = dict(shingle_sets(rows))
    linked = [(a, b) for a in sets for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    root = list(range(len(rows)))
    for _ in rows:
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    assert [found[i]["component_id"] for i in range(len(rows))] == root
    assert len(made) == 1 and made[0] <= len(linked)


def test_mix(docs):
    rows = source_mix.plan(docs).collect()
    again = sorted(map(tuple, source_mix.plan(docs.repartition(5)).collect()))
    assert again == sorted(map(tuple, rows))
    sources = {r["doc_id"]: r["source"] for r in docs.collect()}
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        s = sources[r["doc_id"]]
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    weights = dict(zip(sorted(size), [5, 2, 1] * len(size)))
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    levels = {target[s] / weights[s] for s in size if target[s] < 2 * size[s] - 1e-6}
    assert max(levels) == pytest.approx(min(levels)) and all(2 * size[s] / weights[s] <= max(levels) + 1e-6 for s in size if target[s] >= 2 * size[s] - 1e-6)
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)


def test_packing(docs, texts):
    library = Tokenizer.from_file(WORDS)
    rows = packing.pack_texts(docs, WORDS, 600).collect()
    found = {(r["doc_id"], r["piece"]): r for r in rows}
    assert len(found) == len(rows)
    for i, text in texts:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
        for k, a in enumerate(range(0, len(ids), 600)):
            r = found.pop((i, k))
            assert (r["start"], r["length"], r["ids_crc32"]) == (a, len(ids[a : a + 600]), zlib.crc32(ids[a : a + 600].tobytes()))
    assert not found
    places = collections.defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 600


def test_best_fit_is_best_fit():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = sorted(rng.integers(1, 50, 200).tolist(), reverse=True)
        bins = []
        for n in lengths:
            fit = [b for b in range(len(bins)) if bins[b] >= n]
            if fit:
                best = min(fit, key=lambda b: bins[b])
                bins[best] -= n
            else:
                bins.append(50 - n)
        assert packing.best_fit(dict(collections.Counter(lengths)), 50)[1] == len(bins)


def test_rules(docs, texts):
    rows = by_id(quality_rules.judge(docs))
    for i, text in texts:
        words, r = BLANK.findall(text), rows[i]
        threes = collections.Counter(zip(words, words[1:], words[2:]))
        again = {k + d for k in range(len(words) - 2) for d in range(3) if threes[tuple(words[k : k + 3])] > 1}
        lines = [x for x in text.split("\n") if BLANK.search(x)]
        expected = (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected
        assert r["base_failed"] == (len(words) < 50 or 100 * len(again) > 50 * len(words))
        eights = collections.defaultdict(list)
        for k in range(len(words) - 7):
            eights[tuple(words[k : k + 8])].append(k)
        inside = {k + d for at in eights.values() if len(at) > 1 for k in at for d in range(8)}
        assert r["covered"] == pytest.approx(sum(len(words[k].encode()) for k in inside) / max(1, sum(len(w.encode()) for w in words)))


def test_maximal_repeats_of_a_text():
    assert quality_rules.repeats("a b c d x a b c d y b c d", 3) == [(3, [1, 6, 10]), (4, [0, 5])] or sorted(quality_rules.repeats("a b c d x a b c d y b c d", 3)) == [(3, [1, 6, 10]), (4, [0, 5])]


def test_licenses(docs, texts):
    rows = by_id(license_join.scan(docs))
    word = re.compile(license_join.WORD)
    for i, text in texts:
        words, places, labels = word.findall(text.translate(LOWER)), [], set()
        for phrase, label in license_join.PHRASES.items():
            parts = phrase.split()
            at = [k for k in range(len(words)) if words[k : k + len(parts)] == parts]
            places += at
            labels |= {label} if at else set()
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(places), ",".join(sorted(labels)))
        assert (r["first_word"], r["last_word"]) == ((min(places), max(places)) if places else (None, None))
        # the join against a look at every block
        plan = license_join.Plan.of(license_join.TEMPLATES, license_join.SHARE, {})
        for begin in range(0, max(1, len(words)), plan.hop):
            block = set(words[begin : begin + 2 * plan.hop])
            for label, template in license_join.TEMPLATES:
                tokens = set(template.split())
                if len(tokens & block) >= license_join.SHARE * len(tokens):
                    labels.add(label)
        assert r["labels"] == ",".join(sorted(labels))
