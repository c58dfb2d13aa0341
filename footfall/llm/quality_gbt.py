"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``), whose statistics are small
numbers gathered on the driver. They are then flattened into arrays, and every document is scored by
vectorised traversal in the tasks that read it: one scan, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import held_out, texts, training_sample
from footfall.llm.kernels import Words, mix, steps, text_bytes, windows

SAMPLE_ROWS = 20_000
CUTOFF = 0.3
FEATURES = [
    "log_bytes", "log_words", "word_length", "word_length_spread", "upper", "digits", "symbols", "exclaims", "stops", "wide",
    "blanks", "entropy", "log_lines", "words_a_line", "repeated_lines", "distinct_words", "commonest_word", "doubled_words",
    "repeated_threes", "longest_word", "marked_words",
]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` per text; a text without words has zeros where there is nothing to count."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    seen = np.bincount(owner * 256 + data, minlength=n * 256).reshape(n, 256).astype(float)
    bytes_ = np.maximum(size, 1.0)
    share = lambda chars: seen[:, list(chars)].sum(1) / bytes_
    words = Words(data, offsets)
    hashes = words.hashes(lower=True)
    count = np.maximum(words.count, 1.0)
    length = (words.end - words.start).astype(float)
    per = lambda values=None: np.bincount(words.text, values, minlength=n)
    mean = per(length) / count
    spread = np.sqrt(np.maximum(per(length**2) / count - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, words.text, length)
    # equal words of a text stand together after sorting by (text, hash)
    tagged = np.sort(mix(hashes + words.text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(mix(hashes + words.text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
    new = np.ones(len(tagged), bool)
    new[1:] = tagged[1:] != tagged[:-1]
    heads = np.flatnonzero(new)
    group_text, group_size = words.text[order][heads], np.diff(np.append(heads, len(tagged)))
    distinct = np.bincount(group_text, minlength=n)
    commonest = np.zeros(n)
    np.maximum.at(commonest, group_text, group_size)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (words.text[1:] == words.text[:-1])
    threes, at = windows(words, hashes, 3)
    three_text = words.text[at]
    distinct_threes = np.bincount(three_text[first_of(mix(threes + three_text.astype(np.uint64)))], minlength=n)
    n_threes = np.bincount(three_text, minlength=n)
    only_newline = np.zeros(256, bool)
    only_newline[10] = True
    lines = Words(data, offsets, only_newline)
    line_keys = mix(lines.hashes() + lines.text.astype(np.uint64))
    distinct_lines = np.bincount(lines.text[first_of(line_keys)], minlength=n)
    n_lines = np.maximum(lines.count, 1.0)
    p = seen / bytes_[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&|<>!")] = True
    marked = symbol[data[words.end - 1]] if len(words) else np.zeros(0, bool)
    out = [
        np.log1p(size), np.log1p(words.count), mean, spread, share(range(65, 91)), share(range(48, 58)), share(b"#*$%&|<>"), share(b"!"),
        share(b".,;:?"), share(range(128, 256)), share(b" \t\n\r"), entropy, np.log1p(lines.count), words.count / n_lines,
        1 - distinct_lines / n_lines, distinct / count, commonest / count, per(same) / count,
        1 - distinct_threes / np.maximum(n_threes, 1.0), longest, per(marked) / count,
    ]
    out[14], out[18] = np.where(lines.count > 0, out[14], 0), np.where(n_threes > 0, out[18], 0)
    return np.stack(out, 1)


def first_of(keys: np.ndarray) -> np.ndarray:
    """Index of the first of each distinct key."""
    return np.unique(keys, return_index=True)[1]


@dataclass
class Trees:
    """Trees flattened into arrays: node i of tree t tests ``feature[t, i]`` against ``limit[t, i]``; its children are 2i+1 and 2i+2."""

    base: float
    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        depth = int(np.log2(self.value.shape[1])) if self.value.size else 0
        rows = np.arange(len(x))
        for feature, limit, value in zip(self.feature, self.limit, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 2.0) -> Trees:
    """Boosted trees for the logistic loss, grown level by level from gradient histograms over quantile bins.

    Without rows, every score is 0.5; with one class only, the smoothed share of ones.
    """
    inner = 2**depth - 1
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(share / (1 - share)))
    empty = Trees(base, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if len(y) < 10 or y.min() == y.max():
        return empty
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    coded = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1)
    total, features, limits, values = np.full(len(y), base), [], [], []
    width = x.shape[1]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, limit, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), int)
        for level in range(depth):
            start, wide = 2**level - 1, 2**level
            slot = node - start
            g = np.empty((width, wide, bins))
            h = np.empty((width, wide, bins))
            for f in range(width):
                at = slot * bins + coded[:, f]
                g[f] = np.bincount(at, grad, wide * bins).reshape(wide, bins)
                h[f] = np.bincount(at, hess, wide * bins).reshape(wide, bins)
            gl, hl = g.cumsum(2), h.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < 1) | (ht - hl < 1)] = 0
            best = gain.transpose(1, 0, 2).reshape(wide, -1)
            pick = best.argmax(1)
            for s in np.flatnonzero(best.max(1) > 1e-6):
                f, b = divmod(int(pick[s]), bins)
                if b < len(cuts[f]):
                    feature[start + s], limit[start + s] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > limit[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + ridge)
        total += value[leaf]
        features.append(feature), limits.append(limit), values.append(value)
    return Trees(base, np.array(features), np.array(limits), np.array(values))


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, rest: int = 0, most: int = SAMPLE_ROWS) -> Trees:
    """Fit the trees on the statistics of at most ``most`` labelled texts that are not held out."""
    sample = training_sample(docs, labels, "quality", modulus, rest, most).select("doc_id", "text", "label")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            values = pa.array(list(statistics(*text_bytes(batch.column(1)))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), values], ["doc_id", "label", "x"])

    rows = sample.mapInArrow(measure, "doc_id long, label int, x array<double>").toPandas().sort_values("doc_id")
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    # a repeated id would let the sample outgrow its bound
    return fit(x[:most], rows["label"].to_numpy(float)[:most])


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1, higher: better text) and ``predicted`` for every row of ``docs``.

    Null and empty texts get the score of a text without words. Repeated rows are scored each. Equal texts
    have equal scores, since nothing but the text is looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            s = model.scores(statistics(*text_bytes(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= CUTOFF).astype(np.int32))], ["doc_id", "score", "predicted"])

    return texts(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score all documents with trees learned from the labelled ones outside the held-out fold."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is not rejected. Rows are judged where they are read, so
    repeated or null ids do no harm."""
    model = train(docs, labels)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            good = model.scores(statistics(*text_bytes(batch.column(place)))) >= CUTOFF
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
