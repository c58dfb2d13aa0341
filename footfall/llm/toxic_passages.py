"""Toxicity: maximum-scoring passages over the log-odds of tokens.

Token log-odds between toxic and other texts carry a Dirichlet prior that is the corpus's own token frequencies; only tokens
whose log-odds are many deviations above zero score, every other word costs ``COST``. A linear scan finds all maximal-scoring
passages of a text (the segments that no extension or cut improves). How surprising a passage is follows the extreme-value law
of such maxima, E = n * exp(-lambda * score) over a text of n words, with lambda from the scores seen in texts that are not
toxic; the evidence of all significant passages is added up, and a logistic curve turns it into the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import held_out, texts, training_sample
from footfall.llm.kernels import U, Words, mix, steps, text_bytes
from footfall.llm.license_join import parting

SAMPLE_ROWS = 20_000
LEXICON = 4_096
# A word stands for itself and for its first bytes, which catch inflected forms.
STEMS = (4, 5, 6, 7, 8, 10)
PRIOR = 200.0
DEVIATIONS = 2.5
LEAST_TEXTS = 4
COST = 0.5
CUTOFF = 0.3
COLUMNS = "doc_id long, score double, predicted int, passages long, evidence double"


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """Words and, in one row for each word, the codes of the word and of its stems (0 where it is shorter)."""
    words = Words(data, offsets, parting())
    out = np.zeros((len(words), 1 + len(STEMS)), U)
    out[:, 0] = words.hashes(lower=True)
    size = words.end - words.start
    whole = words.end.copy()
    for k, stem in enumerate(STEMS, 1):
        words.end = np.minimum(whole, words.start + stem)
        out[:, k] = np.where(size > stem, mix(words.hashes(lower=True) + U(stem)), U(0))
    words.end = whole
    return words, out


@dataclass
class Model:
    codes: np.ndarray  # sorted token codes that score
    value: np.ndarray
    decay: float = 1.0
    weight: float = 1.0
    bias: float = -2.0

    def word_scores(self, codes: np.ndarray) -> np.ndarray:
        best = np.full(len(codes), -COST)
        if len(self.codes):
            for column in codes.T:
                at = np.minimum(np.searchsorted(self.codes, column), len(self.codes) - 1)
                hit = self.codes[at] == column
                best[hit] = np.maximum(best[hit], self.value[at[hit]])
        return best

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + self.weight * evidence, -30, 30)))


def passages(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, past the last, score) of one text, from left to right."""
    out: list[list[float]] = []  # total before, total after, first, past the last
    total, last = 0.0, 0
    for i in np.flatnonzero(scores > 0).tolist():
        total -= COST * (i - last)
        low, high, first = total, total + float(scores[i]), i
        total, last = high, i + 1
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][0] >= low:
                j -= 1
            if j < 0 or out[j][1] >= high:
                out.append([low, high, first, i + 1])
                break
            low, first = out[j][0], out[j][2]
            del out[j:]
    return [(int(a), int(b), high - low) for low, high, a, b in out]


def evidence(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: the number of significant passages and their added evidence; below zero where even the best is no surprise."""
    words, codes = tokens(data, offsets)
    scores = model.word_scores(codes)
    n = len(words.count)
    count, total = np.zeros(n, np.int64), -np.log(np.maximum(words.count, 2.0))
    for t in np.unique(words.text[scores > 0]).tolist():
        found = passages(scores[words.bounds[t] : words.bounds[t + 1]])
        surprise = model.decay * np.array([s for _, _, s in found]) + total[t]
        count[t] = (surprise > 0).sum()
        total[t] = surprise[surprise > 0].sum() if count[t] else surprise.max()
    return count, total


def log_odds(ones: np.ndarray, zeros: np.ndarray, n_one: float, n_zero: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds ratio of each token and its deviations from zero, with a Dirichlet prior of weight ``PRIOR`` on the pooled shares."""
    prior = PRIOR * (ones + zeros) / max(n_one + n_zero, 1.0)
    a, b = ones + prior, zeros + prior
    ratio = np.log(a / np.maximum(n_one + PRIOR - a, 1e-9)) - np.log(b / np.maximum(n_zero + PRIOR - b, 1e-9))
    return ratio, ratio / np.sqrt(1 / a + 1 / b)


def learn_tokens(sample: DataFrame) -> Model:
    """Count in how many texts of each class a token stands (before the shuffle already), and keep the surest ``LEXICON`` ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            words, codes = tokens(*text_bytes(batch.column(1)))
            label = batch.column(2).to_numpy(zero_copy_only=False)
            text = np.repeat(words.text, codes.shape[1])
            flat = codes.reshape(-1)
            keep = flat != 0
            pair = np.stack([flat[keep], text[keep].astype(U)], 1)
            pair = pair[np.unique(mix(pair[:, 0] + mix(pair[:, 1])), return_index=True)[1]]
            code, inverse = np.unique(pair[:, 0], return_inverse=True)
            one = np.bincount(inverse, label[pair[:, 1].astype(np.int64)], len(code)).astype(np.int64)
            both = np.bincount(inverse, minlength=len(code))
            # a token of one text only can't become sure
            yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(one), pa.array(both - one)], ["code", "one", "zero"])

    size = sample.groupBy("label").count().collect()
    n = {r["label"]: r["count"] for r in size}
    n_one, n_zero = float(n.get(1, 0)), float(n.get(0, 0))
    counted = sample.mapInArrow(count, "code long, one long, zero long").groupBy("code").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero"))
    prior = F.lit(PRIOR) * (F.col("one") + F.col("zero")) / F.lit(max(n_one + n_zero, 1.0))
    likely = counted.where((F.col("one") >= LEAST_TEXTS) & ((F.col("one") + prior) * (n_zero + PRIOR) > (F.col("zero") + prior) * (n_one + PRIOR) * 3))
    # the ratio over its deviation falls as both counts do: order by a bound that needs no logarithms of totals
    top = likely.orderBy(F.desc(F.col("one") / (F.col("zero") + 1.0)), F.desc("one"), "code").limit(LEXICON).toPandas()
    ratio, deviations = log_odds(top["one"].to_numpy(float), top["zero"].to_numpy(float), n_one, n_zero)
    sure = deviations >= DEVIATIONS
    codes, value = top["code"].to_numpy(np.int64).astype(U)[sure], ratio[sure]
    order = np.argsort(codes)
    return Model(codes[order], value[order])


def calibrate(model: Model, sample: DataFrame, most: int) -> Model:
    """Fit the decay of chance scores on texts that are not toxic, then the logistic curve over the added evidence."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            words, codes = tokens(*text_bytes(batch.column(1)))
            scores = model.word_scores(codes)
            zero = batch.column(2).to_numpy(zero_copy_only=False)[words.text] == 0
            value, number = np.unique(np.round(scores[zero], 1), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(number)], ["value", "n"])

    seen = sample.mapInArrow(measure, "value double, n long").groupBy("value").agg(F.sum("n").alias("n")).toPandas()
    # one word of chance for each score that occurs in the lexicon, so that an unseen score is rare, not impossible
    value = np.concatenate([[-COST], seen["value"].to_numpy(float), np.unique(np.round(model.value, 1))])
    share = np.concatenate([[1.0], seen["n"].to_numpy(float), np.full(len(value) - 1 - len(seen), 0.1)])
    share /= share.sum()
    low, high = 0.0, 20.0
    for _ in range(60):  # the positive root of sum(share * exp(decay * value)) = 1
        mid = (low + high) / 2
        low, high = (mid, high) if (share * np.exp(np.clip(mid * value, -700, 700))).sum() < 1 else (low, mid)
    model.decay = max(low, 0.05)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            _, total = evidence(model, *text_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(total)], ["doc_id", "label", "x"])

    rows = sample.mapInArrow(weigh, "doc_id long, label int, x double").toPandas().sort_values(["doc_id", "x"])[:most]
    x, y = rows["x"].to_numpy(float), rows["label"].to_numpy(float)
    if len(y) >= 10 and y.min() != y.max():
        w = np.zeros(2)
        design = np.stack([np.ones(len(x)), x], 1)
        for _ in range(50):  # Newton steps for the logistic loss with a small ridge
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2), design.T @ (y - p) - 0.1 * w)
            w += np.clip(step, -2, 2)
        model.bias, model.weight = float(w[0]), max(float(w[1]), 0.0)
    return model


def train(docs: DataFrame, labels: DataFrame, modulus: int = 4, rest: int = 2, most: int = SAMPLE_ROWS) -> Model:
    """Tokens are learned on two thirds of the labelled sample, the curve on the other third, so that it sees them as new text does."""
    sample = training_sample(docs, labels, "toxic", modulus, rest, most).select("doc_id", "text", "label")
    third = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3)) == 0
    return calibrate(learn_tokens(sample.where(~third)), sample.where(third), most)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Toxicity of every text: score, verdict at 0.3, and the passages behind it.

    Only the text counts. Null and empty texts have no passages and get the score of none; repeated rows are scored each;
    without labels nothing scores.
    """
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            count, total = evidence(model, *text_bytes(batch.column(1)))
            s = model.probability(total)
            columns = [batch.column(0), pa.array(s), pa.array((s >= CUTOFF).astype(np.int32)), pa.array(count), pa.array(total)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in COLUMNS.split(", ")])

    scored = texts(docs).mapInArrow(run, COLUMNS)
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted", "passages", "evidence")
