"""License scans: an exact containment join of text blocks with license templates.

Tokens are ordered by how often they occur in the whole corpus, rarest first. A template of n distinct tokens that must be
contained to a share t needs at least ``ceil(t * n)`` of them, so a block without any of the ``n - ceil(t * n) + 1`` rarest
cannot match (prefix filter). Too short a block, or one whose remaining tokens after the first match are too few (length and
positional filters), is passed over before the exact count. Templates are a bounded list, so they travel to every task;
what comes back to the driver are the counts of the templates' own tokens.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import texts
from footfall.llm.kernels import Words, steps, text_bytes

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The phrases and labels of the base columns.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Wordings of common license notices, with the label that each stands for.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
]
SHARE = 0.9
COLUMNS = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "n_blocks long"
)


def parting() -> np.ndarray:
    """True for the bytes that part words: all of ASCII but letters and digits."""
    table = np.zeros(256, bool)
    table[:128] = True
    for a, b in ((48, 58), (65, 91), (97, 123)):
        table[a:b] = False
    return table


def code(words: list[str]) -> np.ndarray:
    return Words(*text_bytes(pa.array(words)), parting()).hashes(lower=True)


@dataclass
class Plan:
    """Templates as sets of token numbers, ordered from the rarest token to the commonest."""

    labels: list[str]
    tokens: np.ndarray  # codes, sorted
    rank: np.ndarray  # of each token: 0 for the rarest
    sets: list[np.ndarray]  # ranks of each template's tokens, ascending
    need: list[int]
    hop: int

    @staticmethod
    def of(templates: list[tuple[str, str]], share: float, counts: dict[int, int]) -> Plan:
        words = [sorted(set(re.findall(WORD, t.lower()))) for _, t in templates]
        vocabulary = sorted({w for ws in words for w in ws})
        codes = code(vocabulary) if vocabulary else np.zeros(0, np.uint64)
        order = sorted(range(len(vocabulary)), key=lambda i: (counts.get(int(codes[i].astype(np.int64)), 0), vocabulary[i]))
        rank_of = {vocabulary[i]: r for r, i in enumerate(order)}
        by_code = np.argsort(codes)
        rank = np.array([rank_of[vocabulary[i]] for i in by_code], np.int64)
        sets = [np.array(sorted(rank_of[w] for w in ws), np.int64) for ws in words]
        hop = max([1, *(len(re.findall(WORD, t.lower())) for _, t in templates)])
        return Plan([a for a, _ in templates], codes[by_code], rank, sets, [max(1, math.ceil(share * len(s) - 1e-9)) for s in sets], hop)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are template tokens, and their ranks."""
        if not len(self.tokens) or not len(codes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.tokens, codes), len(self.tokens) - 1)
        hit = np.flatnonzero(self.tokens[at] == codes)
        return hit, self.rank[at[hit]]


def matches(words: Words, codes: np.ndarray, plan: Plan) -> list[tuple[int, int, int, float]]:
    """(text, first word of the block, template, contained share) of every block that holds enough of a template.

    Blocks are twice as long as the longest template and start every half block, so a notice never falls between two.
    """
    hit, rank = plan.find(codes)
    if not len(hit):
        return []
    text = words.text[hit]
    place = hit - words.bounds[text]
    rare = np.zeros(len(plan.rank), bool)
    for tokens, need in zip(plan.sets, plan.need, strict=True):
        rare[tokens[: len(tokens) - need + 1]] = True
    # blocks that hold a token of some prefix: block b covers words hop * b up to hop * (b + 2)
    seen = np.flatnonzero(rare[rank])
    block = place[seen] // plan.hop
    wanted = np.unique(np.concatenate([np.stack([text[seen], np.maximum(block - d, 0)], 1) for d in (0, 1)]), axis=0)
    found = []
    begin = words.bounds[wanted[:, 0]] + wanted[:, 1] * plan.hop
    first, last = np.searchsorted(hit, begin), np.searchsorted(hit, np.minimum(begin + 2 * plan.hop, words.bounds[wanted[:, 0] + 1]))
    for (t, b), i, j in zip(wanted.tolist(), first.tolist(), last.tolist(), strict=True):
        have = np.unique(rank[i:j])
        for k, (tokens, need) in enumerate(zip(plan.sets, plan.need, strict=True)):
            if len(have) < need:
                continue
            prefix = np.isin(tokens[: len(tokens) - need + 1], have)
            if not prefix.any():
                continue
            ahead = int(prefix.argmax())
            left = len(have) - int(np.searchsorted(have, tokens[ahead]))
            if min(len(tokens) - ahead, left) < need:
                continue
            both = int(np.isin(tokens, have).sum())
            if both >= need:
                found.append((t, b * plan.hop, k, both / len(tokens)))
    return found


def count_tokens(docs: DataFrame, templates: list[tuple[str, str]]) -> dict[int, int]:
    """How often each token of a template occurs in all texts."""
    plan = Plan.of(templates, 1.0, {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(plan.tokens), np.int64)
        for batch in steps(batches):
            codes = Words(*text_bytes(batch.column(1)), parting()).hashes(lower=True)
            _, rank = plan.find(codes)
            total += np.bincount(rank, minlength=len(total))
        kept = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(total[kept])], ["rank", "n"])

    counted = texts(docs).mapInArrow(run, "rank long, n long").groupBy("rank").agg(F.sum("n").alias("n")).collect()
    of_rank = {r["rank"]: r["n"] for r in counted}
    return {int(c.astype(np.int64)): of_rank.get(int(r), 0) for c, r in zip(plan.tokens, plan.rank, strict=True)}


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, share: float = SHARE, base: dict[str, str] | None = None) -> DataFrame:
    """Licenses of every text: places of the base phrases, and labels of the templates that some block contains.

    ``score`` is the highest contained share of a template found, 1 where a base phrase stands, else 0. Null and empty
    texts have no words and no labels; repeated rows are scanned each; extra columns are not looked at.
    """
    templates, base = TEMPLATES if templates is None else templates, PHRASES if base is None else base
    plan = Plan.of(templates, share, count_tokens(docs, templates))
    phrases = [(code(p.split()), label) for p, label in base.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            words = Words(*text_bytes(batch.column(1)), parting())
            codes = words.hashes(lower=True)
            n = batch.num_rows
            base_of, own, score, blocks = [set() for _ in range(n)], [set() for _ in range(n)], np.zeros(n), np.zeros(n, np.int64)
            starts = []
            for phrase, label in phrases:
                m = len(phrase)
                at = np.flatnonzero(codes == phrase[0])
                at = at[at + m <= words.bounds[words.text[at] + 1]]
                for k in range(1, m):
                    at = at[codes[at + k] == phrase[k]]
                starts.append(at)
                for t in words.text[at].tolist():
                    base_of[t].add(label)
                    score[t] = 1.0
            at = np.concatenate(starts) if starts else np.zeros(0, np.int64)
            text = words.text[at]
            place = at - words.bounds[text]
            n_base = np.bincount(text, minlength=n)
            low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            np.minimum.at(low, text, place)
            np.maximum.at(high, text, place)
            for t, _, k, part in matches(words, codes, plan):
                own[t].add(plan.labels[k])
                score[t] = max(score[t], part)
                blocks[t] += 1
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(words.count), pa.array(n_base), pa.array(low, mask=none), pa.array(high, mask=none),
                    pa.array([",".join(sorted(b)) for b in base_of]), pa.array([",".join(sorted(a | b)) for a, b in zip(base_of, own, strict=True)]),
                    pa.array(score), pa.array(blocks),
                ],
                [c.split()[0] for c in COLUMNS.split(", ")],
            )

    return texts(docs).mapInArrow(run, COLUMNS)
