"""Reading band of each document (problem 9).

Method: a linear pairwise ranker learned from pairs of rated documents of different bands, on vocabulary features
(share of each word of the rated sample) and syntax features (sentence length, word length, commas); isotonic
regression of the ratings on the scores gives the scores where a band begins. As the features are shares, the same
weights score a single sentence; the sentences of a document vote for its band.

The ranker is fitted on a bounded sample of rated documents (SAMPLE of them, by hash of the id) in the driver;
every document is scored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import Folding, word_part

BANDS = ("basic", "middle", "advanced")
#: Rated documents that the ranker is fitted on, at most.
SAMPLE = 4000
#: Pairs of rated documents drawn from the sample.
PAIRS = 60_000
#: Parts of the sample, each scored by a ranker fitted on the others for the calibration.
FOLDS = 3
#: Documents of the sample in which a word must stand to be a feature.
LEAST_DOCS = 5
#: Words of a document from which a band is given.
LEAST_WORDS = 40
#: Words of a sentence that votes, and the power of its length by which it does.
LEAST_SENTENCE, VOTE_POWER = 5, 0.3
#: Scale of the word shares against the syntax features.
WORD_SCALE = 20.0
_SYNTAX = 3
# What ends a sentence, and what parts its clauses.
_ENDS, _COMMAS = frozenset(".!?\n。！？।॥։؟"), frozenset(",;:，、；：،؛")


def _token_part(c: str) -> str:
    return "." if c in _ENDS else " , " if c in _COMMAS else word_part(c)


_TOKENS = Folding(_token_part)


def sentences(text: str) -> list[list[str]]:
    """The sentences of a text as folded words of any script; commas are words of their own."""
    return [s for s in map(str.split, text.translate(_TOKENS).split(".")) if len(s) >= 3]


def _syntax(words: list[str]) -> tuple[float, float, float]:
    n = len(words)
    return n / 30, sum(map(len, words)) / n / 5, words.count(",") / 2


@dataclass
class Ranker:
    """Weights of words and of syntax features, and the scores where the middle and the advanced band begin."""

    words: dict[str, float]
    syntax: tuple[float, ...]
    starts: tuple[float, float]

    def score(self, words: list[str]) -> float:
        get = self.words.get
        s = sum([get(w, 0.0) for w in words]) / len(words)
        for a, b in zip(self.syntax, _syntax(words), strict=True):
            s += a * b
        return s

    def band(self, text: str) -> str:
        """The band in which the text mainly stands; of equal ones the lower.

        Each sentence votes, a long one somewhat more. Headings, numbers and lines of tables (few words, or a third of them
        digits) vote only if there is nothing else; where no sentence has three words, the text is judged as one.
        """
        for least, plain in ((LEAST_SENTENCE, True), (3, False)):
            votes = [0.0, 0.0, 0.0]
            for words in sentences(text):
                if len(words) < least or (plain and 3 * sum(w.isdigit() for w in words) >= len(words)):
                    continue
                s = self.score(words)
                votes[(s > self.starts[0]) + (s > self.starts[1])] += len(words) ** VOTE_POWER
            if any(votes):
                return BANDS[votes.index(max(votes))]
        s = self.score(text.translate(_TOKENS).replace(".", " ").split() or ["-"])
        return BANDS[(s > self.starts[0]) + (s > self.starts[1])]


def isotonic(scores: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted scores and the non-decreasing fit of the levels (pool adjacent violators)."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []
    for v in levels[order].tolist():
        blocks.append([v, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v1, n1 = blocks.pop()
            v0, n0 = blocks[-1]
            blocks[-1] = [(v0 * n0 + v1 * n1) / (n0 + n1), n0 + n1]
    return scores[order], np.repeat([b[0] for b in blocks], [int(b[1]) for b in blocks])


def _rank(x: np.ndarray, y: np.ndarray, pairs: int, steps: int, seed: int) -> np.ndarray:
    """Weights that put the higher of two documents higher, for pairs drawn at random."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, len(y), pairs * 2), rng.integers(0, len(y), pairs * 2)
    ranked = np.flatnonzero(np.abs(y[a] - y[b]) >= 0.5)[:pairs]
    a, b = a[ranked], b[ranked]
    weights = np.zeros(x.shape[1], np.float32)
    m, s = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, steps + 1 if len(a) else 1):  # logistic loss of the pairs, by Adam
        k = rng.integers(0, len(a), 1000)
        diff = (x[a[k]] - x[b[k]]) * np.sign(y[a[k]] - y[b[k]])[:, None]
        miss = 1 / (1 + np.exp(np.clip(diff @ weights, -30, 30)))
        grad = 1e-3 * weights - (diff * miss[:, None]).mean(0)
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad * grad
        weights -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return weights


def fit(texts: list[str], levels: list[float], pairs: int = PAIRS, steps: int = 250, seed: int = 7) -> Ranker:
    """Fit the ranker on rated texts (level 0 to 2)."""
    docs = [[w for s in sentences(t) for w in s] or ["-"] for t in texts]
    sent = [sentences(t) or [["-"] * 3] for t in texts]
    seen = Counter(w for d in docs for w in set(d) if not w.isdigit())
    vocabulary = {w: k for k, w in enumerate(w for w, c in sorted(seen.items()) if c >= LEAST_DOCS)}
    v = len(vocabulary)
    x = np.zeros((len(docs), v + _SYNTAX), np.float32)
    for row, d, ss in zip(x, docs, sent, strict=True):
        for w, c in Counter(d).items():
            if (k := vocabulary.get(w)) is not None:
                row[k] = c / len(d) * WORD_SCALE
        n = sum(map(len, ss))
        for s in ss:
            row[v:] += np.array(_syntax(s), np.float32) * (len(s) / n)
    y = np.array(levels, np.float32)
    weights = _rank(x, y, pairs, steps, seed)
    # The calibration sees scores that its own documents had no part in.
    held_out = np.zeros(len(y), np.float32)
    fold = np.random.default_rng(seed).permutation(len(y)) % FOLDS
    for k in range(FOLDS):
        rest = fold != k
        held_out[~rest] = x[~rest] @ (_rank(x[rest], y[rest], pairs, steps, seed + 1 + k) if rest.any() else weights)
    scores, curve = isotonic(held_out, y)

    # Linear between the middles of the steps of the calibration.
    steps_at, first, count = np.unique(curve, return_index=True, return_counts=True)
    middle = np.array([scores[f : f + c].mean() for f, c in zip(first, count, strict=True)])

    def start(level: float) -> float:
        return float("inf") if level > steps_at[-1] else float(np.interp(level, steps_at, middle))

    words = {w: float(weights[k]) * WORD_SCALE for w, k in vocabulary.items()}
    return Ranker(words, tuple(float(z) for z in weights[v:]), (start(0.5), start(1.5)))


def rated_sample(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[str], list[float]]:
    """Texts and mean levels of at most `sample` rated documents of enough words, chosen by a hash of their id.

    Repeated ratings count once; ratings without a known band don't count.
    """
    level = F.element_at(F.create_map(*[F.lit(x) for k, b in enumerate(BANDS) for x in (b, float(k))]), F.col("band"))
    chosen = (
        labels.where(F.col("band").isin(*BANDS) & F.col("doc_id").isNotNull())
        .select("doc_id", "band", "rater").distinct()
        .groupBy("doc_id").agg(F.avg(level).alias("level"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = (
        documents.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        .where(F.size(F.split(F.trim("text"), "\\s+")) >= LEAST_WORDS)
        .orderBy("doc_id", "text").collect()
    )
    return [r["text"] for r in rows], [r["level"] for r in rows]


def bands(documents: DataFrame, ranker: Ranker, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, words, band) of every document with at least least_words whitespace-separated words.

    Null, empty and shorter texts give no row; texts that repeat give a row each.
    """
    shared = documents.sparkSession.sparkContext.broadcast(ranker)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank = shared.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                n = len(text.split())
                if n >= least_words:
                    rows.append((doc_id, n, rank.band(text)))
            yield pd.DataFrame(rows, columns=["doc_id", "words", "band"])

    return documents.where("text is not null and doc_id is not null").select("doc_id", "text").mapInPandas(judge, "doc_id bigint, words int, band string")
