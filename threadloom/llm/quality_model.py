"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a small network under the
non-negative unbiased risk: the risk of the negatives is the unlabelled risk
less the positives' share in it, and where that estimate turns negative the
step goes the other way, so the network cannot fit the unlabelled rows by
heart. The class prior is estimated from the same two samples: the unlabelled
rows hold positives at most in the ratio of the two tail masses, at the score
from which on that ratio is least.

Features are counts and ratios over the whole text, made in Arrow batches; the
fit sees at most ``POSITIVES`` and ``UNLABELLED`` rows, documented bounds; every
document is scored.

Defined results: null and empty texts are scored as the empty text; repeated
rows get equal scores; no positives to learn from give every document the score
0.5; other columns are neither read nor changed.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.labelled import sample_keys, sampled_texts

#: bounds of the training sample
POSITIVES = 8_000
UNLABELLED = 12_000
SEED = 11
HIDDEN = 24
STEPS = 1200
BATCH = 512

_WORDY = re.compile(r"[^\W_]")
_ODD = re.compile(r"[^\w\s.,;:'\"()-]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"[0-9]")
_SENTENCE = re.compile(r"[.!?\n]+")

FEATURES = (
    "words", "mean_word", "longest_word", "odd", "upper", "digit", "distinct", "stutter", "no_letters",
    "odd_end", "sentences", "same_sentences", "repeated_fours", "squeezed", "lines", "same_lines", "title",
)


def features_of(text: str | None) -> list[float]:
    """Counts and ratios over one whole text, in the order of ``FEATURES``."""
    text = text or ""
    words = text.split()
    n = max(len(words), 1)
    chars = max(sum(map(len, words)), 1)
    sentences = [s for s in map(str.strip, _SENTENCE.split(text)) if s]
    lines = [s for s in text.split("\n") if s.strip()]
    hashes = list(map(hash, words))
    fours = [a * 3 + b * 5 + c * 7 + d * 11 for a, b, c, d in zip(hashes, hashes[1:], hashes[2:], hashes[3:])]
    raw = text.encode()
    ends = "".join([w[-1] for w in words])
    return [
        np.log1p(len(words)),
        chars / n,
        np.log1p(max(map(len, words), default=0)),
        len(_ODD.findall(text)) / n,
        len(_UPPER.findall(text)) / chars,
        len(_DIGIT.findall(text)) / chars,
        np.log(len(set(words)) / n + 1e-3) / np.log(n + 2),
        sum(map(str.__eq__, words, words[1:])) / n,
        sum(not _WORDY.search(w) for w in words) / n,
        len(_ODD.findall(ends)) / n,
        len(sentences) / n,
        1 - len(set(sentences)) / max(len(sentences), 1),
        1 - len(set(fours)) / max(len(fours), 1),
        len(zlib.compress(raw, 1)) / max(len(raw), 64),
        len(lines) / n,
        1 - len(set(lines)) / max(len(lines), 1),
        sum(map(str.istitle, words)) / n,
    ]


def features(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[float(v) for v in features_of(t)] for t in texts], dtype=object)

    return of(text)


@dataclass
class Network:
    """Rank-scaled features, one hidden layer, one output."""

    grid: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def scaled(self, x: np.ndarray) -> np.ndarray:
        levels = np.linspace(-1, 1, self.grid.shape[1])
        return np.stack([np.interp(x[:, j], g, levels) for j, g in enumerate(self.grid)], axis=1)

    def logit(self, scaled: np.ndarray) -> np.ndarray:
        return np.tanh(scaled @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logit(self.scaled(x)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The least ratio of the tail masses of two samples of scores.

    A tail holds positives in the same share of all positives in both samples,
    so the unlabelled tail's mass bounds the prior from above. Each mass is
    taken with its sampling error, which keeps tiny tails from deciding.
    """
    at = np.quantile(positive, np.linspace(0.02, 0.9, 60))
    p = np.array([(positive >= t).mean() for t in at])
    u = np.array([(unlabelled >= t).mean() for t in at])
    error = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    best = int(np.argmin((u + error) / np.maximum(p, 1e-9)))
    return float(np.clip(u[best] / max(p[best], 1e-9), 0.05, 0.98))


def _train(pos: np.ndarray, unl: np.ndarray, prior: float | None, rng, steps: int, net: Network) -> None:
    """Adam steps on ``net``; with a prior the non-negative risk, without one plain P against U."""
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        xp = pos[rng.integers(0, len(pos), BATCH)]
        xu = unl[rng.integers(0, len(unl), BATCH)]
        x = np.concatenate([xp, xu])
        h = np.tanh(x @ params[0] + params[1])
        s = _sigmoid(h @ params[2] + params[3][0])
        sp, su = s[:BATCH], s[BATCH:]
        # logistic losses: -log s towards positive, -log(1 - s) towards negative
        if prior is None:
            grad = np.concatenate([sp - 1, su]) / BATCH
        else:
            negative = -np.log(1 - su + 1e-9).mean() + prior * np.log(1 - sp + 1e-9).mean()
            if negative >= 0:
                grad = np.concatenate([prior * (sp - 1) - prior * sp, su]) / BATCH
            else:
                grad = -np.concatenate([-prior * sp, su]) / BATCH
        dh = np.outer(grad, params[2]) * (1 - h * h)
        grads = [x.T @ dh, dh.sum(axis=0), h.T @ grad, np.array([grad.sum()])]
        rate = 0.01 * (1 - step / (steps + 1)) + 1e-4
        for i, g in enumerate(grads):
            g = g + 1e-4 * params[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            move = first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
            params[i] -= rate * move
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])


def _new(grid: np.ndarray, rng) -> Network:
    d = len(grid)
    return Network(grid, rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0, 0.5)


def fit_network(positive: np.ndarray, unlabelled: np.ndarray, seed: int = SEED, steps: int = STEPS) -> Network:
    """Prior and network from feature rows of trusted positives and of unlabelled texts."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    grid = np.quantile(both, np.linspace(0, 1, 33), axis=0).T
    grid = np.maximum.accumulate(grid, axis=1) + np.arange(33) * 1e-9
    net = _new(grid, rng)
    pos = rng.permutation(net.scaled(positive))
    unl = rng.permutation(net.scaled(unlabelled))
    # the prior comes from a plain P-against-U network, judged on halves it has not seen
    half_p, half_u = len(pos) // 2, len(unl) // 2
    if half_p and half_u:
        _train(pos[:half_p], unl[:half_u], None, rng, steps // 2, net)
        prior = estimate_prior(net.logit(pos[half_p:]), net.logit(unl[half_u:]))
    else:
        prior = 0.5
    net = _new(grid, rng)
    _train(pos, unl, prior, rng, steps, net)
    net.prior = prior
    return net


def fit(
    docs: DataFrame,
    positives: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    max_positives: int = POSITIVES,
    max_unlabelled: int = UNLABELLED,
    seed: int = SEED,
) -> Network | None:
    """Fits on at most so many documents named in ``positives`` and so many of any kind."""
    trusted = sample_keys(positives, key, max_positives, seed).withColumn("p", F.lit(True))
    any_kind = sample_keys(docs, key, max_unlabelled, seed + 1).withColumn("u", F.lit(True))
    roles = trusted.join(any_kind, "key", "full")  # bounded by the two sample sizes
    picked = sampled_texts(docs, key, text, roles).select("key", "p", "u", features(F.col("text")).alias("x"))
    rows = picked.toPandas().sort_values("key")
    if rows.empty or not rows["p"].any():
        return None
    x = np.array(rows["x"].tolist())
    return fit_network(x[rows["p"].eq(True).to_numpy()], x[rows["u"].eq(True).to_numpy()], seed)


def score(text: Column, net: Network | None) -> Column:
    """The probability of good quality of every text in a column."""

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            if net is None or texts.empty:
                yield pd.Series(np.full(len(texts), 0.5))
            else:
                yield pd.Series(net.probability(np.array([features_of(t) for t in texts], dtype=float)))

    return of(text)
