"""Toxicity by multiple-instance learning: documents are bags of sentences.

Only documents are labelled. A sentence scores by the hashed words it holds and
their beginnings, of which each adds to it or counts for nothing; a document by the noisy-or of its sentences: it is toxic unless every sentence is
clean. The gradient of the document's likelihood reaches each sentence in
proportion to its own part in it, so the offending ones are found without a
label of their own, and the fitted model names them.

The fit sees at most ``SAMPLE`` labelled documents, whole, a documented bound;
words must occur in ``MIN_DOCS`` of them to count. Every document is scored.

Defined results: null and empty texts have no sentence and score the model's
floor; repeated rows score alike; no labelled toxic row to learn from gives
every document the score 0; other columns are neither read nor changed.
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
SAMPLE = 4_000
MIN_DOCS = 5
#: lengths of the beginnings of words that count beside them
PREFIXES = (3, 5, 7)
BUCKETS = 1 << 20
SEED = 5
STEPS = 150
#: what a weight costs in the fit that selects words, and in the one that weighs them
COSTS = (0.5, 0.02)
LEAST = 0.05

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


def parts_of(word: str) -> list[str]:
    """A word and its beginnings, marked as such: what may speak for toxicity."""
    return [word, *[word[:n] + "-" for n in PREFIXES if n < len(word)]]


def sentences(text: str | None) -> list[tuple[int, int, set[str]]]:
    """``start, stop, words`` of every sentence that has a word; words in lower case."""
    out = []
    for m in _SENTENCE.finditer(text or ""):
        words = set(_WORD.findall(m.group().lower()))
        if words:
            out.append((m.start(), m.end(), words))
    return out


@dataclass
class Model:
    """Weights of the buckets that count, none below zero, and what a sentence without any scores."""

    weights: dict[int, float]
    bias: float

    def scorer(self):
        """``text -> [(start, stop, logit)]`` with the words met so far kept, a bounded number."""
        kept: dict[str, float] = {}

        def weight(word: str) -> float:
            value = sum(self.weights.get(bucket(p), 0.0) for p in parts_of(word))
            if len(kept) < 500_000:
                kept[word] = value
            return value

        def of(text: str | None) -> list[tuple[int, int, float]]:
            result = []
            for start, stop, words in sentences(text):
                z = self.bias
                for w in words:
                    v = kept.get(w)
                    z += weight(w) if v is None else v
                result.append((start, stop, z))
            return result

        return of


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def noisy_or(logits: np.ndarray) -> float:
    """One less the chance that every sentence is clean."""
    return float(-np.expm1(-_softplus(logits).sum())) if len(logits) else 0.0


def _descend(word, at, document, labels, w, bias: float, cost: float, steps: int):
    """Adam on the documents' likelihood; weights stay at zero or above."""
    n_words, n_sentences, n_docs = len(w), len(document), len(labels)
    m, v, mb, vb = np.zeros(n_words), np.zeros(n_words), 0.0, 0.0
    for step in range(1, steps + 1):
        z = bias + np.bincount(at, weights=w[word], minlength=n_sentences)
        total = np.bincount(document, weights=_softplus(z), minlength=n_docs)
        # d(-log likelihood)/d(total): 1 for clean documents, -1/(e^total - 1) for toxic ones
        pull = np.where(labels == 1, -1 / np.expm1(np.clip(total, 1e-6, 50)), 1.0)
        g = pull[document] * (0.5 * (1 + np.tanh(0.5 * z)))
        # a weight costs its size, so words that explain little go to zero
        gw = np.bincount(word, weights=g[at], minlength=n_words) + cost
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, b = 1 - 0.9**step, 1 - 0.99**step
        rate = 0.4 * (1 - step / (steps + 1)) + 0.01
        w = np.maximum(w - rate * (m / a) / (np.sqrt(v / b) + 1e-6), 0.0)
        bias -= 0.3 * rate * (mb / a) / (np.sqrt(vb / b) + 1e-6)
    return w, bias


def fit_model(
    ids: np.ndarray, sentence: np.ndarray, document: np.ndarray, labels: np.ndarray, steps: int = STEPS
) -> Model:
    """Weights from word ``ids`` with their sentence, each sentence's document, and its label.

    A dear fit selects the words that explain something, a cheap one weighs them.
    """
    order, inverse = np.unique(ids, return_inverse=True)
    # documents of a word: each pair counted once
    pairs = inverse * np.int64(len(labels)) + document[sentence]
    pairs = np.unique(pairs) // len(labels)
    use = np.bincount(pairs, minlength=len(order)) >= min(MIN_DOCS, max(2, len(labels) // 20))
    del pairs
    w, bias = np.zeros(len(order)), -6.0
    for cost in COSTS:
        place = np.cumsum(use) - 1
        kept = use[inverse]
        word, at = place[inverse[kept]].astype(np.int32), sentence[kept].astype(np.int32)
        own, bias = _descend(word, at, document, labels, w[use], bias, cost, steps)
        w = np.zeros(len(order))
        w[use] = own
        use = w > LEAST
    return Model({int(k): float(x) for k, x in zip(order[use], w[use])}, float(bias))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    size: int = SAMPLE,
    seed: int = SEED,
) -> Model | None:
    """Fits on at most ``size`` documents with a label of 0 or 1."""
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).where("y IN (0, 1)")
    picked = sample_keys(known, "key", size, seed).join(known, "key").groupBy("key").agg(F.max("y").alias("y"))

    @F.pandas_udf("struct<ids:binary,lengths:binary>")
    def bag(texts: pd.Series) -> pd.DataFrame:
        ids, lengths = [], []
        for t in texts:
            found = [sorted({bucket(p) for w in words for p in parts_of(w)}) for _, _, words in sentences(t)]
            lengths.append(np.array([len(f) for f in found], dtype="<i4").tobytes())
            ids.append(np.array([i for f in found for i in f], dtype="<i4").tobytes())
        return pd.DataFrame({"ids": ids, "lengths": lengths})

    rows = sampled_texts(docs, key, text, picked).select("key", "y", bag("text").alias("b"))
    rows = rows.select("key", "y", "b.ids", "b.lengths").toPandas().sort_values("key")
    if rows.empty or not rows["y"].any():
        return None
    lengths = [np.frombuffer(b, dtype="<i4") for b in rows["lengths"]]
    ids = np.concatenate([np.frombuffer(b, dtype="<i4") for b in rows["ids"]])
    document = np.repeat(np.arange(len(rows)), [len(x) for x in lengths])
    sentence = np.repeat(np.arange(len(document)), np.concatenate(lengths))
    return fit_model(ids, sentence, document, rows["y"].to_numpy())


def score(text: Column, model: Model | None, cut: float = 0.5) -> Column:
    """``struct<score, sentences>``: the document's noisy-or, and where sentences reach ``cut``."""

    @F.pandas_udf("struct<score:double,sentences:array<struct<start:int,stop:int,score:double>>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scored = model.scorer() if model else None
        for texts in batches:
            scores, places = [], []
            for t in texts:
                found = scored(t) if scored else []
                z = np.array([x for _, _, x in found])
                p = 0.5 * (1 + np.tanh(0.5 * z))
                scores.append(noisy_or(z))
                places.append([(a, b, float(x)) for (a, b, _), x in zip(found, p) if x >= cut])
            yield pd.DataFrame({"score": scores, "sentences": places})

    return of(text)
