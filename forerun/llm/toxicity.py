"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of its character n-gram vectors, a window of words the mean of its words, and the softmax over that
mean gives the window's probability; a document is as toxic as its worst window, so one insult in a long text counts.
Runs of one word count once, and short windows are padded with zero vectors, so few words never weigh more than many.
Unseen misspellings share n-grams with known words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, table
from .textkernel import SPACE, U, Words, mix, steps

#: Labelled rows of each class that a fit uses at most.
MAX_TRAIN = 2_000
BUCKETS, DIM, GRAMS, WINDOW = 1 << 17, 8, (3, 4, 5), 12
STEPS_NOISY, STEPS_WORST, RATE, DECAY = 60, 160, 0.15, 2e-3
#: Share of the loss that toxic documents have, however rare they are; documents of a class weigh the same.
TOXIC_SHARE = 0.4
CUT = 0.5

#: Word separators: white space and the punctuation of prose; signs that stand in for letters stay inside words.
SEPARATORS = SPACE.copy()
SEPARATORS[list(b".,;:!?\"()[]{}|")] = True


def subwords(words: Words, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, where each picked word's n-grams begin); the words are bracketed, so edges count."""
    start, size = words.start[pick], words.end[pick] - words.start[pick]
    length = size + 2
    first = np.cumsum(length) - length
    total = int(length.sum())
    chars = np.empty(total, dtype=np.uint64)
    inside = np.arange(total) - np.repeat(first, length)
    source = np.repeat(start, length) + inside - 1
    edge_a, edge_b = inside == 0, inside == np.repeat(length, length) - 1
    chars[:] = words.low[np.clip(source, 0, len(words.low) - 1)]
    chars[edge_a], chars[edge_b] = 257, 258
    left = np.repeat(length, length) - inside
    code, owner = [], []
    who = np.repeat(np.arange(len(pick)), length)
    rolling = np.zeros(total, dtype=np.uint64)
    for n in range(1, max(GRAMS) + 1):
        rolling[: total - n + 1] = rolling[: total - n + 1] * U(0x100000001B3) + chars[n - 1 :]
        if n in GRAMS:
            ok = left >= n
            code.append(mix(rolling[ok] + U(n << 56)) >> U(64 - 17))
            owner.append(who[ok])
    bucket, owner = np.concatenate(code).astype(np.int64), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.searchsorted(owner[order], np.arange(len(pick)))


@dataclass
class Model:
    vectors: np.ndarray  # buckets x dim
    weight: np.ndarray  # difference of the two softmax rows
    bias: float

    def gram_scores(self) -> np.ndarray:
        return (self.vectors @ self.weight).astype(np.float64)


def _collapsed(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words that differ from the one before in their document, document offsets among them)."""
    keep = np.ones(len(hashes), dtype=bool)
    keep[1:] = hashes[1:] != hashes[:-1]
    firsts = words.offset[:-1]
    keep[firsts[firsts < len(hashes)]] = True
    return np.flatnonzero(keep), np.concatenate(([0], np.cumsum(keep)))[words.offset]


def _windows(offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, document) of half-overlapping windows; each document with words has one at least."""
    starts, ends, owner = [], [], []
    for d, (a, b) in enumerate(zip(offset[:-1].tolist(), offset[1:].tolist())):
        if b > a:
            s = np.arange(a, max(b - WINDOW // 2, a + 1), WINDOW // 2)
            starts.append(s)
            ends.append(np.minimum(s + WINDOW, b))
            owner.append(np.full(len(s), d))
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(owner)


def fit(texts: list[str | None], y: np.ndarray) -> Model:
    """Full-batch Adagrad, first on all windows with their document's label, then on each document's worst window."""
    rng = np.random.default_rng(7)
    vectors = rng.normal(0, 0.05, (BUCKETS, DIM))
    weight = rng.normal(0, 0.5, DIM)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(rate / (1 - rate)))
    if len(y) == 0 or y.min() == y.max():
        return Model(vectors * 0, weight, bias)
    known: dict[int, int] = {}
    codes, begins, at = [], [], 0
    starts, ends, owner, ids, base = [], [], [], [], 0
    for part in steps(texts):
        words = Words([b for _, b in part], SEPARATORS)
        hashes = words.hashes()
        kept, offset = _collapsed(words, hashes)
        uniq, first, inverse = np.unique(hashes[kept], return_index=True, return_inverse=True)
        first = kept[first]
        fresh = np.array([i for i, u in enumerate(uniq.tolist()) if u not in known], dtype=np.int64)
        if len(fresh):
            b, s = subwords(words, first[fresh])
            codes.append(b.astype(np.int32))
            begins.append(s + at)
            at += len(b)
            known.update(zip(uniq[fresh].tolist(), range(len(known), len(known) + len(fresh))))
        ids.append(np.array([known[u] for u in uniq.tolist()], dtype=np.int32)[inverse])
        s, e, o = _windows(offset)
        starts.append(s + base)
        ends.append(e + base)
        owner.append(np.array([i for i, _ in part])[o])
        base += len(inverse)
    code, begin = np.concatenate(codes), np.concatenate(begins)
    ids, s, e, who = (np.concatenate(z) for z in (ids, starts, ends, owner))
    del codes, begins, starts, ends, owner, known
    grams = np.diff(np.concatenate((begin, [len(code)])))
    n_words = len(begin)
    first_window = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
    docs = who[first_window]
    side = np.where(y == 1, TOXIC_SHARE / y.sum(), (1 - TOXIC_SHARE) / (len(y) - y.sum()))
    grown, g_weight, g_bias = np.full(BUCKETS, 1e-8), np.full(DIM, 1e-8), 1e-8
    for step in range(STEPS_NOISY + STEPS_WORST):
        gram = vectors @ weight
        word = np.add.reduceat(gram[code], begin) / grams
        total = np.concatenate(([0], np.cumsum(word[ids])))
        logit = (total[e] - total[s]) / WINDOW + bias
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        error = np.zeros(len(s))
        if step < STEPS_NOISY:
            error = (p - y[who]) * (side / np.bincount(who, minlength=len(y)))[who]
        else:
            top = np.maximum.reduceat(logit, first_window)
            worst = np.flatnonzero(logit == np.repeat(top, np.diff(np.concatenate((first_window, [len(logit)])))))
            worst = worst[np.concatenate(([True], who[worst][1:] != who[worst][:-1]))]
            error[worst] = (p[worst] - y[docs]) * side[docs]
        part = np.zeros(len(ids) + 1)
        np.add.at(part, s, error / WINDOW)
        np.add.at(part, e, -error / WINDOW)
        d_word = np.bincount(ids, np.cumsum(part)[:-1], n_words) / grams
        d_gram = np.bincount(code, np.repeat(d_word, grams), BUCKETS)
        d_weight = vectors.T @ d_gram
        grown += d_gram**2
        g_weight += d_weight**2
        g_bias += error.sum() ** 2
        vectors -= RATE * (d_gram / np.sqrt(grown))[:, None] * weight + DECAY * vectors
        weight -= RATE * d_weight / np.sqrt(g_weight)
        bias -= RATE * error.sum() / np.sqrt(g_bias)
    return Model(vectors.astype(np.float32), weight, float(bias))


def logits(texts, gram: np.ndarray, bias: float) -> np.ndarray:
    """Each text's worst window; a text without words has the bias alone."""
    texts = list(texts)
    out = np.full(len(texts), bias)
    for part in steps(texts):
        words = Words([b for _, b in part], SEPARATORS)
        if not len(words.start):
            continue
        hashes = words.hashes()
        kept, offset = _collapsed(words, hashes)
        _, first, inverse = np.unique(hashes[kept], return_index=True, return_inverse=True)
        first = kept[first]
        code, begin = subwords(words, first)
        word = np.add.reduceat(gram[code], begin) / np.diff(np.concatenate((begin, [len(code)])))
        total = np.concatenate(([0], np.cumsum(word[inverse])))
        s, e, owner = _windows(offset)
        logit = (total[e] - total[s]) / WINDOW + bias
        edge = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        out[np.array([i for i, _ in part])[owner[edge]]] = np.maximum.reduceat(logit, edge)
    return out


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit on at most about ``max_train`` labelled rows of each class from the learning fold (a documented bound)."""
    rows = labelled_sample(docs, labels, "toxic", max_train).toPandas().sort_values(["doc_id", "text"], na_position="first")
    return fit(rows["text"].tolist(), np.clip(rows["label"].to_numpy(float), 0, 1))


def score(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; texts without words, or null, get the bias alone.

    Repeated rows are scored alike and returned as often, a null doc_id stays null (held_out false), an empty table
    gives no rows, and columns other than doc_id and text are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.gram_scores(), model.bias))  # one number per bucket: 1 MB

    def run(batches):
        gram, bias = held.value
        for batch in batches:
            p = 1 / (1 + np.exp(-np.clip(logits(batch["text"], gram, bias), -500, 500)))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": p})

    scored = docs.select("doc_id", held_out().alias("held_out"), "text").mapInPandas(run, "doc_id long, held_out boolean, score double")
    return scored.selectExpr("doc_id", "held_out", "score", f"cast(score >= {cut} as int) as predicted")


def op9_toxicity_subword(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def kept(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The rows, all columns, that ``score`` predicts as 0: scored in place, without a join."""
    held = docs.sparkSession.sparkContext.broadcast((model.gram_scores(), model.bias))

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-np.clip(logits(text, *held.value), -500, 500))), dtype=float)

    return docs.where(scored("text") < cut)
