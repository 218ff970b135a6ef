"""Quality classifier: histogram gradient-boosted trees over document statistics, scored by vectorised traversal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, table
from .textkernel import Words, steps

#: Labelled rows of each class that a fit uses at most.
MAX_TRAIN = 12_000
ROUNDS, DEPTH, BINS, RATE, LEAST_LEAF, L2 = 60, 4, 64, 0.15, 8, 1.0
CUT = 0.3

_CLASSES = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "high": range(128, 256), "space": (32, 9, 11, 12, 13),
    "newline": (10,), "stop": b".,;:?'\"()-", "shout": b"!", "pipe": b"|", "mark": b"#$%&*", "other": b"+/<=>@[\\]^_`{}~",
}
_CODE = np.full(256, len(_CLASSES), dtype=np.uint8)
for _i, _members in enumerate(_CLASSES.values()):
    _CODE[list(_members)] = _i

FEATURES = [*_CLASSES, "n_bytes", "n_words", "mean_word", "spread_word", "long_words", "short_words", "distinct", "adjacent", "skip", "one_word_max", "lines", "line_words", "repeated_lines", "caps_words", "marked_ends"]


def features(texts) -> np.ndarray:
    """One row of document statistics per text (null: empty); every ratio of an empty text is 0."""
    texts = list(texts)
    out = np.zeros((len(texts), len(FEATURES)))
    k = len(_CLASSES)
    for part in steps(texts):
        raws = [b for _, b in part]
        words = Words(raws)
        h = words.hashes()
        code = _CODE[words.buffer]
        upper = np.concatenate(([0], np.cumsum(code == 1)))
        ends = words.doc_end
        size = (words.end - words.start).astype(np.float64)
        caps = (upper[words.end] - upper[words.start]) * 2 > size
        last = _CODE[words.buffer[np.maximum(words.end - 1, 0)]]
        marked = (last == 7) | (last == 9)
        begin = 0
        for j, (i, raw) in enumerate(part):
            n = len(raw)
            count = np.bincount(code[begin : begin + n], minlength=k + 1)[:k]
            begin = int(ends[j])
            a, b = int(words.offset[j]), int(words.offset[j + 1])
            m = b - a
            row = out[i]
            row[:k] = count / max(n, 1)
            row[k], row[k + 1] = np.log1p(n), np.log1p(m)
            if not m:
                continue
            w, s = h[a:b], size[a:b]
            ordered = np.sort(w)
            edge = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True])))
            lines = raw.split(b"\n")
            full = [x for x in lines if x.strip()]
            row[k + 2 :] = (
                s.mean(), s.std(), (s > 14).mean(), (s < 3).mean(), (len(edge) - 1) / m, (w[1:] == w[:-1]).mean() if m > 1 else 0, (w[2:] == w[:-2]).mean() if m > 2 else 0,
                np.diff(edge).max() / m, np.log1p(len(full)), m / max(len(full), 1), 1 - len(set(full)) / max(len(full), 1), caps[a:b].mean(), marked[a:b].mean(),
            )
    return out


@dataclass
class Forest:
    """Complete binary trees in flat arrays: node i has the children 2i+1 and 2i+2; leaves repeat their parent's split."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    value: np.ndarray  # trees x leaves
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, c, v in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(inner.bit_length()):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            total += v[node - inner]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Logistic boosting by histograms of gradients; without rows, or with one class, a constant."""
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    if len(y) == 0 or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    edges = [np.unique(np.quantile(col, np.linspace(0, 1, BINS + 1)[1:-1])) for col in x.T]
    binned = np.stack([np.searchsorted(e, col, side="left") for e, col in zip(edges, x.T)])
    margin = np.full(len(y), base)
    made = []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), dtype=np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for depth in range(DEPTH):
            first, width = (1 << depth) - 1, 1 << depth
            local = node - first
            best = np.full(width, 1e-9)
            pick = np.full((width, 2), -1)
            for f, b in enumerate(binned):
                key = local * BINS + b
                g, hs, n = (np.bincount(key, w, width * BINS).reshape(width, BINS) for w in (grad, hess, None))
                gl, hl, nl = g.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1], n.cumsum(1)[:, :-1]
                gt, ht, nt = g.sum(1, keepdims=True), hs.sum(1, keepdims=True), n.sum(1, keepdims=True)
                gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
                gain[(nl < LEAST_LEAF) | (nt - nl < LEAST_LEAF)] = 0
                gain[:, len(edges[f]) :] = 0
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better] = top[better]
                pick[better] = np.stack((np.full(width, f), at), 1)[better]
            for j, (f, b) in enumerate(pick):
                if f >= 0:
                    feature[first + j], cut[first + j] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + L2)
        margin += value[leaf]
        made.append((feature, cut, value))
    return Forest(*(np.stack(z) for z in zip(*made)), base)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Forest:
    """Fit on at most about ``max_train`` labelled rows of each class from the learning fold (a documented bound)."""
    sample = labelled_sample(docs, labels, "quality", max_train)

    def run(batches):
        for batch in batches:
            frame = pd.DataFrame({"doc_id": batch["doc_id"], "x": list(features(batch["text"])), "y": batch["label"].to_numpy(float)})
            yield frame

    rows = sample.mapInPandas(run, "doc_id long, x array<double>, y double").toPandas()
    # the same model whatever the order in which tasks answer
    rows = rows.assign(key=rows["x"].map(tuple)).sort_values(["doc_id", "key"])
    x = np.array(rows["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return fit(x, np.clip(rows["y"].to_numpy(float), 0, 1))


def score(docs: DataFrame, model: Forest, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; null and empty texts are scored as empty documents.

    Repeated rows are scored alike and returned as often, a null doc_id stays null (held_out false), an empty table
    gives no rows, and columns other than doc_id and text are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers, whatever the input

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": held.value.score(features(batch["text"]))})

    scored = docs.select("doc_id", held_out().alias("held_out"), "text").mapInPandas(run, "doc_id long, held_out boolean, score double")
    return scored.selectExpr("doc_id", "held_out", "score", f"cast(score >= {cut} as int) as predicted")


def op1_quality_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def kept(docs: DataFrame, model: Forest, cut: float = CUT) -> DataFrame:
    """The rows, all columns, that ``score`` predicts as 1: scored in place, without a join."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series(held.value.score(features(text)), dtype=float)

    return docs.where(scored("text") >= cut)
