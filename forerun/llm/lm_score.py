"""LM scoring by masked pseudo-likelihood: a bidirectional window network predicts every word from both sides.

The network sees the vectors of the words around a gap and makes a vector of what is expected there; each word has an
output vector, and P(word | both sides) = p(word) exp(expected . output) / Z, a softmax over the whole vocabulary with
the corpus shares p as its prior. p comes from exact counts of every word of every document, a table that grows with the
corpus: the most frequent words' counts go to the workers, all others are joined. Z is the exact sum over every word of
the vocabulary: a word's output vector is the sum of two of ``OUT`` rows, so words fall into OUT x OUT cells, and the
cells' exact shares C give Z = e' C e with e the exponentials of the expected vector's products with the rows. A
document's score is the sum of the logarithms of its words' conditional probabilities.

The fit covers every window of every document, too. Documents are dealt by hash into blocks, each block trains from the
round's weights, and the blocks' weights are averaged in whole numbers, so the model does not depend on how the input is
partitioned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialise, table
from .textkernel import U, Words, steps

#: Words on each side; rows of the table of input vectors and of that of output vectors, which words share by hash (an
#: output vector is the sum of two rows); their length; hidden units.
SIDE, ROWS, OUT, DIM, HIDDEN = 2, 4096, 64, 16, 24
#: Windows of a training step, negatives that a step shares, step sizes of vectors and of layers, words of a block,
#: rounds (each trains on its share of the blocks).
BATCH, NEGATIVES, RATE, LAYER_RATE, BLOCK_WORDS, ROUNDS = 4096, 48, 0.05, 0.01, 1 << 20, 2
#: Words whose counts go to the workers (those of the most frequent, 2 MB); the others' counts are joined.
KNOWN = 1 << 17
#: Windows of a scoring step, words counted together before their counts go to the shuffle.
SCORE_BATCH, COUNT_STEP = 1 << 14, 1 << 21
#: Weights are averaged as whole numbers of this grain; a block weighs its words in units of WEIGHT.
GRAIN, WEIGHT = 1 << 16, 1 << 10

Params = list[np.ndarray]
_SHAPES = ((ROWS, DIM), (2 * SIDE * DIM, HIDDEN), (HIDDEN,), (HIDDEN, DIM), (OUT, DIM))


def words_of(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit word hashes, document offsets): words between white space, A-Z in lower case."""
    words = Words(raws)
    return words.hashes(), words.offset


def short(words: np.ndarray) -> np.ndarray:
    """The 32 bits of a word that choose its rows."""
    return (words >> U(32)).astype(np.uint32)


def initial() -> np.ndarray:
    rng = np.random.default_rng(11)
    scale = (0.3, (2 * SIDE * DIM) ** -0.5, 0, HIDDEN**-0.5, 0.1)
    return np.concatenate([rng.normal(0, 1, s).ravel() * k for s, k in zip(_SHAPES, scale)]).astype(np.float32)


def unpack(flat: np.ndarray) -> Params:
    """The tables, that of output vectors repeated to ``ROWS`` rows: row r is row r mod ``OUT``."""
    *others, out = views(flat)
    return [*others, np.tile(out, (ROWS // OUT, 1))]


def views(flat: np.ndarray) -> Params:
    out, at = [], 0
    for s in _SHAPES:
        n = int(np.prod(s))
        out.append(flat[at : at + n].reshape(s))
        at += n
    return out


def contexts(ids: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """(words x 2*SIDE) input rows of the neighbours of each word; row 0 stands for beyond the document's edge."""
    owner = np.repeat(np.arange(len(offset) - 1), np.diff(offset))
    inputs = (1 + (ids >> 20) % (ROWS - 1)).astype(np.int32)
    out = np.zeros((len(ids), 2 * SIDE), dtype=np.int32)
    for j, shift in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        n = len(ids) - abs(shift)
        if n <= 0:
            continue
        here, there = (slice(-shift, None), slice(0, n)) if shift < 0 else (slice(0, n), slice(shift, None))
        out[here, j] = np.where(owner[here] == owner[there], inputs[there], 0)
    return out


def output_rows(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (ids & (OUT - 1)).astype(np.int32), ((ids >> 12) & (OUT - 1)).astype(np.int32)


def outputs(params: Params, ids: np.ndarray) -> np.ndarray:
    a, b = output_rows(ids)
    return np.take(params[4], a, axis=0) + np.take(params[4], b, axis=0)


def forward(params: Params, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, hidden units, expected vectors)."""
    vectors, w1, b1, w2, _ = params
    x = np.take(vectors, context, axis=0).reshape(len(context), -1)
    h = np.tanh(x @ w1 + b1)
    return x, h, h @ w2


def _scatter(matrix: np.ndarray, grown: np.ndarray, rows: np.ndarray, change: np.ndarray) -> None:
    """One Adagrad step on the rows met; ``grown`` has each row's mean squared gradients so far."""
    by = np.argsort(rows.astype(np.uint16), kind="stable")  # a radix sort
    ordered = rows[by]
    edge = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    met, total = ordered[edge], np.add.reduceat(np.take(change, by, axis=0), edge)
    grown[met] += (total * total).mean(1)
    matrix[met] -= np.float32(RATE) * total / np.sqrt(grown[met])[:, None]


def learn(flat: np.ndarray, ids: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """The weights after one pass of Adagrad over all windows: tell each word from words drawn at random."""
    params = views(flat.copy())
    vectors, w1, b1, w2, out = params
    grown = [np.full(len(p) if p is vectors or p is out else p.shape, 1e-6, dtype=np.float32) for p in params]
    context = contexts(ids, offset)
    rng = np.random.default_rng(len(ids))
    order = rng.permutation(len(ids))
    for a in range(0, len(ids), BATCH):
        pick = order[a : a + BATCH]
        target, drawn = ids[pick], ids[rng.integers(len(ids), size=NEGATIVES)]
        x, h, g = forward(params, context[pick])
        o, on = outputs(params, target), outputs(params, drawn)
        mine, others = np.einsum("ij,ij->i", g, o), g @ on.T
        top = np.maximum(mine, others.max(1))
        mine, others = np.exp(mine - top), np.exp(others - top[:, None])
        total = mine + others.sum(1)
        mine, others = (mine / total - 1)[:, None], others / total[:, None]
        dg = mine * o + others @ on
        dh = (dg @ w2.T) * (1 - h * h)
        changes = np.concatenate((mine * g, others.T @ g))
        for p, k, change in ((w1, grown[1], x.T @ dh), (b1, grown[2], dh.sum(0)), (w2, grown[3], h.T @ dg)):
            k += change * change
            p -= np.float32(LAYER_RATE) * change / np.sqrt(k)
        _scatter(vectors, grown[0], context[pick].ravel(), (dh @ w1.T).reshape(-1, DIM))
        for rows in output_rows(np.concatenate((target, drawn))):
            _scatter(out, grown[4], rows, changes)
    return np.concatenate([p.ravel() for p in params])


@dataclass
class Model:
    flat: np.ndarray
    total: int  # words of the corpus
    known: np.ndarray  # sorted hashes of the most frequent words
    counts: np.ndarray
    z_words: np.ndarray  # a word of each cell of Z, and the shares of all its words
    z_weights: np.ndarray


def _raws(batches):
    for batch in batches:
        for part in steps(batch["text"]):
            yield [b for _, b in part]


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): the 64-bit hash and the exact count of every word of all documents, written to the shared folder."""

    def run(batches):
        held, size = [], 0

        def counted():
            word, n = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"word": word.view(np.int64), "n": n})

        for raws in _raws(batches):
            held.append(words_of(raws)[0])
            size += len(held[-1])
            if size >= COUNT_STEP:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()

    bounded_batches(docs.sparkSession)
    return materialise(docs.select("text").mapInPandas(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def shares(counts: DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(total, known words, their counts, a word of each cell of Z, the cells' shares); at most ``KNOWN`` words come to the driver."""
    levels = counts.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).orderBy(F.desc("level")).collect()  # a few hundred
    total, words, least = sum(r["n"] for r in levels), 0, 0
    for r in levels:
        words += r["words"]
        if words > KNOWN:
            least = r["level"] + 1
            break
    frame = counts.where(F.floor(F.log2("n") * 8) >= least).toPandas()
    word, n = frame["word"].to_numpy(np.int64).view(np.uint64), frame["n"].to_numpy(np.int64)
    order = np.argsort(word)
    word, n = word[order], n[order]
    # every word is in a cell, at most OUT x OUT of them
    high = F.shiftrightunsigned("word", 32)
    cell = [high.bitwiseAND(F.lit(OUT - 1)), F.shiftright(high, 12).bitwiseAND(F.lit(OUT - 1))]
    cells = counts.groupBy(*cell).agg(F.min("word").alias("word"), F.sum("n").alias("n")).select("word", "n").orderBy("word").toPandas()
    return total, word, n, cells["word"].to_numpy(np.int64).view(np.uint64), cells["n"].to_numpy(float) / max(total, 1)


def blocks(docs: DataFrame, total: int) -> DataFrame:
    """(number, ids, sizes): the documents' words in blocks of about ``BLOCK_WORDS``, dealt and ordered by hash."""
    key = F.xxhash64("doc_id", "text")

    def shortened(batches):
        for batch in batches:
            for part in steps(batch["text"]):
                words, offset = words_of([b for _, b in part])
                ids = short(words)
                names = batch["key"].iloc[[i for i, _ in part]]
                yield pd.DataFrame({"key": names.to_numpy(), "ids": [ids[a:b].tobytes() for a, b in zip(offset[:-1].tolist(), offset[1:].tolist())]})

    def joined(batches):
        held, size, number = [], 0, 0

        def block():
            return pd.DataFrame({"number": [number], "ids": [b"".join(held)], "sizes": [np.array([len(x) // 4 for x in held], np.int64).tobytes()]})

        for batch in batches:
            for ids in batch["ids"]:
                if size and size + len(ids) // 4 > BLOCK_WORDS:
                    yield block()
                    held, size, number = [], 0, number + 1
                held.append(ids)
                size += len(ids) // 4
        if size:
            yield block()

    shards = max(1, -(-total // (4 * BLOCK_WORDS)))
    rows = docs.select(key.alias("key"), "text").where(F.col("text").isNotNull()).mapInPandas(shortened, "key long, ids binary").where("octet_length(ids) > 0")
    return materialise(rows.repartition(shards, "key").sortWithinPartitions("key", "ids").mapInPandas(joined, "number int, ids binary, sizes binary"), "blocks")


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """(model, exact word counts) from every document; an empty corpus leaves the initial weights."""
    spark = docs.sparkSession
    counts = count_words(docs)
    total, known, n, z_words, z_weights = shares(counts)
    flat = initial()
    dealt = blocks(docs, total)
    for r in range(ROUNDS):
        held = spark.sparkContext.broadcast(flat)

        def run(batches, held=held):
            weights, seen = np.zeros(len(held.value), dtype=np.int64), 0
            for batch in batches:
                for ids, sizes in zip(batch["ids"], batch["sizes"]):
                    ids, sizes = np.frombuffer(ids, np.uint32), np.frombuffer(sizes, np.int64)
                    weight = max(1, len(ids) // WEIGHT)
                    weights += np.rint(learn(held.value, ids, np.concatenate(([0], np.cumsum(sizes)))).astype(np.float64) * GRAIN).astype(np.int64) * weight
                    seen += weight
            if seen:
                yield pd.DataFrame({"i": np.arange(len(weights)), "w": weights, "n": seen})

        # weighted means of as many numbers as the network has, each task's blocks summed before the shuffle
        mine = dealt.where(F.pmod("number", F.lit(ROUNDS)) == r).select("ids", "sizes")
        means = mine.mapInPandas(run, "i int, w long, n long").groupBy("i").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).toPandas()
        if len(means):
            flat = flat.copy()
            flat[means["i"]] = means["w"] / means["n"] / GRAIN
    discard(dealt)
    return Model(flat, total, known, n, z_words, z_weights), counts


def log_z(s: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """log of sum over a, b of cells[a, b] exp(s[a] + s[b]), a row of ``s`` at a time; in doubles where floats underflow."""
    top = s.max(1)
    e = np.exp(s - top[:, None])
    z = np.einsum("ij,ij->i", e @ cells.astype(e.dtype), e).astype(float)
    low = np.flatnonzero(z < 1e-25) if s.dtype == np.float32 else np.zeros(0, int)
    z[low] = 1
    out = np.log(z) + 2 * top
    if len(low):
        out[low] = log_z(s[low].astype(float), cells)
    return out


def log_probabilities(texts, model: Model):
    """(position, words, summed log-probability short of the counts of rare words, rare words) of each text.

    A rare word counts as if it occurred once; the logarithm of its true count is to be added.
    """
    params = views(model.flat)
    cells = np.zeros((OUT, OUT))
    np.add.at(cells, output_rows(short(model.z_words)), model.z_weights)
    some = len(model.known) > 0  # where too many words share the greatest count, all are joined
    known, log_counts = (model.known, np.log(model.counts)) if some else (np.zeros(1, U), np.zeros(1))
    for part in steps(texts):
        words, offset = words_of([b for _, b in part])
        if not len(words):
            yield from ((i, 0, 0.0, []) for i, _ in part)
            continue
        ids = short(words)
        context = contexts(ids, offset)
        at = np.minimum(np.searchsorted(known, words), len(known) - 1)
        rare = (known[at] != words) | (not some)
        each = np.where(rare, 0, log_counts[at]) - np.log(model.total)
        for a in range(0, len(ids), SCORE_BATCH):
            _, _, g = forward(params, context[a : a + SCORE_BATCH])
            each[a : a + SCORE_BATCH] += np.einsum("ij,ij->i", g, outputs(params, ids[a : a + SCORE_BATCH])) - log_z(g @ params[4].T, cells)
        total = np.concatenate(([0.0], np.cumsum(each)))
        for (i, _), a, b in zip(part, offset[:-1].tolist(), offset[1:].tolist()):
            yield i, b - a, total[b] - total[a], words[a:b][rare[a:b]].view(np.int64)


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """(doc_id, n_words, log_likelihood, mean_log_prob) of every row.

    Null texts and texts without words have no words, likelihood 0 and a null mean. Words that the counted corpus lacks
    count as occurring once. Repeated rows are returned as often, a null doc_id stays null, an empty table gives no
    rows, and columns other than doc_id and text are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # some three megabytes, whatever the input

    def run(batches):
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = list(log_probabilities(batch["text"], held.value))
            yield pd.DataFrame({"row": place + np.arange(len(rows)), "doc_id": batch["doc_id"], "n_words": [r[1] for r in rows], "part": [r[2] for r in rows], "rare": [r[3] for r in rows]})
            place += len(rows)

    scored = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "row long, doc_id long, n_words long, part double, rare array<long>"), "scored")
    # rare words are many but none is frequent, so no key of this join is hot; those that occur once add nothing
    others = counts.where("n > 1")
    if len(model.counts):
        others = others.where(F.col("n") <= int(model.counts.min()))
    added = scored.select("row", F.explode("rare").alias("word")).join(others, "word").groupBy("row").agg(F.sum(F.log("n")).alias("added"))
    likelihood = F.round(F.col("part") + F.coalesce("added", F.lit(0.0)), 4)
    out = scored.select("row", "doc_id", "n_words", "part").join(added, "row", "left").select("doc_id", "n_words", likelihood.alias("log_likelihood"))
    return out.withColumn("mean_log_prob", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))


def op4_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, *train(docs))
