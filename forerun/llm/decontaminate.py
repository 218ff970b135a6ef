"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts and items are sequences of words (letters, digits and signs between white space and punctuation, A-Z in lower
case). The CGK embedding walks over a window and, at each step, writes the current word and moves on or stays by a
random bit of that word, so sequences at a small edit distance are written at a small Hamming distance. A repetition
samples some steps; windows and items whose samples agree are compared by their exact edit distance. Items are put in
length classes and only steps before the class's shortest item are sampled, so a window's embedding serves every item
size of its class. Repetitions are added until items with the most edits allowed are found at the target recall.

Items of fewer than ``MIN_WORDS`` words have too few steps to sample and are found exactly instead: cut into one part more
than their edits, at least one part stands unchanged in every occurrence, so equal parts lead to all of them. In scripts
without spaces each character is a word.

Only windows that can hold an item are embedded: with at most k edits, at least m - 1 - 2k of an item's m - 1 word
pairs survive, and an occurrence begins with a word of the item's first k + 1, so the test loses nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textkernel import SPACE, U, Words, mix, steps

#: Share of an item's words that edits may change; items of fewer words are searched by their exact parts.
EDITS, MIN_WORDS = 0.2, 8
#: Steps sampled in a repetition, recall wanted for items with the most edits, trials of its estimate in a class, growth
#: of classes, repetitions at most.
SAMPLED, RECALL, TRIALS, CLASS_GROWTH, MOST_REPETITIONS = 3, 0.98, 400, 1.5, 512
#: Bytes of benchmark text in one broadcast index; a larger benchmark is searched block by block.
INDEX_BYTES = 1 << 23

SEPARATORS = SPACE.copy()
SEPARATORS[list(b".,;:!?\"'()[]{}<>|-_/\\*#&%$+=~^`@")] = True
#: Punctuation and characters of scripts without spaces: Thai to Tibetan, Burmese, Khmer, kana, bopomofo, Han.
_WIDE_SIGNS = re.compile("[\u3000-\u3004\u3008-\u3020\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u3007\u3021-\u30fa\u30fc-\u312f\u31a0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


@dataclass
class Repetition:
    """One random walk of a class and the steps it samples."""

    odds: np.ndarray  # per step up to the last one sampled
    picks: list[int]
    keys: np.ndarray  # of the class's items, sorted
    items: np.ndarray


@dataclass
class LengthClass:
    low: int
    longest: int  # words of the longest window of an item of the class, edits included
    need: int  # fewest surviving pairs over the class
    heads: np.ndarray  # sorted hashes of words that an occurrence may begin with
    repetitions: list[Repetition]
    recall: float  # of the repetitions, on trials that had no say in their number


@dataclass
class Parts:
    """The parts of some length of short items."""

    keys: np.ndarray  # of the parts, sorted
    items: np.ndarray
    shifts: np.ndarray  # words of the item before the part


@dataclass
class Index:
    ids: np.ndarray
    words: list[np.ndarray]
    pairs: np.ndarray  # sorted hashes of the items' word pairs
    coarse: np.ndarray  # the same by their upper 20 bits
    classes: list[LengthClass]
    short: dict[int, Parts]  # by words of a part


def _spaced(text: str | None) -> str | None:
    """``text`` with spaces around each character of a script without them."""
    if text is None or text.isascii():
        return text
    return _UNSPACED.sub(r" \g<0> ", _WIDE_SIGNS.sub(" ", text))


def _gram(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` words that begin at each word."""
    key = np.full(max(len(words) - n + 1, 0), n, dtype=np.uint64)
    for j in range(n):
        key = mix(key * U(0xA0761D6478BD642F) + words[j : j + len(key)])
    return key


def _parts(words: list[np.ndarray]) -> dict[int, Parts]:
    """Parts of the items of fewer than ``MIN_WORDS`` words: one more than the edits of the item."""
    held: dict[int, list[tuple[int, int, int]]] = {}
    for i, w in enumerate(words):
        if len(w) < MIN_WORDS:
            cuts = int(EDITS * len(w)) + 1
            ends = [len(w) * c // cuts for c in range(cuts + 1)]
            for a, b in zip(ends, ends[1:]):
                held.setdefault(b - a, []).append((int(_gram(w[a:b], b - a)[0]), i, a))
    out = {}
    for n, rows in held.items():
        rows.sort()
        out[n] = Parts(np.array([r[0] for r in rows], dtype=np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
    return out


def _pair(words: np.ndarray) -> np.ndarray:
    return mix(words[:-1] * U(0xA0761D6478BD642F) + words[1:])


def walk(words: np.ndarray, begin: np.ndarray, rep: Repetition) -> np.ndarray:
    """Hashes of the sampled steps of the embeddings of windows that begin at ``begin``."""
    at = begin.copy()
    key = np.zeros(len(begin), dtype=np.uint64)
    last = len(words) - 1
    picks = set(rep.picks)
    for j, odd in enumerate(rep.odds):
        now = words[np.minimum(at, last)]
        if j in picks:
            key = mix(key + now)
        at += ((now * odd) >> U(63)).view(np.int64)
    return key


def _edited(words: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    out = words.tolist()
    for _ in range(edits):
        kind, i = rng.integers(3), int(rng.integers(max(len(out), 1)))
        new = int(rng.integers(1 << 62))
        if kind == 0 and len(out) > 1:
            del out[i]
        elif kind == 1:
            out.insert(i, new)
        else:
            out[i] = new
    return np.array(out, dtype=np.uint64)


def _repetition(seed: int, low: int, owners: np.ndarray, flat: np.ndarray, begin: np.ndarray) -> Repetition:
    rng = np.random.default_rng(seed)
    picks = sorted(rng.choice(low, SAMPLED, replace=False).tolist())
    odds = rng.integers(1, 1 << 63, picks[-1] + 1, dtype=np.uint64) * U(2) + U(1)
    rep = Repetition(odds, picks, np.empty(0, np.uint64), owners)
    keys = walk(flat, begin, rep)
    order = np.argsort(keys, kind="stable")
    rep.keys, rep.items = keys[order], owners[order]
    return rep


def build(ids: list[int], texts: list[str | None]) -> Index:
    """The index of benchmark items; null ones and those without words take no part."""
    kept, words = [], []
    for i, text in zip(ids, texts):
        if i is None or text is None:
            continue
        h = Words([_spaced(text).encode("utf-8", "surrogatepass")], SEPARATORS).hashes()
        if len(h):
            kept.append(i)
            words.append(h)
    pairs = np.unique(np.concatenate([np.empty(0, np.uint64), *[_pair(w) for w in words if len(w) >= MIN_WORDS]]))
    coarse = np.zeros(1 << 20, dtype=bool)
    coarse[(pairs >> U(44)).view(np.int64)] = True
    classes, low = [], MIN_WORDS
    longest = max(map(len, words), default=0)
    while low <= longest:
        high = max(low + 1, int(low * CLASS_GROWTH))
        mine = [i for i, w in enumerate(words) if low <= len(w) < high]
        if mine:
            edits = {i: int(EDITS * len(words[i])) for i in mine}
            flat = np.concatenate([words[i] for i in mine])
            size = np.array([len(words[i]) for i in mine])
            begin = np.cumsum(size) - size
            place = {item: p for p, item in enumerate(mine)}
            # two sets of trials: one decides how many repetitions there are, the other measures them
            found, trials = [], []
            for seed in (low, -low % (1 << 32)):
                rng = np.random.default_rng(seed)
                drawn = [mine[int(t)] for t in rng.integers(len(mine), size=TRIALS)]
                changed = [_edited(words[i], edits[i], rng) for i in drawn]
                t_size = np.array([len(c) for c in changed])
                trials.append((np.concatenate(changed), np.cumsum(t_size) - t_size, np.array([place[i] for i in drawn])))
                found.append(np.zeros(TRIALS, dtype=bool))
            made: list[Repetition] = []
            while found[0].mean() < RECALL and len(made) < MOST_REPETITIONS:
                rep = _repetition(1000 * low + len(made), low, np.array(mine), flat, begin)
                keys = walk(flat, begin, rep)
                for hit, (t_flat, t_begin, of) in zip(found, trials):
                    hit |= walk(t_flat, t_begin, rep) == keys[of]
                made.append(rep)
            need = min(len(words[i]) - 1 - 2 * edits[i] for i in mine)
            heads = np.unique(np.concatenate([words[i][: edits[i] + 1] for i in mine]))
            classes.append(LengthClass(low, max(len(words[i]) + edits[i] for i in mine), need, heads, made, float(found[1].mean())))
        low = high
    return Index(np.array(kept, dtype=np.int64), words, pairs, coarse, classes, _parts(words))


def edit_distance(item: list[int], text: list[int]) -> tuple[int, int]:
    """(distance, length) of the prefix of ``text`` nearest to ``item`` by edits (shortest of the nearest): bit-parallel."""
    m = len(item)
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = (m, 0)
    for j, w in enumerate(text):
        eq = masks.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | ~(xh | plus) & full, plus & xh
        score += 1 if ph & top else -1 if mh & top else 0
        ph, mh = (ph << 1 | 1) & full, mh << 1 & full
        plus, minus = mh | ~(xv | ph) & full, ph & xv
        if score < best[0]:
            best = (score, j + 1)
    return best


def _in(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x if len(sorted_values) else np.zeros(len(x), bool)


Found = dict[tuple[int, int], tuple[int, int, int]]


def _long(h: np.ndarray, owner: np.ndarray, stop: np.ndarray, index: Index) -> Found:
    """(words, first word, distance) by text and item of the nearest occurrences of items of the length classes."""
    found: Found = {}
    if not index.classes:
        return found
    pair = _pair(h)
    hit = np.flatnonzero(index.coarse[(pair >> U(44)).view(np.int64)])
    hit = hit[_in(index.pairs, pair[hit]) & (stop[hit] > hit + 1)]
    if not len(hit):
        return found
    count = np.zeros(len(h) + 1, dtype=np.int64)
    count[hit + 1] = 1
    count = np.cumsum(count)
    for c in index.classes:
        end = np.minimum(np.arange(len(h)) + c.longest, stop) - 1
        begin = np.flatnonzero(count[np.maximum(end, 0)] - count[:-1] >= max(c.need, 1))
        begin = begin[_in(c.heads, h[begin])]
        if not len(begin):
            continue
        seen: set[tuple[int, int]] = set()
        for rep in c.repetitions:
            keys = walk(h, begin, rep)
            a, b = np.searchsorted(rep.keys, keys, "left"), np.searchsorted(rep.keys, keys, "right")
            for i in np.flatnonzero(b > a).tolist():
                seen.update((int(begin[i]), item) for item in rep.items[a[i] : b[i]].tolist())
        for at, item in sorted(seen):
            w = index.words[item]
            edits = int(EDITS * len(w))
            distance, n = edit_distance(w.tolist(), h[at : min(at + len(w) + edits, int(stop[at]))].tolist())
            key = (int(owner[at]), item)
            if distance <= edits and (key not in found or (distance, at) < found[key][2:0:-1]):
                found[key] = (n, at, distance)
    return found


def _short(h: np.ndarray, owner: np.ndarray, stop: np.ndarray, offset: np.ndarray, index: Index) -> Found:
    """The same of items of fewer than ``MIN_WORDS`` words: every place where a part of the item stands is compared."""
    found: Found = {}
    for n, parts in index.short.items():
        keys = _gram(h, n)
        at = np.flatnonzero(_in(parts.keys, keys) & (np.arange(n, len(h) + 1)[: len(keys)] <= stop[: len(keys)]))
        low, high = np.searchsorted(parts.keys, keys[at], "left"), np.searchsorted(parts.keys, keys[at], "right")
        for p, a, b in zip(at.tolist(), low.tolist(), high.tolist()):
            d = int(owner[p])
            for item, shift in zip(parts.items[a:b].tolist(), parts.shifts[a:b].tolist()):
                key, w = (d, item), index.words[item]
                if key in found and found[key][2] == 0 and found[key][1] <= p - shift:
                    continue
                edits = int(EDITS * len(w))
                # edits before the part move the beginning by as many words
                moved = edits if shift else 0
                for begin in range(max(p - shift - moved, int(offset[d])), p - shift + moved + 1):
                    distance, size = edit_distance(w.tolist(), h[begin : min(begin + len(w) + edits, int(stop[p]))].tolist())
                    if distance <= edits and (key not in found or (distance, begin) < found[key][2:0:-1]):
                        found[key] = (size, begin, distance)
    return found


def matches(texts, index: Index):
    """(text, item, first word, words, distance) of the nearest occurrence of each item within its edits in each text."""
    for part in steps(map(_spaced, texts)):
        if not index.ids.size:
            return
        words = Words([b for _, b in part], SEPARATORS)
        h = words.hashes()
        if not len(h):
            continue
        owner = np.repeat(np.arange(len(part)), np.diff(words.offset))
        stop = words.offset[1:][owner]  # where each word's document ends
        found = _long(h, owner, stop, index) | _short(h, owner, stop, words.offset, index)
        for (d, item), (n, at, distance) in sorted(found.items()):
            yield part[d][0], int(index.ids[item]), at - int(words.offset[d]), n, distance


def _indexes(benchmark: DataFrame):
    """Indexes of the benchmark, block by block; each holds about ``INDEX_BYTES`` of text, so it can be broadcast."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // INDEX_BYTES))
    for block in range(blocks):
        rows = sorted(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect())
        yield build([r[0] for r in rows], [r[1] for r in rows])


def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, distance, n_item_words): one row per document and item that it holds.

    Each row is the nearest occurrence (the first of the nearest) within 20 % of the item's words in edits. Null and
    empty texts hold nothing; a repeated document gives its rows again; a null doc_id stays null; items that are null
    or have no words are left out, shorter ones than five words count only unchanged; of repeated item ids each text counts. Empty tables give no rows, and
    columns other than doc_id, item_id and text are not read. Words are counted from 0.
    """
    spark = docs.sparkSession
    out = None
    for index in _indexes(benchmark):
        held = spark.sparkContext.broadcast(index)
        lengths = spark.sparkContext.broadcast({r: len(w) for r, w in zip(held.value.ids.tolist(), held.value.words)})

        def run(batches, held=held, lengths=lengths):
            for batch in batches:
                ids = batch["doc_id"].tolist()
                rows = [(ids[t], *r, lengths.value[r[0]]) for t, *r in matches(batch["text"], held.value)]
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "item_id", "first_word", "n_words", "distance", "n_item_words"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, item_id long, first_word long, n_words int, distance int, n_item_words int")
        out = part if out is None else out.unionByName(part)
    return out


def _leaks(held):
    @F.pandas_udf("boolean")
    def leaks(text: pd.Series) -> pd.Series:
        found = {m[0] for m in matches(text, held.value)}
        return pd.Series([i in found for i in range(len(text))], dtype=bool)

    return leaks


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows, all columns, that hold no benchmark item by ``search``: judged in place, without a join."""
    for index in _indexes(benchmark):
        docs = docs.where(~_leaks(docs.sparkSession.sparkContext.broadcast(index))("text"))
    return docs


def op2_decontaminate_cgk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
