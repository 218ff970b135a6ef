"""Language ID by cross-parsing entropy: suffix automata of labelled text give longest matches; fewest phrases win.

A text is parsed against each language's training text: the longest match from here is a phrase, the next phrase begins
after it. The fewer phrases, each worth the logarithm of the training text's length, the closer the languages.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table

#: Training rows of a language at most, and characters of them together (whole rows that fit).
MAX_TRAIN, TRAIN_CHARS = 600, 40_000
#: Blocks of so many characters of many texts, or of one long text, advance together; phrases run on across them.
BLOCK = 256
#: Characters of texts parsed in one step.
STEP_CHARS = 1 << 21
#: How sharply the relative surplus of phrases lowers a language's share of the score.
SHARPNESS = 40.0
UNKNOWN = "und"


def fold(text: str) -> str:
    """Lower case; every run of other characters than letters and marks becomes one space."""
    low = text.lower()
    return " ".join("".join(_KEEP[c] for c in low).split())


class _Keep(dict):
    def __missing__(self, c: str) -> str:
        self[c] = found = c if unicodedata.category(c)[0] in "LM" else " "
        return found


_KEEP = _Keep()


@dataclass
class Automaton:
    """Transitions in a double array: state s goes on c to to[base[s] + c] if owner[base[s] + c] is s; 0 is the start."""

    base: np.ndarray
    owner: np.ndarray
    to: np.ndarray

    def step(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether a phrase begins with the symbol, next state): at the start, and where the match doesn't go on."""
        slot = self.base[state] + c
        goes = self.owner[slot] == state
        begin = self.base[0] + c
        fresh = np.where(self.owner[begin] == 0, self.to[begin], 0)  # a symbol that the text lacks is a phrase alone
        return ~goes | (state == 0), np.where(goes, self.to[slot], fresh)


def suffix_automaton(symbols: list[int]) -> Automaton:
    """The automaton of all substrings."""
    jump: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        now = len(jump)
        jump.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in jump[p]:
            jump[p][c] = now
            p = link[p]
        if p != -1:
            q = jump[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                clone = len(jump)
                jump.append(jump[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and jump[p].get(c) == q:
                    jump[p][c] = clone
                    p = link[p]
                link[q] = link[now] = clone
        last = now
    return packed(jump)


def packed(jump: list[dict[int, int]]) -> Automaton:
    """The double array of the transitions: states with many go first, each to a random place where all of its are free."""
    edges, width = sum(map(len, jump)), max((max(d) for d in jump if d), default=0) + 2
    size = 1 << max(4, (2 * edges).bit_length())
    base, owner, to = [0] * len(jump), [-1] * (size + width), [0] * (size + width)
    place = 1
    for s in sorted(range(len(jump)), key=lambda s: -len(jump[s])):
        while any(owner[place + c] != -1 for c in jump[s]):
            place = (place * 1664525 + 1013904223) % size
        base[s] = place
        for c, t in jump[s].items():
            owner[place + c], to[place + c] = s, t
        place = (place * 1664525 + 1013904223) % size
    # symbols above the alphabet of this text fall on places that nobody owns
    return Automaton(np.array(base, np.int32), np.array(owner, np.int32), np.array(to, np.int32))


@dataclass
class Model:
    languages: list[str]
    alphabet: list[str]  # symbol 0 is the space, 1 any character that no training text has
    automata: list[Automaton]
    cost: np.ndarray  # of a phrase: the logarithm of the training length

    def codes(self) -> np.ndarray:
        table = np.ones(0x110000, dtype=np.int32)
        for i, c in enumerate(self.alphabet):
            table[ord(c)] = i + 2
        table[ord(" ")] = 0
        return table


def fit(by_language: dict[str, list[str]]) -> Model:
    """Automata of each language's texts, folded: whole texts in turn, as long as they fit into ``TRAIN_CHARS``.

    A language whose texts are all too long learns from its shortest. Every character of the texts is a symbol.
    """
    texts = {}
    for name, rows in sorted(by_language.items()):
        folded = [f for f in map(fold, rows) if f]
        whole, size = [], 0
        for row in folded:
            if size + len(row) < TRAIN_CHARS:
                whole.append(row)
                size += len(row) + 1
        whole = whole or sorted(folded, key=lambda f: (len(f), f))[:1]
        if whole:
            texts[name] = " ".join(whole)
    alphabet = sorted(set().union(*texts.values()) - {" "})
    model = Model(list(texts), alphabet, [], np.log(np.array([len(t) + 1 for t in texts.values()], dtype=float)))
    table = model.codes()
    for t in texts.values():
        symbols = table[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4")].tolist()
        found = suffix_automaton(symbols)
        room = int(found.base.max()) + len(alphabet) + 2 - len(found.owner)
        if room > 0:
            found.owner = np.concatenate((found.owner, np.full(room, -1, np.int32)))
            found.to = np.concatenate((found.to, np.zeros(room, np.int32)))
        model.automata.append(found)
    return model


def phrases(automaton: Automaton, blocks: np.ndarray, length: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Phrases that begin in each block of a parse of whole texts; ``follows`` is the block before it in its text, or -1.

    All blocks are parsed at once, as if each began a phrase. Then each is parsed anew from the state in which the block
    before it ends, until both parses begin a phrase at one place: from there on they are the same. Where that does not
    happen the block ends in another state, and the next one is parsed once more.
    """
    order = np.argsort(-length, kind="stable")
    state = np.zeros(len(blocks), dtype=np.int32)
    starts = np.zeros((len(blocks), blocks.shape[1]), dtype=bool)
    live = np.searchsorted(-length[order], -np.arange(blocks.shape[1]), side="left")
    for j, n in enumerate(live.tolist()):
        if not n:
            break
        rows = order[:n]
        starts[rows, j], state[rows] = automaton.step(state[rows], blocks[rows, j])
    count = starts.sum(1)
    after = np.full(len(blocks), -1)
    after[follows[follows >= 0]] = np.flatnonzero(follows >= 0)
    todo = np.flatnonzero(follows >= 0)
    ends = state.copy()
    while len(todo):
        now, at, alone, seen, changed = todo, ends[follows[todo]], np.zeros(len(todo), dtype=np.int64), np.zeros(len(todo), dtype=np.int64), []
        for j in range(blocks.shape[1]):
            over = length[now] <= j
            if over.any():
                rows = now[over]
                count[rows] = alone[over]
                moved = ends[rows] != at[over]
                ends[rows] = at[over]
                changed.append(rows[moved])
                now, at, alone, seen = now[~over], at[~over], alone[~over], seen[~over]
            if not len(now):
                break
            begins, at = automaton.step(at, blocks[now, j])
            known = starts[now, j]
            met = begins & known
            if met.any():
                rows = now[met]
                count[rows] = starts[rows].sum(1) - seen[met] + alone[met]
                moved = ends[rows] != state[rows]
                ends[rows] = state[rows]
                changed.append(rows[moved])
            stay = ~met
            now, at, alone, seen = now[stay], at[stay], alone[stay] + begins[stay], seen[stay] + known[stay]
        if len(now):
            count[now] = alone
            moved = ends[now] != at
            ends[now] = at
            changed.append(now[moved])
        todo = after[np.concatenate(changed)] if changed else np.empty(0, np.int64)
        todo = todo[todo >= 0]
    return count


def predict(texts, model: Model, table: np.ndarray | None = None) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text; ``und`` and 0 for texts that are null or have no letter, or if nothing was learned.

    The score is the winner's share after a softmax over the relative numbers of phrases; ties go to the first name.
    """
    texts = list(texts)
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    table = model.codes() if table is None else table
    at = 0
    while at < len(texts):
        folded, where, size = [], [], 0
        while at < len(texts) and (not folded or size < STEP_CHARS):
            text = texts[at]
            if text is not None and model.languages and any(c.isalpha() for c in text):
                f = fold(text)
                if f:
                    folded.append(f)
                    where.append(at)
                    size += len(f)
            at += 1
        if not folded:
            continue
        symbols = table[np.frombuffer("".join(folded).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        n = np.array([len(f) for f in folded])
        k = -(-n // BLOCK)
        owner = np.repeat(np.arange(len(folded)), k)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(k) - k, k)
        begin = np.repeat(np.cumsum(n) - n, k) + inside * BLOCK
        length = np.minimum(BLOCK, np.repeat(n, k) - inside * BLOCK)
        follows = np.where(inside > 0, np.arange(len(owner)) - 1, -1)
        padded = np.concatenate((symbols, np.zeros(BLOCK, np.int32)))
        blocks = padded[begin[:, None] + np.arange(BLOCK)]
        total = np.stack([np.bincount(owner, phrases(a, blocks, length, follows) * cost, len(folded)) for a, cost in zip(model.automata, model.cost)], axis=1)
        share = np.exp(-SHARPNESS * (total / total.min(1, keepdims=True) - 1))
        share /= share.sum(1, keepdims=True)
        best = total.argmin(1)
        for i, b, s in zip(where, best.tolist(), share[np.arange(len(best)), best].tolist()):
            names[i], scores[i] = model.languages[b], s
    return names, scores


def train(docs: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit on at most about ``max_train`` rows of each language from the learning fold (a documented bound)."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    grain = 1 << 20
    keep = F.lit(False)
    for name, n in sizes.items():
        keep = keep | ((F.col("lang") == name) & (F.pmod(F.xxhash64("doc_id"), F.lit(grain)) < (grain if n <= max_train else int(grain * max_train / n))))
    # texts of all kinds take turns, in an order by hash; no more of them come to the driver than it may use
    sample = rows.where(keep).select("lang", F.md5(F.col("text").cast("binary")).alias("h"), F.length("text").alias("n"))
    wanted, spent = [], {}
    ordered = sorted(sample.distinct().collect())
    for lang, h, n in ordered:
        if spent.get(lang, 0) + n < 3 * TRAIN_CHARS:  # folding shortens texts
            spent[lang] = spent.get(lang, 0) + n
            wanted.append(h)
    for lang in {r["lang"] for r in ordered} - set(spent):
        wanted.append(min((r["n"], r["h"]) for r in ordered if r["lang"] == lang)[1])
    found: dict[str, list] = {}
    for r in rows.where(keep & F.md5(F.col("text").cast("binary")).isin(wanted)).select("lang", "text").collect() if wanted else ():
        found.setdefault(r["lang"], []).append(r["text"])
    return fit({name: sorted(texts, key=lambda t: hash_text(t)) for name, texts in found.items()})


def hash_text(text: str) -> bytes:
    import hashlib

    return hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, by its whole text.

    Null texts and texts without a letter are ``und`` with score 0. Repeated rows are returned as often, a null doc_id
    stays null (held_out false), an empty table gives no rows, and columns other than doc_id and text are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # languages x TRAIN_CHARS x at most some 100 bytes

    def run(batches):
        model = held.value
        codes = model.codes()
        for batch in batches:
            names, scores = predict(batch["text"], model, codes)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": names, "score": scores})

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op3_language_crossparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
