"""Token-id files compressed by Re-Pair, one grammar per block, with random access by expansion lengths.

File format: a Parquet folder with one row per block of whole documents in ascending doc_id order. ``rules`` are pairs
of little-endian unsigned 32-bit symbols (rule i makes symbol ``FIRST_RULE`` + i from two earlier symbols), ``lengths``
their expansion lengths, ``sequence`` the block's remaining symbols, in which no pair repeats, ``doc_ids`` signed 64-bit
and ``doc_tokens`` unsigned 32-bit counts. Any token range is found by summing expansion lengths, and only the symbols
it meets are expanded. A block is the unit of compression and of reading; a partition writes one after the other.
"""

from __future__ import annotations

import copy
import json
import re
import uuid
import zlib
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, table
from .bpe_stream import tokenizer_path
from .textkernel import LOWER, Words, mix, steps

#: First nonterminal symbol: the ids of a vocabulary must be smaller, which ``write`` checks.
FIRST_RULE = 1 << 20
#: Tokens in a block (whole documents; a longer document is a block of its own).
BLOCK_TOKENS = 1 << 19
#: Below so many tokens, a symbol and a place take 21 bits each.
PACKED_TOKENS = 1 << 21
#: Distinct chunks that a worker remembers.
CACHE_CHUNKS = 1 << 20
#: Characters tokenised in one vectorised step (or one longer document).
STEP_CHARS = 1 << 22

FILE_SCHEMA = "shard int, block int, n_tokens long, doc_ids binary, doc_tokens binary, rules binary, lengths binary, sequence binary"


_W, _LETTER, _DIGIT, _SIGN, _QUOTE, _WHOLE = range(6)
_KIND = np.full(256, _WHOLE, dtype=np.uint8)
_KIND[33:127] = _SIGN
_KIND[[32, 9, 10, 11, 12, 13]] = _W
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[39] = _QUOTE
#: Whether a chunk ends between two kinds: never beside a byte that is not plain ASCII, nor where an apostrophe may
#: begin a contraction or signs make one token.
_CUT = np.zeros((6, 6), dtype=bool)
_CUT[_W, :] = _CUT[:, _W] = True
_CUT[_LETTER, [_DIGIT, _SIGN, _QUOTE]] = True
_CUT[_DIGIT, [_LETTER, _DIGIT, _SIGN, _QUOTE]] = True
_CUT[_SIGN, [_LETTER, _DIGIT]] = True
_CUT[_QUOTE, _DIGIT] = True
# the same as tables of bytes: a byte's kind in lower case, and whether 6 * kind + the next byte's kind is a cut
_LOWER, _KINDS = LOWER.tobytes(), _KIND.tobytes()
_CUTS = np.concatenate((_CUT.ravel(), np.zeros(220, dtype=bool))).tobytes()


class ChunkEncoder:
    """Encodes texts by the library, each distinct chunk once.

    The vocabulary's pre-tokeniser drops white space, parts letters, digits and signs, and ignores the case of A-Z, so
    a text's ids are those of its chunks in order. Known chunks are found by hash in a table of open addresses, and each
    hit is compared by its bytes. A text that may hold a special token, or a chunk that another one's hash hides, is
    encoded whole.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.library.no_truncation()
        self.library.no_padding()
        added = [t["content"] for t in json.loads(definition).get("added_tokens") or [] if t["content"]]
        self.special = re.compile("|".join(map(re.escape, added)), re.I) if added else None
        self._forget()

    def _forget(self) -> None:
        self.n_known = self.n_ids = 0
        self.table = np.full(1 << 12, -1, dtype=np.int32)  # places of the known chunks, at most half of it in use
        # of each known chunk its hash, its print and where its ids are; these and the ids have room for more
        self.known, self.length, self.head, self.tail = (np.empty(0, dtype=np.uint64) for _ in range(4))
        self.first, self.size = np.empty(0, np.int64), np.empty(0, np.int32)
        self.ids = np.empty(0, dtype=np.uint32)
        self.long: dict[int, bytes] = {}  # the known chunks that their prints do not tell whole

    def _library(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each chunk): many chunks at once, told apart by the tokens' places."""
        ids, sizes = [], []
        for at in range(0, len(chunks), 1 << 12):
            part = chunks[at : at + (1 << 12)]
            e = self.library.encode(" ".join(part), add_special_tokens=False)
            starts = np.cumsum([0, *[len(c) + 1 for c in part[:-1]]])
            owner = np.searchsorted(starts, np.fromiter((o[0] for o in e.offsets), np.int64, len(e)), side="right") - 1
            ids.append(np.array(e.ids, dtype=np.uint32))
            sizes.append(np.bincount(owner, minlength=len(part)))
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, hashes: np.ndarray, prints: tuple[np.ndarray, ...], chunks: list[bytes]) -> None:
        ids, size = self._library([c.decode("utf-8", "surrogatepass") for c in chunks])
        self.long |= {h: c for h, c in zip(hashes.tolist(), chunks) if len(c) > 16}
        a, b = self.n_known, self.n_known + len(hashes)
        for name, new in zip(("known", "length", "head", "tail", "first", "size"), (hashes, *prints, np.cumsum(size) - size + self.n_ids, size)):
            held = _room(getattr(self, name), a, b)
            held[a:b] = new
            setattr(self, name, held)
        self.ids = _room(self.ids, self.n_ids, self.n_ids + len(ids))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n_known, self.n_ids = b, self.n_ids + len(ids)
        if 2 * b > len(self.table):
            self.table = np.full(4 << b.bit_length(), -1, dtype=np.int32)
            a = 0
        place, slot = np.arange(a, b), self._slot(self.known[a:b])
        while len(place):
            free = self.table[slot] < 0
            self.table[slot[free]] = place[free]  # of several for one slot, one stays
            rest = self.table[slot] != place
            place, slot = place[rest], slot[rest] + 1 & len(self.table) - 1

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(65 - len(self.table).bit_length())).astype(np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The places of known chunks with these hashes, -1 for others."""
        slot = self._slot(hashes)
        found = self.table[slot]
        if not self.n_known:
            return found
        other = np.flatnonzero((found >= 0) & (self.known[found] != hashes))
        while len(other):
            slot[other] = slot[other] + 1 & len(self.table) - 1
            found[other] = self.table[slot[other]]
            other = other[(found[other] >= 0) & (self.known[found[other]] != hashes[other])]
        return found

    def _step(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, number of ids of each text, texts whose ids are not to be trusted)."""
        words = Chunks(raws)
        prints, hashes = words.prints, words.hashes()
        at = self._find(hashes)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh, where = np.unique(hashes[new], return_index=True)
            if self.n_known + len(fresh) > CACHE_CHUNKS:
                # nothing is known from now on but what this step needs
                self._forget()
                new = np.arange(len(hashes))
                fresh, where = np.unique(hashes, return_index=True)
            where = new[where]
            spans = zip(words.start[where].tolist(), words.end[where].tolist())
            self._learn(fresh, tuple(p[where] for p in prints), [words.lower[a:b] for a, b in spans])
            at[new] = self._find(hashes[new])
        wrong = (self.length[at] != prints[0]) | (self.head[at] != prints[1]) | (self.tail[at] != prints[2])
        for i in np.flatnonzero(prints[0] > 16).tolist():
            wrong[i] |= self.long.get(int(self.known[at[i]])) != words.lower[words.start[i] : words.end[i]]
        n = self.size[at]
        ends = np.cumsum(n, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) + np.repeat(self.first[at] - ends + n, n)]
        hidden = np.unique(np.searchsorted(words.offset, np.flatnonzero(wrong), side="right") - 1)
        return ids, np.diff(np.concatenate(([0], ends))[words.offset]), hidden

    def encode(self, texts: list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, number of ids of each text), ``end`` appended to each text."""
        parts, sizes = [], np.zeros(len(texts), dtype=np.int64)
        whole = lambda t: np.array(self.library.encode(t, add_special_tokens=False).ids, dtype=np.uint32)
        special = {i for i, t in enumerate(texts) if t and self.special and self.special.search(t)}
        for part in steps(["" if i in special else t for i, t in enumerate(texts)]):
            ids, n, hidden = self._step([b for _, b in part])
            alone = special | {part[j][0] for j in hidden.tolist()}
            at = 0
            for (i, _), k in zip(part, n.tolist()):
                parts += [whole(texts[i]) if i in alone else ids[at : at + k], np.array([end], dtype=np.uint32)]
                sizes[i] = len(parts[-2]) + 1
                at += k
        return (np.concatenate(parts) if parts else np.empty(0, np.uint32)), sizes


def _room(array: np.ndarray, used: int, needed: int) -> np.ndarray:
    """``array``, or a copy of its used part with room for twice what is needed."""
    if needed <= len(array):
        return array
    out = np.empty(2 * needed, dtype=array.dtype)
    out[:used] = array[:used]
    return out


#: Words of which the first 0 to 8 bytes count.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


class Chunks(Words):
    """Runs that the pre-tokeniser's cuts leave, A-Z in lower case."""

    def __init__(self, raws: list[bytes]):
        raw = b"\n".join(raws) + b"\n"
        self.buffer, self.lower = np.frombuffer(raw, dtype=np.uint8), raw.translate(_LOWER)
        self.low = np.frombuffer(self.lower, dtype=np.uint8)
        kind = np.frombuffer(raw.translate(_KINDS), dtype=np.uint8)
        edge = np.concatenate(([True], np.frombuffer((6 * kind[:-1] + kind[1:]).tobytes().translate(_CUTS), dtype=bool), [True]))
        inside = kind != _W
        self.start = np.flatnonzero(edge[:-1] & inside)
        self.end = np.flatnonzero(edge[1:] & inside) + 1
        lengths = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws)) + 1
        self.doc_end = np.cumsum(lengths)
        self.offset = np.concatenate(([0], np.searchsorted(self.start, self.doc_end)))

    @cached_property
    def prints(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, first eight bytes, last eight bytes) of each run; of one of at most 16 bytes that is all of it."""
        padded = np.concatenate((self.low, np.zeros(8, np.uint8)))
        eight = np.ndarray(len(self.low) + 1, dtype="<u8", buffer=padded.data, strides=(1,))
        size = self.end - self.start
        mask = _MASKS[np.minimum(size, 8)]
        return size.astype(np.uint64), eight[self.start] & mask, eight[np.maximum(self.end - 8, self.start)] & mask

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the runs: of their prints, where these tell all of a run, of all bytes of longer ones."""
        size, head, tail = self.prints
        out = mix(mix(head + size * np.uint64(0x9E3779B97F4A7C15)) + tail)
        long = np.flatnonzero(size > 16)
        if len(long):
            rest = copy.copy(self)
            rest.start, rest.end = self.start[long], self.end[long]
            out[long] = Words.hashes(rest)
        return out


def compress(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, expansion lengths, sequence): Re-Pair, until no pair occurs twice without overlap.

    Each round counts the pairs, in a run of one symbol every other one, and replaces those that are more frequent than
    the pairs that overlap them (of equally frequent ones the larger symbols), if that replaces a pair twice at least.
    The most frequent pair always is. A pair that occurs once stays so, as later rounds make no pair of old symbols, so
    only the others and the neighbours of new symbols are counted again. Occurrences that an overlapping pair kept from
    being replaced may get a rule of their own in a later round.
    """
    sequence = ids.astype(np.int32)
    rules, lengths = [], []
    at, size = FIRST_RULE, np.empty(0, dtype=np.int64)
    # every rule takes two tokens away, so a symbol is below FIRST_RULE + half the tokens: of a block that is no single
    # long document, a pair and its place fit into one word, and sorting that is faster than sorting places by pairs
    packed = len(sequence) < PACKED_TOKENS
    bits = 21 if packed else 32
    mask = (1 << bits) - 1
    open_ = np.ones(len(sequence), dtype=bool)  # whether the pair that begins here may occur again
    while True:
        place = np.flatnonzero(open_[:-1])
        if len(place) < 2:
            break
        left, right = sequence[place], sequence[place + 1]
        # in a run of one symbol the pairs overlap: only every other one counts
        same = np.flatnonzero(left == right)
        if len(same):
            begin = np.concatenate(([True], (np.diff(place[same]) != 1) | (np.diff(left[same]) != 0)))
            first = np.flatnonzero(begin)
            inside = np.arange(len(same)) - np.repeat(first, np.diff(np.concatenate((first, [len(same)]))))
            skip = same[inside % 2 == 1]
        else:
            skip = same
        key = left.astype(np.int64) << bits | right
        if packed:
            key = np.sort(np.delete(key << bits | place, skip))
            place, key = key & mask, key >> bits
        else:
            place, key = np.delete(place, skip), np.delete(key, skip)
            order = np.argsort(key)
            place, key = place[order], key[order]
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.diff(np.concatenate((edge, [len(key)])))
        twice = np.flatnonzero(count > 1)
        if not len(twice):
            break
        rank = np.zeros(len(edge), dtype=np.int32)
        rank[twice[np.argsort(count[twice], kind="stable")]] = np.arange(1, len(twice) + 1)
        weight = np.zeros(len(sequence) + 1, dtype=np.int32)  # both ends have none; the pair that begins at i is i + 1
        weight[1:][place] = np.repeat(rank, count)
        here = weight[1:-1]
        hit = np.flatnonzero((here > weight[:-2]) & (here > weight[2:]))
        uses = np.bincount(here[hit], minlength=len(twice) + 1)
        hit = hit[uses[here[hit]] > 1]
        made = twice[uses[rank[twice]] > 1]
        name = np.zeros(len(twice) + 1, dtype=np.int32)
        name[rank[made]] = at + np.arange(len(made))
        both = np.stack((key[edge[made]] >> bits, key[edge[made]] & mask), axis=1)
        grown = _sizes(both, size).sum(1)
        open_ = weight[1:] > 0
        open_[hit] = open_[np.maximum(hit - 1, 0)] = True
        sequence[hit] = name[here[hit]]
        stays = np.ones(len(sequence), dtype=bool)
        stays[hit + 1] = False
        sequence, open_ = sequence[stays], open_[stays]
        size = np.concatenate((size, grown))
        rules.append(both)
        lengths.append(grown)
        at += len(made)
    flat = np.concatenate(rules) if rules else np.empty((0, 2), np.int64)
    return flat.astype(np.uint32), (np.concatenate(lengths) if lengths else np.empty(0)).astype(np.uint32), sequence.astype(np.uint32)


def _sizes(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The expansion lengths of symbols."""
    out = np.ones(symbols.shape, dtype=np.int64)
    big = symbols >= FIRST_RULE
    out[big] = lengths[symbols[big] - FIRST_RULE]
    return out


def expand(rules: np.ndarray, lengths: np.ndarray, sequence: np.ndarray, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Tokens [start, stop) of a block; only the symbols that overlap the range are expanded."""
    size = _sizes(sequence, lengths)
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    stop = total if stop is None else min(stop, total)
    if start >= stop:
        return np.empty(0, dtype=np.uint32)
    a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
    begin = int(ends[a] - size[a])
    out = np.empty(int(ends[b - 1]) - begin, dtype=np.uint32)
    symbol, place = sequence[a:b].astype(np.int64), ends[a:b] - size[a:b] - begin
    while len(symbol):
        plain = symbol < FIRST_RULE
        out[place[plain]] = symbol[plain]
        pair, place = rules[symbol[~plain] - FIRST_RULE].astype(np.int64), place[~plain]
        symbol, place = pair.ravel(), np.stack((place, place + _sizes(pair[:, 0], lengths)), axis=1).ravel()
    return out[start - begin : stop - begin]


_made: dict[int, ChunkEncoder] = {}


def _worker(definition: str) -> ChunkEncoder:
    key = hash(definition)
    if key not in _made:
        _made.clear()
        _made[key] = ChunkEncoder(definition)
    return _made[key]


def _block(shard: int, block: int, doc_ids: list[int], counts: list[int], ids: np.ndarray) -> dict:
    rules, lengths, sequence = compress(ids)
    return {
        "shard": shard, "block": block, "n_tokens": len(ids), "doc_ids": np.array(doc_ids, "<i8").tobytes(), "doc_tokens": np.array(counts, "<u4").tobytes(),
        "rules": rules.astype("<u4").tobytes(), "lengths": lengths.astype("<u4").tobytes(), "sequence": sequence.astype("<u4").tobytes(),
    }


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2) -> None:
    """Encode every document, ``end_id`` after each, and write the blocks to ``path`` in ascending doc_id order.

    Null and empty texts are their end id alone. Rows without doc_id are left out, as they have no place in the order;
    repeated ids stay, ordered by text. No rows give a folder with no blocks. Other columns are not read. A vocabulary
    with ids from ``FIRST_RULE`` on is refused.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        definition = f.read()
    if max(end_id, *ChunkEncoder(definition).library.get_vocab().values()) >= FIRST_RULE:
        raise ValueError(f"{vocabulary} has ids from {FIRST_RULE} on, which the file format keeps for its rules")
    held = spark.sparkContext.broadcast(definition)  # a vocabulary file: about 1.7 MB, whatever the input

    def run(batches):
        encoder, shard, block = _worker(held.value), TaskContext.get().partitionId(), 0
        ids, counts, doc_ids, size = [], [], [], 0

        def rows():
            for batch in batches:
                names, texts, chars = [], [], 0
                for name, text in zip(batch["doc_id"].tolist(), batch["text"]):
                    names.append(name)
                    texts.append(text)
                    chars += len(text or "")
                    if chars >= STEP_CHARS:
                        yield names, texts
                        names, texts, chars = [], [], 0
                if names:
                    yield names, texts

        for names, texts in rows():
            new, n = encoder.encode(texts, end_id)
            at = 0
            for name, k in zip(names, n.tolist()):
                if size and size + k > BLOCK_TOKENS:
                    yield pd.DataFrame([_block(shard, block, doc_ids, counts, np.concatenate(ids))])
                    ids, counts, doc_ids, size, block = [], [], [], 0, block + 1
                ids.append(new[at : at + k])
                counts.append(k)
                doc_ids.append(name)
                size += k
                at += k
        if size:
            yield pd.DataFrame([_block(shard, block, doc_ids, counts, np.concatenate(ids))])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull()).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInPandas(run, FILE_SCHEMA).write.parquet(path)


def blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the files at ``path``."""

    def run(batches):
        for batch in batches:
            for b in batch.itertuples(index=False):
                rules = np.frombuffer(b.rules, "<u4").reshape(-1, 2)
                ids = expand(rules, np.frombuffer(b.lengths, "<u4"), np.frombuffer(b.sequence, "<u4"))
                n = np.frombuffer(b.doc_tokens, "<u4").astype(np.int64)
                at = np.cumsum(n) - n
                parts = [ids[i : i + k].astype("<u4") for i, k in zip(at.tolist(), n.tolist())]
                yield pd.DataFrame({
                    "shard": b.shard, "block": b.block, "doc_id": np.frombuffer(b.doc_ids, "<i8"), "at": at, "n_tokens": n,
                    "ids_crc32": [zlib.crc32(p.tobytes()) for p in parts], "ids": [p.tobytes() for p in parts],
                })

    files = blocks(spark, path)
    docs = files.mapInPandas(run, "shard int, block int, doc_id long, at long, n_tokens long, ids_crc32 long, ids binary")
    # one row per shard, then per block of a shard: sums that stay small whatever the texts
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("shard")) - F.col("n"))
    within = files.select("shard", "block", (F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_tokens")).alias("inside"))
    starts = within.join(shards, "shard").select("shard", "block", (F.col("before") + F.col("inside")).alias("base"))
    return docs.join(starts, ["shard", "block"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "ids")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    return read(spark, path).drop("ids")
