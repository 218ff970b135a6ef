"""Byte-level BPE as a bounded-lookahead streaming transducer, and an incremental decoder.

Reading a text from the left, a token may be emitted as soon as no continuation can change it. How far ahead that needs
to look is a property of the merge list alone (``sufficient_lookahead``), so encoding keeps a window of fixed size
whatever the length of the text, and the tokens are those that encoding the text at once would give.
"""

from __future__ import annotations

import codecs
import hashlib
import itertools
import json
import re

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: The byte-level pre-tokenisation pattern of the vocabulary file's format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Memory bounds: remembered pieces per worker and their longest, characters read at once, symbols taken into the window
#: at once, pre-tokens held, ids decoded at once.
CACHE_PIECES, CACHE_CHARS, BLOCK_CHARS, WINDOW, HELD, DECODE_IDS = 400_000, 48, 1 << 15, 512, 1 << 12, 1 << 14

_PIECE = re.compile(r"\s*\S+|\s+")
_CUT = re.compile(r"\S(\s)")
_UNSAFE = re.compile("[\x1c-\x1f]")

#: The ids of a stretch of text as text, how many they are, and the bytes that they stand for.
Entry = tuple[str, int, bytes]


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in character of each byte: printable Latin-1 bytes stand for themselves, the rest follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Symbols after a token's end that decide it, for any text.

    Take a text and the same text continued. Apply the merges in rank order to both; they agree left of a frontier,
    at first the text's end. Only a merge (a, b) that joins across the frontier in one of the two moves it, by the
    length of a, and the next such merge (a', b') has a later rank while b' starts with the a before: a lies on b's
    left spine. The longest chain of such steps bounds how far the frontier can go, whatever the continuation.
    """
    left = {a + b: a for a, b in merges}
    far: dict[str, int] = {}
    for a, b in merges:
        most, spine = 0, b
        while spine is not None:
            most = max(most, far.get(spine, 0))
            spine = left.get(spine)
        far[a] = max(far.get(a, 0), len(a) + most)
    return max(far.values(), default=0)


class Transducer:
    """Encoder and decoder of one vocabulary file (the JSON text of a byte-level BPE tokenizer)."""

    def __init__(self, definition: str):
        d = json.loads(definition)
        vocab = d["model"]["vocab"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in d["model"]["merges"]]
        self.symbol = {b: vocab[c] for b, c in byte_alphabet().items() if c in vocab}
        self.rank = {(vocab[a], vocab[b]): i for i, (a, b) in enumerate(merges)}
        self.made = [vocab[a + b] for a, b in merges]
        self.none = len(merges)
        self.lookahead = sufficient_lookahead(merges)
        back = {c: b for b, c in byte_alphabet().items()}
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.bytes = {i: bytes(back[c] for c in token) for token, i in vocab.items() if all(c in back for c in token)}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        self.length = {i: len(b) for i, b in self.bytes.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.window = max(WINDOW, *self.length.values())
        # remembered pieces: the recent ones, and those before them, which come back when they are met again
        self.cache: dict[str, Entry] = {}
        self.older: dict[str, Entry] = {}

    def merged(self, ids: list[int]) -> list[int]:
        """All merges in rank order, leftmost first, over a short run of symbols."""
        rank, none = self.rank.get, self.none
        ranks = [rank(p, none) for p in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != none:
            i = ranks.index(best)
            ids[i : i + 2] = [self.made[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), none)
        return ids

    def stream(self, parts):
        """Lists of the ids of one pre-token, given as parts of its bytes, each emitted once stable.

        At most ``window`` + ``lookahead`` symbols are held. When more follow, the tokens are emitted that end
        ``lookahead`` symbols before the last one held; at the end of the pre-token all others are.
        """
        symbols: list[int] = []
        for raw in parts:
            for at in range(0, len(raw), self.window):
                if len(symbols) > self.lookahead + self.window:
                    done, settled, out = 0, len(symbols) - self.lookahead, []
                    for token in self.merged(symbols[:]):
                        n = self.length[token]
                        if done + n > settled:
                            break
                        done += n
                        out.append(token)
                    # symbols at a token's end are a fresh start: no merge crosses it
                    symbols = symbols[done:]
                    yield out
                symbols += [self.symbol[b] for b in raw[at : at + self.window]]
        yield self.merged(symbols)

    def entry(self, ids) -> Entry:
        return ",".join(map(str, ids)), len(ids), b"".join([self.bytes[i] for i in ids])

    def piece(self, piece: str) -> Entry:
        """The entry of a stretch that pre-tokenises on its own; those of short ones are remembered."""
        words = () if (found := self.cache.get(piece) or self.older.get(piece)) else self.pattern.findall(piece)
        if len(words) == 1:
            found = self.entry([*itertools.chain.from_iterable(self.stream((piece.encode("utf-8", "surrogatepass"),)))])
        elif words:
            texts, counts, raws = zip(*[self.cache.get(w) or self.piece(w) for w in words])
            found = ",".join(texts), sum(counts), b"".join(raws)
        if len(piece) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_PIECES // 2:
                self.cache, self.older = {}, self.cache
            self.cache[piece] = found
        return found

    def words(self, text: str, a: int, b: int):
        """Lists of the entries of text[a:b], one pre-token after the other; a long one is streamed."""
        held: list[Entry] = []
        for m in self.pattern.finditer(text, a, b):
            if m.end() - m.start() <= CACHE_CHARS:
                w = m[0]
                held.append(self.cache.get(w) or self.piece(w))
                if len(held) < HELD:
                    continue
            if held:
                yield held
                held = []
            if m.end() - m.start() > CACHE_CHARS:
                parts = (text[i : min(i + HELD, m.end())].encode("utf-8", "surrogatepass") for i in range(m.start(), m.end(), HELD))
                for ids in self.stream(parts):
                    yield [self.entry(ids)]
        if held:
            yield held

    def blocks(self, text: str):
        """Lists of the entries of consecutive stretches of the text, special tokens included, in bounded memory.

        A cut before white space that follows something else never splits a pre-token, so stretches are independent.
        Runs without such a cut, and the control characters that Python takes for white space and the pattern does
        not, go pre-token by pre-token.
        """
        at = 0
        for m in itertools.chain(self.split_special.finditer(text) if self.special else (), (None,)):
            end = m.start() if m else len(text)
            whole = _UNSAFE.search(text, at, end)
            while at < end and not whole:
                cut = _CUT.search(text, at + BLOCK_CHARS, end) if end - at > BLOCK_CHARS else None
                stop = cut.start(1) if cut else end
                if stop - at > 2 * BLOCK_CHARS:
                    yield from self.words(text, at, stop)
                else:
                    cache, piece = self.cache, self.piece
                    yield [cache.get(p) or piece(p) for p in _PIECE.findall(text, at, stop)]
                at = stop
            if at < end:
                yield from self.words(text, at, end)
            if m:
                yield [self.entry([self.special[m[0]]])]
                at = m.end()

    def encode(self, text: str | None):
        """The ids of a text, one after the other."""
        for block in self.blocks(text or ""):
            for ids, n, _ in block:
                if n:
                    yield from map(int, ids.split(","))

    def decode(self, ids):
        """The text of ids, piece by piece: bytes that do not complete a character wait for the next ids."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        ids, table = iter(ids), self.bytes
        while block := list(itertools.islice(ids, DECODE_IDS)):
            yield state.decode(b"".join(map(table.__getitem__, block)))
        yield state.decode(b"", True)

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """(n, sha256 of the ids, sha256 of the decoded text), block by block in bounded memory."""
        n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for block in self.blocks(text or ""):
            texts, counts, raws = zip(*block)
            if more := sum(counts):
                ids_hash.update((("," if n else "") + ",".join([t for t in texts if t])).encode())
                text_hash.update(state.decode(b"".join(raws)).encode())
                n += more
        text_hash.update(state.decode(b"", True).encode())
        return n, ids_hash.hexdigest(), text_hash.hexdigest()


_made: dict[int, Transducer] = {}


def _worker(definition: str) -> Transducer:
    """One transducer, with its cache, for all tasks of a Python worker."""
    key = hash(definition)
    if key not in _made:
        _made.clear()
        _made[key] = Transducer(definition)
    return _made[key]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _definition(spark: SparkSession, path: str):
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())  # a vocabulary file: about 1.5 MB, whatever the input


def encode_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids, decoded) of each row: token ids and the text that they decode to. Null texts are empty."""
    held = _definition(docs.sparkSession, vocabulary)

    def run(batches):
        t = _worker(held.value)
        for batch in batches:
            ids = [list(t.encode(x)) for x in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": ids, "decoded": ["".join(t.decode(i)) for i in ids]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of ``docs``.

    Null and empty texts have no ids and the digests of an empty string. Repeated rows are returned as often; a null
    doc_id stays null; empty tables give no rows; other columns are not read. Beside the text itself, memory is bounded
    for texts and pre-tokens of any length.
    """
    held = _definition(docs.sparkSession, vocabulary)

    def run(batches):
        t = _worker(held.value)
        for batch in batches:
            rows = [t.digest(x) for x in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [r[0] for r in rows], "ids_sha256": [r[1] for r in rows], "decoded_sha256": [r[2] for r in rows]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
