"""Vectorised text primitives on UTF-8 bytes: words, word hashes and word shingles of many documents at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of documents handled in one vectorised step; a longer document is a step of its own. Bytes hashed at once.
STEP_BYTES, HASH_BYTES = 1 << 20, 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal inputs stay equal, others scatter."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _factors(n: int) -> np.ndarray:
    """A random odd factor for each place in a word; no power of anything, so no two words collide by their structure."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


_FACTORS = _factors(1 << 12)


def steps(texts, limit: int = STEP_BYTES):
    """Lists of (position, bytes) with at most ``limit`` bytes together, or one longer document; null texts are empty."""
    part, size = [], 0
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if text is not None else b""
        if part and size + len(raw) > limit:
            yield part
            part, size = [], 0
        part.append((i, raw))
        size += len(raw) + 1
    if part:
        yield part


class Words:
    """The words of several documents in one buffer: where each begins and ends, and how many each document has."""

    def __init__(self, raws: list[bytes], space: np.ndarray = SPACE):
        self.buffer = np.frombuffer(b"\n".join(raws) + b"\n", dtype=np.uint8)
        self.low = LOWER[self.buffer]
        inside = ~space[self.low]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        lengths = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws)) + 1
        self.doc_end = np.cumsum(lengths)
        self.offset = np.concatenate(([0], np.searchsorted(self.start, self.doc_end)))

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words, the same for equal words wherever they stand; a few megabytes at a time."""
        total = np.zeros(len(self.start), dtype=U)
        size = self.end - self.start
        cuts = np.searchsorted(self.start, np.arange(0, len(self.low) + HASH_BYTES, HASH_BYTES))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a < b and int(self.end[b - 1] - self.start[a]) <= 2 * HASH_BYTES:
                length = size[a:b]
                ends = np.cumsum(length)
                place = np.arange(int(ends[-1])) - np.repeat(ends - length, length)
                value = _BYTE[self.low[place + np.repeat(self.start[a:b], length)]]
                value *= _FACTORS[place] if int(length.max()) <= len(_FACTORS) else mix(place.astype(U) * U(0x9E3779B97F4A7C15) + U(0x9E3779B97F4A7C15)) | U(1)
                total[a:b] = np.add.reduceat(value, ends - length)
            else:  # the last word begun here is a very long one
                for w in range(a, b):
                    for at in range(int(self.start[w]), int(self.end[w]), HASH_BYTES):
                        stop = min(at + HASH_BYTES, int(self.end[w]))
                        place = np.arange(at - int(self.start[w]), stop - int(self.start[w]), dtype=U)
                        factor = mix(place * U(0x9E3779B97F4A7C15) + U(0x9E3779B97F4A7C15)) | U(1)
                        total[w : w + 1] += np.add.reduce(_BYTE[self.low[at:stop]] * factor)
        return mix(total + size.astype(U))


_STEP = [U(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingles(words: np.ndarray, offset: np.ndarray, k: int):
    """For each document the sorted distinct hashes of its k-word shingles; with fewer words, the whole sequence is one."""
    n = len(words)
    every = None
    if n >= k:
        every = words[: n - k + 1] * _STEP[0]
        for j in range(1, k):
            every += words[j : n - k + 1 + j] * _STEP[j]
        every = mix(every)
    for a, b in zip(offset[:-1].tolist(), offset[1:].tolist()):
        if b - a >= k:
            z = np.sort(every[a : b - k + 1])
            yield z[np.concatenate(([True], z[1:] != z[:-1]))]
        elif b > a:
            whole = np.array([b - a], dtype=U)
            for w in range(a, b):
                whole = mix(whole * _STEP[4] + words[w : w + 1])
            yield whole
        else:
            yield np.empty(0, dtype=U)
