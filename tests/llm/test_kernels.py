"""Kernels of the corpus operators against brute force, without Spark."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from forerun.llm import decontaminate as D
from forerun.llm import language as L
from forerun.llm import licenses as C
from forerun.llm import lm_score as M
from forerun.llm import ngram_join as N
from forerun.llm import quality as Q
from forerun.llm import token_files as T
from forerun.llm import topk_search as K
from forerun.llm import toxicity as X
from forerun.llm.bpe_stream import Transducer, sufficient_lookahead, tokenizer_path
from forerun.llm.textkernel import Words, shingles, steps

LETTERS = [" ", "\n", "\t", "a", "E", "th", "Ing", " the", "'s", "É", "ñ", "1", "9", "!", "*", "\x1c", " ", " ", "́", "日", "🙂", "<|endoftext|>", "  ", "\r\n", "İ", "Σ", "’", ".", "!!", "a,", "it's", ",'s", "=", "̸"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 50))) for _ in range(n)] + [None, "", " ", "a" * 5000]


def test_shingles_count_distinct_word_windows():
    word = re.compile(r"[^\x20\x09-\x0d]+")
    rows = texts(500, 1)
    got = {}
    for part in steps(rows, 300):
        w = Words([b for _, b in part])
        got |= {i: z for (i, _), z in zip(part, shingles(w.hashes(), w.offset, 4))}
    seen = {}
    for i, t in enumerate(rows):
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} or ({tuple(w)} if w else set())
        assert len(got[i]) == len(s)
        for h in got[i].tolist():
            seen.setdefault(h, set()).add(len(s) > 0)
    assert seen


def test_words_of_any_length_and_structure_hash_apart(monkeypatch):
    low, high = "a", "b"
    for _ in range(12):  # a Thue-Morse word and its complement collide under every polynomial modulo a power of two
        low, high = low + high, high + low
    assert len(set(Words([low.encode(), high.encode(), b"x" * 4096, b"x" * 4097]).hashes().tolist())) == 4
    raws = [b"short " + b"y" * 9000 + b" z " + b"w " * 2000, b"", b"y" * 9000]
    want = Words(raws).hashes().tolist()
    monkeypatch.setattr("forerun.llm.textkernel.HASH_BYTES", 1 << 10)  # in many parts, and words longer than a part
    assert Words(raws).hashes().tolist() == want and want[1] == want[-1]


def test_suffix_filter_never_dismisses_a_link():
    rng = np.random.default_rng(12)
    for percent in (80, 85):
        x, y, n, link = [], [], [], []
        for _ in range(700):
            a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 400)), dtype=np.uint64) * np.uint64(2))
            keep = rng.random(len(a)) > rng.choice([0, 0.05, 0.09, 0.15, 0.5])
            b = np.unique(np.concatenate((a[keep], rng.integers(0, 1 << 63, int((~keep).sum()) + 1, dtype=np.uint64) * np.uint64(2))))
            both = len(np.intersect1d(a, b))
            x.append(N.parts(a)), y.append(N.parts(b)), n.append(len(a) + len(b)), link.append(100 * both >= percent * (n[-1] - both))
        rows = [np.frombuffer(b"".join(v), np.uint8).reshape(-1, N.PARTS) for v in (x, y)]
        alive = set(N.suffix_filter(*rows, np.array(n), percent).tolist())
        assert {i for i, k in enumerate(link) if k} <= alive and len(alive) < 0.8 * len(link)
    assert not len(N.suffix_filter(np.empty((0, N.PARTS), np.uint8), np.empty((0, N.PARTS), np.uint8), np.empty(0, int), 80))


def test_transducer_equals_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer_path("byte_bpe_50k.json")
    lib, t = tokenizers.Tokenizer.from_file(path), Transducer(open(path, encoding="utf-8").read())
    for x in [*texts(1500, 2), "ab" * 3000, "-" * 999 + "e" * 2500, "0" * 4000]:
        ids = lib.encode(x or "", add_special_tokens=False).ids
        assert list(t.encode(x)) == ids
        text = lib.decode(ids, skip_special_tokens=False)
        assert "".join(t.decode(ids)) == text
        assert t.digest(x) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_lookahead_of_a_small_merge_list():
    # "ab" waits for a possible "b", whose own merge decides whether "a" stays alone
    assert sufficient_lookahead([("b", "c"), ("a", "b")]) == 2
    assert sufficient_lookahead([]) == 0


def test_the_transducer_emits_every_id_from_a_bounded_window(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer_path("byte_bpe_50k.json")
    lib, t = tokenizers.Tokenizer.from_file(path), Transducer(open(path, encoding="utf-8").read())
    raw = "".join(random.Random(3).choice("abeinorst") for _ in range(6000))
    want = t.merged([t.symbol[b] for b in raw.encode()])
    held, emitted, merged, stream = [], [], t.merged, t.stream
    t.merged = lambda ids: held.append(len(ids)) or merged(ids)
    t.stream = lambda parts: (emitted.append(len(ids)) or ids for ids in stream(parts))
    t.special = {}

    class Forgets(dict):
        def __setitem__(self, key, value):
            pass

    t.cache = Forgets()
    assert list(t.encode(raw)) == want and len(emitted) > 5
    for x in [*texts(300, 13), "word " * 900, "日本" * 400 + "e" * 1500 + " end", raw]:
        held.clear(), emitted.clear()
        ids = lib.encode((x or "").replace("<|", "<"), add_special_tokens=False).ids
        assert list(t.encode((x or "").replace("<|", "<"))) == ids and sum(emitted) == len(ids)
        assert max(held, default=0) <= t.lookahead + 2 * t.window
    # small blocks cut a text as well as large ones
    for chars in (1, 7, 64):
        monkeypatch.setattr("forerun.llm.bpe_stream.BLOCK_CHARS", chars)
        for x in texts(300, 14):
            x = (x or "").replace("<|", "<")
            assert list(t.encode(x)) == lib.encode(x, add_special_tokens=False).ids


def test_chunk_encoder_equals_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer_path("word_bpe_49k.json")
    lib, e = tokenizers.Tokenizer.from_file(path), T.ChunkEncoder(open(path, encoding="utf-8").read())
    rows = texts(2500, 4)
    for _ in range(2):  # cold, then known
        ids, n = e.encode(rows, 2)
        at = 0
        for x, k in zip(rows, n.tolist()):
            assert ids[at : at + k].tolist() == [*lib.encode(x or "", add_special_tokens=False).ids, 2]
            at += k


def test_chunks_that_hash_alike_keep_their_own_ids(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer_path("word_bpe_49k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    rows = [*texts(60, 15), "one two three", "a" * 17 + "x" + "b" * 17, "a" * 17 + "y" + "b" * 17, "<|ENDOFTEXT|> x"]
    monkeypatch.setattr(T.Chunks, "hashes", lambda self: (self.end - self.start).astype(np.uint64) % np.uint64(3))
    e = T.ChunkEncoder(open(path, encoding="utf-8").read())
    for _ in range(2):
        ids, n = e.encode(rows, 2)
        parts = np.split(ids, np.cumsum(n)[:-1])
        assert [p.tolist() for p in parts] == [[*lib.encode(x or "", add_special_tokens=False).ids, 2] for x in rows]


def test_known_chunks_are_looked_up_not_sorted(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer_path("word_bpe_49k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    rows = texts(400, 17)
    want = [[*lib.encode(x or "", add_special_tokens=False).ids, 2] for x in rows]

    def got(e):
        ids, n = e.encode(rows, 2)
        return [p.tolist() for p in np.split(ids, np.cumsum(n)[:-1])]

    e = T.ChunkEncoder(open(path, encoding="utf-8").read())
    assert got(e) == want
    handled, unique = [], np.unique
    with monkeypatch.context() as m:
        m.setattr(T.np, "unique", lambda x, **how: handled.append(len(x)) or unique(x, **how))
        assert got(e) == want
    assert sum(handled) == 0
    # many small steps: the table grows, slots are shared, and a full memory begins anew
    step = T.steps
    monkeypatch.setattr(T, "steps", lambda x: step(x, 300))
    monkeypatch.setattr(T.Chunks, "hashes", lambda self, own=T.Chunks.hashes: own(self) >> np.uint64(8))
    for most in (1 << 20, 60):
        monkeypatch.setattr(T, "CACHE_CHUNKS", most)
        e = T.ChunkEncoder(open(path, encoding="utf-8").read())
        assert got(e) == want and got(e) == want


def test_chunks_of_other_sizes_hash_apart():
    # the first eight bytes are one more, the size is one less, the last eight bytes are the same
    w = T.Chunks([b"b" + b"a" * 14, b"a" * 16, b"b" + b"a" * 30, b"a" * 32])
    assert len(set(w.hashes().tolist())) == len(w.start) == 4


def test_grammar_is_the_same_of_words_that_hold_no_place(monkeypatch):
    rng = np.random.default_rng(18)
    for ids in (rng.integers(0, 5, 3000), np.repeat(rng.integers(0, 40, 900), rng.integers(1, 6, 900)), np.full(77, 4), np.arange(9) + T.FIRST_RULE - 9):
        ids = ids.astype(np.uint32)
        packed = T.compress(ids)
        with monkeypatch.context() as m:
            m.setattr(T, "PACKED_TOKENS", 0)
            assert all((a == b).all() for a, b in zip(packed, T.compress(ids), strict=True))


def test_grammar_leaves_no_pair_twice():
    rng = np.random.default_rng(16)
    for ids in (rng.integers(0, 5, 3000), np.tile(rng.integers(0, 50, 40), 30), np.full(77, 4), np.array([1, 1, 1]), np.array([1, 2, 1, 2])):
        rules, lengths, sequence = T.compress(ids.astype(np.uint32))
        last: dict[tuple[int, int], int] = {}
        for i, pair in enumerate(zip(sequence.tolist(), sequence.tolist()[1:])):
            assert i - last.setdefault(pair, i) < 2, pair
        assert lengths.tolist() == [len(T.expand(rules, lengths, np.array([T.FIRST_RULE + i], np.uint32))) for i in range(len(rules))]
    assert len(T.compress(np.array([1, 2, 1, 2], np.uint32))[2]) == 2


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(5)
    for ids in (np.empty(0, np.uint32), np.array([7], np.uint32), np.full(1001, 3, np.uint32), rng.integers(0, 9, 20_000).astype(np.uint32)):
        rules, lengths, sequence = T.compress(ids)
        assert (T.expand(rules, lengths, sequence) == ids).all()
        for _ in range(20):
            a = int(rng.integers(0, len(ids) + 1))
            b = int(rng.integers(a, len(ids) + 2))
            assert (T.expand(rules, lengths, sequence, a, b) == ids[a:b]).all()
    assert len(sequence) + 2 * len(rules) < 0.7 * len(ids)


def test_edit_distance_and_search():
    rng = random.Random(6)
    for _ in range(200):
        a, b = [rng.randrange(4) for _ in range(rng.randint(1, 15))], [rng.randrange(4) for _ in range(rng.randint(0, 20))]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert D.edit_distance(a, b) == (min(row), row.index(min(row)))


def test_decontamination_finds_edited_items_and_no_others():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 60))) for _ in range(40)]
    index = D.build([*range(40), None, 99], [*items, "x", "too short"])
    docs, truth = [], []
    for _ in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 200))]
        k = rng.randrange(40)
        w = items[k].split()
        for _ in range(int(0.2 * len(w))):
            i = rng.randrange(len(w))
            w[i : i + 1] = rng.choice([["zz"], [], [w[i], "yy"]])
        at = rng.randrange(len(words) + 1)
        docs.append(" ".join(words[:at] + w + words[at:]).upper())
        truth.append(k)
    clean = [" ".join(rng.choice(vocabulary) for _ in range(150)) for _ in range(100)]
    found = {}
    for d, item, *_ in D.matches(docs + clean + [None, ""], index):
        found.setdefault(d, set()).add(item)
    assert sum(k in found.get(d, ()) for d, k in enumerate(truth)) >= 0.95 * len(truth)
    assert all(d < len(docs) for d in found)


def test_decontamination_equals_brute_force():
    rng = random.Random(26)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 30))) for _ in range(12)]
    docs = []
    for _ in range(60):
        w = rng.choice(items).split()
        for _ in range(rng.randint(0, int(0.3 * len(w)))):
            i = rng.randrange(len(w))
            w[i : i + 1] = rng.choice([["zz"], [], [w[i], "yy"]])
        around = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        at = rng.randrange(len(around) + 1)
        docs.append(" ".join(around[:at] + w + around[at:]))
    index = D.build([*range(12)], items)
    assert all(c.recall >= 0.95 for c in index.classes)
    want = {}
    for d, text in enumerate(docs):
        t = text.split()
        for i, item in enumerate(items):
            w = item.split()
            near = min(D.edit_distance(w, t[a : a + len(w) + int(0.2 * len(w))])[0] for a in range(len(t)))
            if near <= int(0.2 * len(w)):
                want[d, i] = near
    got = {(d, i): distance for d, i, _, _, distance in D.matches(docs, index)}
    assert got.keys() <= want.keys() and len(got) >= 0.95 * len(want) > 30
    assert sum(got[k] == want[k] for k in got) >= 0.95 * len(got)  # the nearest place is rarely another one


def test_decontamination_finds_every_short_item():
    rng = random.Random(8)
    items = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    docs = [" ".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 40))) for _ in range(150)] + [None, ""]
    want = {}
    for d, text in enumerate(docs):
        t = (text or "").split()
        for i, item in enumerate(items):
            w = item.split()
            near = min(((D.edit_distance(w, t[a : a + len(w) + 1])[0], a) for a in range(len(t))), default=(9, 0))
            if near[0] <= int(0.2 * len(w)):
                want[d, i] = near[0]
    got = {(d, i): distance for d, i, _, _, distance in D.matches(docs, D.build([*range(60)], items))}
    assert got == want and set(want.values()) == {0, 1}


def test_decontamination_in_scripts_without_spaces():
    items = ["中国的首都是哪里", "東京", "ประเทศไทย"]
    docs = ["我想知道中国的首都是哪里。谢谢", "中国的首都在哪里呢", "これは東京です", "ในประเทศไทยมี", "北京和东京", "no such text"]
    assert [(d, i) for d, i, *_ in D.matches(docs, D.build([0, 1, 2], items))] == [(0, 0), (1, 0), (2, 1), (3, 2)]


def test_phrases_equal_brute_force_across_blocks():
    rng = random.Random(8)
    ref = "".join(rng.choice("abc") for _ in range(300)) + "abc" * 400
    automaton = L.suffix_automaton([ord(x) - 97 for x in ref])
    automaton.owner, automaton.to = np.append(automaton.owner, [-1] * 8), np.append(automaton.to, [0] * 8)
    rows = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 900))) for _ in range(60)]
    rows += ["abc" * 380, "ab" + "abc" * 700 + "d" + "bca" * 300, "d" * 70, "cab" * 90 + "dd"]  # phrases longer than blocks
    want = []
    for t in rows:
        i = n = 0
        while i < len(t):
            j = i + 1
            while j <= len(t) and t[i:j] in ref:
                j += 1
            i, n = max(j - 1, i + 1), n + 1
        want.append(n)
    for width in (16, 64, 256):
        blocks, length, follows, owner = [], [], [], []
        for k, t in enumerate(rows):
            for a in range(0, len(t), width):
                part = [ord(x) - 97 for x in t[a : a + width]]
                follows.append(len(blocks) - 1 if a else -1)
                blocks.append(part + [0] * (width - len(part)))
                length.append(len(part))
                owner.append(k)
        got = L.phrases(automaton, np.array(blocks, np.int32), np.array(length), np.array(follows))
        assert np.bincount(owner, got).astype(int).tolist() == want


def test_languages_of_large_alphabets_are_told_apart():
    rng = random.Random(9)
    texts = {"x": [], "y": []}
    for name, first in (("x", 0x4E00), ("y", 0x5200)):  # words of two of a thousand signs each
        lexicon = [chr(first + rng.randrange(1000)) + chr(first + rng.randrange(1000)) for _ in range(800)]
        texts[name] = ["".join(rng.choice(lexicon) for _ in range(40)) for _ in range(80)]
    model = L.fit({n: t[:60] for n, t in texts.items()})
    assert len(model.alphabet) > 1000
    assert L.predict(texts["x"][60:] + texts["y"][60:], model)[0] == ["x"] * 20 + ["y"] * 20


def test_language_edges():
    model = L.fit({"x": ["alpha beta gamma"] * 5, "y": ["uno dos tres"] * 5})
    names, scores = L.predict([None, "", "12 !?", "ALPHA beta", "dos uno " * 2000], model)
    assert names == ["und", "und", "und", "x", "y"] and scores[0] == 0 and 0 <= scores.min() <= scores.max() <= 1
    assert L.predict(["abc"], L.fit({}))[0] == ["und"]


def test_maxscore_equals_brute_force():
    rng = np.random.default_rng(9)
    for n, d, lo in ((2000, 16, -20), (900, 8, 0), (30, 4, -3)):
        x = rng.integers(lo, 21, (n, d)).astype(float)
        x[n // 2 :: 7] = x[0]  # ties
        ids = np.sort(rng.choice(10 * n, n, replace=False))
        cols = np.ascontiguousarray(x.T)
        for q in range(0, n, max(1, n // 25)):
            rows, score = K.maxscore(x[q], cols, cols.min(1), cols.max(1), ids, ids[q], 20)
            full = x @ x[q]
            want = [r for r in np.lexsort((ids, -full)) if r != q][:20]
            assert ids[rows].tolist() == ids[want].tolist() and score.tolist() == full[want].tolist()


def test_boosting_learns_and_handles_edges():
    rng = np.random.default_rng(10)
    x = rng.normal(size=(3000, len(Q.FEATURES)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    p = Q.fit(x[:2000], y[:2000]).score(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.9
    assert Q.fit(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3
    assert Q.features([None, "", "word word", "A!! B!!"]).shape == (4, len(Q.FEATURES)) and np.isfinite(Q.features([None, "a\n\na"])).all()


def test_forest_equals_traversal_row_by_row():
    rng = np.random.default_rng(22)
    x = rng.normal(size=(600, len(Q.FEATURES))).round(1)  # many values equal a cut
    model = Q.fit(x, (x[:, 2] * x[:, 5] > 0).astype(float))
    assert len(model.feature) == Q.ROUNDS
    for row, got in zip(x[:150], model.score(x[:150])):
        total = model.base
        for feature, cut, value in zip(model.feature.tolist(), model.cut.tolist(), model.value.tolist()):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            total += value[node - len(feature)]
        assert got == pytest.approx(1 / (1 + np.exp(-total)))


def test_statistics_equal_naive_ones():
    at = {name: i for i, name in enumerate(Q.FEATURES)}
    for text, row in zip(rows := [*texts(200, 23), "One two two one two. END!\n\nsame line\nsame line\n x", "aaaaaaaaaaaaaaaaaaaa b"], Q.features(rows)):
        raw = (text or "").encode()
        words = [w for w in re.split(rb"[\x20\x09-\x0d]+", raw) if w]
        low, lines = [w.lower() for w in words], [x for x in raw.split(b"\n") if x.strip()]
        n, m = len(raw), len(words)
        want = {"lower": sum(97 <= c < 123 for c in raw) / max(n, 1), "digit": sum(48 <= c < 58 for c in raw) / max(n, 1), "high": sum(c > 127 for c in raw) / max(n, 1), "shout": raw.count(b"!") / max(n, 1), "n_bytes": np.log1p(n), "n_words": np.log1p(m)}
        if m:
            size = [len(w) for w in words]
            want |= {"mean_word": np.mean(size), "spread_word": np.std(size), "long_words": np.mean([x > 14 for x in size]), "short_words": np.mean([x < 3 for x in size]), "distinct": len(set(low)) / m, "one_word_max": max(low.count(w) for w in low) / m}
            want |= {"adjacent": np.mean([a == b for a, b in zip(low, low[1:])]) if m > 1 else 0, "skip": np.mean([a == b for a, b in zip(low, low[2:])]) if m > 2 else 0}
            want |= {"lines": np.log1p(len(lines)), "line_words": m / max(len(lines), 1), "repeated_lines": 1 - len(set(lines)) / max(len(lines), 1), "caps_words": np.mean([2 * sum(65 <= c < 91 for c in w) > len(w) for w in words])}
        for name, value in want.items():
            assert row[at[name]] == pytest.approx(value, abs=1e-9), (name, text)


def test_toxicity_equals_naive_windows():
    rng = np.random.default_rng(24)
    gram = rng.normal(size=X.BUCKETS)
    rows = [*texts(120, 25), "one two three four five six seven eight nine ten eleven twelve thirteen fourteen " * 3, "same same same other", None]
    for text, got in zip(rows, X.logits(rows, gram, -0.25)):
        words, scores = re.findall(rb"[^\x20\x09-\x0d.,;:!?\"()\[\]{}|]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())), []
        words = [w for i, w in enumerate(words) if not i or words[i - 1] != w]
        for w in words:
            chars = [257, *w, 258]
            grams = []
            for n in X.GRAMS:
                for i in range(len(chars) - n + 1):
                    h = 0
                    for c in chars[i : i + n]:
                        h = (h * 0x100000001B3 + c) % (1 << 64)
                    grams.append(int(X.mix(np.array([(h + (n << 56)) % (1 << 64)], np.uint64))[0] >> np.uint64(64 - 17)))
            scores.append(np.mean(gram[grams]))
        begins = range(0, max(len(words) - X.WINDOW // 2, 1), X.WINDOW // 2)
        want = max((sum(scores[a : a + X.WINDOW]) / X.WINDOW - 0.25 for a in begins), default=-0.25) if words else -0.25
        assert got == pytest.approx(want)


def test_toxicity_learns_unseen_misspellings():
    rng = random.Random(11)
    plain = ["".join(rng.choice("abcdeiotrs") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows, y = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 120))]
        if i % 4 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["grumblefuzz", "snarkwompus"]))
        rows.append(" ".join(words))
        y.append(i % 4 == 0)
    model = X.fit(rows, np.array(y, float))
    got = X.logits([rows[0], rows[1], "ab grumblefuzzz cd", "ab cd", None], model.gram_scores(), model.bias)
    assert got[0] > 0 > got[1] and got[2] > 0 > got[3] and np.isfinite(got).all()


def lm_model(rows, passes):
    words, offset = M.words_of([(r or "").encode() for r in rows])
    flat = M.initial()
    for _ in range(passes):
        flat = M.learn(flat, M.short(words), offset)
    known, n = np.unique(words, return_counts=True)
    return M.Model(flat, len(words), known, n, known, n / len(words))


def test_lm_predicts_the_word_between_its_neighbours():
    rows = ["one two three four five six seven eight " * 40] * 12 + ["one three five seven two four six eight " * 40] * 12
    start, model = lm_model(rows, 0), lm_model(rows, 8)
    before, after = (sum(r[2] for r in M.log_probabilities(rows, m)) for m in (start, model))
    assert after / model.total > -1.2 > -2 > before / model.total  # eight words alike: -2.08 without a context
    assert [r[1:3] for r in M.log_probabilities([None, ""], model)] == [(0, 0.0)] * 2


def test_lm_equals_a_naive_softmax_over_the_whole_vocabulary():
    rng = random.Random(21)
    rows = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(0, 40))) for _ in range(60)] + [None]
    model = lm_model(rows, 2)
    vectors, w1, b1, w2, out = M.unpack(model.flat)
    share = dict(zip(model.known.tolist(), (model.counts / model.total).tolist()))
    ids = {h: int(M.short(np.array([h], np.uint64))[0]) for h in share}
    for row, (_, n, got, rare) in zip(rows, M.log_probabilities(rows, model)):
        words, total = M.words_of([(row or "").encode()])[0].tolist(), 0.0
        for i, w in enumerate(words):
            around = [words[j] if 0 <= j < len(words) else None for j in (i - 2, i - 1, i + 1, i + 2)]
            x = np.concatenate([vectors[0 if c is None else 1 + (ids[c] >> 20) % (M.ROWS - 1)] for c in around])
            expected = np.tanh(x @ w1 + b1) @ w2
            mass = {v: share[v] * np.exp(expected @ (out[ids[v] & 4095] + out[ids[v] >> 12 & 4095])) for v in share}
            total += np.log(mass[w] / sum(mass.values()))
        assert n == len(words) and got == pytest.approx(total, abs=1e-3) and len(rare) == 0


def test_crc_fold_is_the_standard_one():
    assert zlib.crc32(b"123") % 5 == zlib.crc32(str(123).encode()) % 5


def test_license_notices_inside_long_lines_and_across_lines():
    prose = "the river ran past a mill and nobody knew who had built it " * 30
    for name, notice in (
        ("MIT", "Copyright 2024 Example Corp. Released under the MIT License. See LICENSE in the project root for details."),
        ("Apache-2.0", "This file, as all others here, is licensed under the Apache License, Version 2.0, see the file LICENSE for the full text."),
        ("GPL-3.0", "The tools beside it are licensed under the GNU General Public License, version 3, or later."),
        ("GPL-2.0", "The tools beside it are licensed under the GNU\nGeneral Public License,\nversion 2, and no other."),
    ):
        for text in (notice, prose + notice + " " + prose, (prose + notice.replace("\n", " ") + " " + prose).replace(" ", "\n")):
            found = C.Scanner().best(text)
            assert found and C.TEMPLATES[-found[1]][0] == name and found[0] >= 0.9
    for text in (prose, "It was released under the old license of the town.", "A licence to print money, he said.", "", "İ License"):
        assert C.Scanner().best(prose + text + prose) is None
    long = "x " * (C.BLOCK - 3) + "released under the MIT License " + "y " * 50
    assert C.Scanner().best(long)[0] == 1
