"""Each corpus operator on Spark: whole small tables against brute force, and the edge cases that its docstring defines."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from forerun.llm import bpe_stream, decontaminate, language, licenses, lm_score, ngram_join, quality, token_files, topk_search, toxicity
from forerun.llm.components import components

tokenizers = pytest.importorskip("tokenizers")
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, rep long"


@pytest.fixture(scope="module")
def documents(spark):
    """The smallest test table with rows that are null, empty, long, repeated, and columns whose names clash."""
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars", F.lit(0.5).alias("score"), F.lit(1).cast("long").alias("rep"))
    long = "alpha beta gamma delta epsilon " * 4000
    odd = [(9001, None, None, None, None, None, None), (9002, "", "en", "s", 0, 0.0, 0), (9003, " \n\t ", "en", "s", 4, 0.0, 0), (None, "some words without an id stand here", "en", "s", 9, 0.0, 0), (9004, long, "en", "s", len(long), 0.0, 0), (9005, long, None, None, None, None, None), (9006, "two words", "en", "s", 9, 0.0, 0), (9006, "two words", "en", "s", 9, 0.0, 0)]
    return base.unionByName(spark.createDataFrame(odd, DOCS)).repartition(3).cache()


@pytest.fixture(scope="module")
def rows(documents):
    return [(r["doc_id"], r["text"]) for r in documents.collect()]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").unionByName(spark.createDataFrame([(None, 1, 0), (9001, None, None), (9004, 1, None)], "doc_id long, quality int, toxic int"))


def ids(values):
    return sorted(values, key=lambda x: (x is None, x))


def word_sets(rows):
    word, out = re.compile(r"[^\x20\x09-\x0d]+"), {}
    for d, t in rows:
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.setdefault(d, {tuple(w[j : j + 4]) for j in range(len(w) - 3)} or ({tuple(w)} if w else set()))
    return out


def linked(sets, percent=85):
    """Smallest reachable id of each document, by comparing all pairs that share a shingle."""
    by = collections.defaultdict(list)
    for d in sorted(k for k in sets if k is not None):
        for s in sets[d]:
            by[s].append(d)
    shared = collections.Counter((a, b) for group in by.values() for i, b in enumerate(group) for a in group[:i])
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            top[b] = a
    return {d: find(d) for d in sets}


def test_ngram_join_equals_brute_force(spark, documents, rows):
    got = ngram_join.join(documents).collect()
    sets = word_sets(rows)
    want = linked(sets)
    assert ids(r["doc_id"] for r in got) == ids(d for d, _ in rows)
    for r in got:
        assert r["n_shingles"] == len(sets[r["doc_id"]])
        assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]])
    assert {r["doc_id"]: r["component_id"] for r in got}[9005] == 9004
    assert ngram_join.join(documents.limit(0)).count() == 0


def test_ngram_join_of_a_large_group_of_near_copies(spark):
    words = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(300):
        w = words[:]
        w[i % 57] = f"x{i}"
        docs.append((i, " ".join(w if i % 3 else words)))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == linked(word_sets(docs))
    assert set(got.values()) == {0}


def test_one_of_each_keeps_the_smallest(spark):
    df = spark.createDataFrame([(3, "a b c d e f"), (1, "a b c d e f"), (2, "other words are in this one"), (1, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    assert ids(r["doc_id"] for r in ngram_join.one_of_each(df).collect()) == [1, 2, None]


def test_rows_that_share_an_id_are_one_document(spark):
    df = spark.createDataFrame([(3, "a b c d e f"), (5, "a b c d e f"), (5, "u v w x y z"), (7, "u v w x y z"), (8, "nothing like it is here"), (None, "a b c d e f")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in ngram_join.join(df).collect())
    assert got == [(0, None), (3, 3), (5, 3), (5, 3), (7, 3), (8, 8)]
    assert sorted((r["doc_id"] or 0, r["text"]) for r in ngram_join.one_of_each(df).collect()) == [(0, "a b c d e f"), (3, "a b c d e f"), (8, "nothing like it is here")]
    # the survivor of an id is the first by text, then by the other columns, however the rows are dealt
    rows = [(3, "u v w x y z", None, 9), (3, "a b c d e f", "x", 1), (3, "a b c d e f", "b", 2), (4, "k l m n o", "b", 2)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string, rep string, slot int").repartition(3)
        assert sorted(map(tuple, ngram_join.one_of_each(df).collect())) == [(3, "a b c d e f", "b", 2), (4, "k l m n o", "b", 2)]


def test_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (102, 101)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bpe_digests(spark, documents, rows):
    path = bpe_stream.tokenizer_path("byte_bpe_50k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    got = collections.Counter(map(tuple, bpe_stream.digests(documents, path).collect()))
    want = collections.Counter()
    for d, t in rows:
        e = lib.encode(t or "", add_special_tokens=False).ids
        want[d, len(e), hashlib.sha256(",".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(lib.decode(e, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want
    both = bpe_stream.encode_decode(documents.where("doc_id = 9006"), path).first()
    assert both["decoded"] == "two words" and both["ids"] == lib.encode("two words").ids


def test_token_files(spark, documents, rows, tmp_path):
    path = bpe_stream.tokenizer_path("word_bpe_49k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    token_files.write(documents, str(tmp_path / "t"), path)
    got = sorted(token_files.read(spark, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted(d for d, _ in rows if d is not None)
    texts, at = dict(rows), 0
    for r in got:
        e = np.array([*lib.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(e), zlib.crc32(e.tobytes())) and bytes(r["ids"]) == e.tobytes()
        at += len(e)
    symbols = sum((len(b["sequence"]) + 2 * len(b["rules"])) / 4 for b in token_files.blocks(spark, str(tmp_path / "t")).collect())
    assert symbols < 0.8 * sum(r["n_tokens"] for r in got)
    with pytest.raises(ValueError, match="ids from"):
        token_files.write(documents, str(tmp_path / "refused"), path, end_id=token_files.FIRST_RULE)
    token_files.write(documents.limit(0), str(tmp_path / "none"), path)
    assert token_files.read(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_score_every_row(spark, documents, rows, labels, module):
    model = module.train(documents, labels)
    got = module.score(documents, model).collect()
    assert ids(r["doc_id"] for r in got) == ids(d for d, _ in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= module.CUT) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    keep = ids(r["doc_id"] for r in got if r["predicted"] == (module is quality))
    kept = module.kept(documents, model)
    assert kept.columns == documents.columns and ids(r["doc_id"] for r in kept.collect()) == keep
    assert module.score(documents.limit(0), module.train(documents.limit(0), labels.limit(0))).count() == 0


def test_held_out_quality_and_toxicity(spark):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: (r["quality"], r["toxic"]) for r in marks.collect()}
    for module, at, least in ((quality, 0, 0.95), (toxicity, 1, 0.9)):
        got = [(r["predicted"], truth[r["doc_id"]][at]) for r in module.score(docs, module.train(docs, marks)).collect() if r["held_out"] and r["doc_id"] in truth]
        assert sum(a == b for a, b in got) >= least * len(got)


def test_language(spark, documents, rows):
    got = language.identify(documents, language.train(documents)).collect()
    assert ids(r["doc_id"] for r in got) == ids(d for d, _ in rows)
    truth = {r["doc_id"]: r["lang"] for r in documents.where("doc_id < 9000").collect()}
    held = [(r["lang_pred"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(a == b for a, b in held) >= 0.9 * len(held) > 0
    assert all((r["lang_pred"], r["score"]) == ("und", 0) for r in got if r["doc_id"] in (9001, 9002, 9003))


def test_lm_norm_is_the_sum_over_every_word(spark, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(f"w{int(rng.paretovariate(0.4)) % 3000}" for _ in range(200)) for _ in range(60)]
    words, offset = lm_score.words_of([t.encode() for t in texts])
    flat = lm_score.learn(lm_score.learn(lm_score.initial(), lm_score.short(words), offset), lm_score.short(words), offset)
    word, n = np.unique(words, return_counts=True)
    want = [r[2] for r in lm_score.log_probabilities(texts, lm_score.Model(flat, len(words), word, n, word, n / len(words)))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = lm_score.count_words(docs)
    got = [r[2] for r in lm_score.log_probabilities(texts, lm_score.Model(flat, *lm_score.shares(counts)))]
    assert len(word) > 500 and got == pytest.approx(want, abs=0.01)
    monkeypatch.setattr(lm_score, "KNOWN", 0)  # no count goes to the workers: all are joined
    model = lm_score.Model(flat, *lm_score.shares(counts))
    scored = {r["doc_id"]: r["log_likelihood"] for r in lm_score.score(docs, model, counts).collect()}
    assert len(model.known) == 0 and [scored[i] for i in range(len(texts))] == pytest.approx(want, abs=0.01)
    far = np.full((1, lm_score.OUT), 0, np.float32)
    far[0, 0] = 200
    cells = np.zeros((lm_score.OUT, lm_score.OUT))
    cells[1, 2] = 1
    assert lm_score.log_z(far, cells).tolist() == pytest.approx([0], abs=1e-6)


def test_lm_scores_every_document(spark, documents, rows, monkeypatch):
    for known in (lm_score.KNOWN, 50):  # with few words on the workers, the others' counts come by the join
        monkeypatch.setattr(lm_score, "KNOWN", known)
        model, counts = lm_score.train(documents)
        want_counts = collections.Counter(w for _, t in rows for w in lm_score.words_of([(t or "").encode()])[0].view(np.int64).tolist())
        assert {r["word"]: r["n"] for r in counts.collect()} == want_counts and model.total == sum(want_counts.values())
        assert len(model.known) <= known and abs(model.z_weights.sum() - 1) < 1e-6
        got = lm_score.score(documents, model, counts).collect()
        want = collections.Counter()
        for (d, _), (_, n, part, rare) in zip(rows, lm_score.log_probabilities([t for _, t in rows], model)):
            want[d, n, round(part + sum(math.log(want_counts[w]) for w in rare), 1)] += 1
        assert collections.Counter((r["doc_id"], r["n_words"], round(r["log_likelihood"], 1)) for r in got).keys() & want.keys() and len(got) == len(rows)
        near = sorted((str(r["doc_id"]), r["log_likelihood"]) for r in got)
        assert all(a[0] == b[0] and a[1] == pytest.approx(b[1], abs=0.2) for a, b in zip(near, sorted((str(d), x) for (d, _, x), k in want.items() for _ in range(k))))
        assert all(r["mean_log_prob"] is None if r["n_words"] == 0 else r["mean_log_prob"] < 0 for r in got)
    again, _ = lm_score.train(documents.repartition(7))  # the same model, however the documents are dealt
    assert (again.flat == model.flat).all() and (again.z_words == model.z_words).all()
    assert lm_score.score(documents.limit(0), *lm_score.train(documents.limit(0))).count() == 0


def test_decontamination(spark, documents, rows):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(spark.createDataFrame([(None, "x"), (777, None), (778, "too few words")], "item_id long, text string"))
    items = {r["item_id"]: r["text"] for r in bench.collect() if r["text"]}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.search(documents, bench).collect()}
    want = {(d, i) for d, t in rows for i, x in items.items() if t and i is not None and i < 777 and x in t}
    assert want <= got and want
    left = decontaminate.clean(documents, bench)
    assert left.columns == documents.columns
    assert ids(r["doc_id"] for r in left.collect()) == ids(d for d, _ in rows if d not in {g[0] for g in got})
    assert decontaminate.search(documents.limit(0), bench).count() == 0 and decontaminate.search(documents, bench.limit(0)).count() == 0


def naive_cosines(terms, named):
    """The cosine of some terms to each named text, from scratch."""
    idf, other, _ = licenses._weights([text for _, text in named])
    norm = lambda c: math.sqrt(sum((n * idf.get(t, other)) ** 2 for t, n in c.items()))
    a, out = collections.Counter(terms), []
    for _, text in named:
        b = collections.Counter(re.findall(licenses._TERM, text.lower()))
        out.append(round(sum(a[t] * b[t] * idf[t] ** 2 for t in b) / (norm(a) * norm(b)), 9) if a else 0)
    return out


def naive_notice(text):
    """(license, cosine) of a text by every line and every window of a template's size."""
    count = lambda x: re.findall(licenses._TERM, x.lower())
    terms, names, found = count(text or ""), [n for n, _ in licenses.TEMPLATES], []
    if not terms:
        return None
    for line in text.split("\n"):
        c = naive_cosines(count(line), licenses.TEMPLATES)
        found.append((max(c), -c.index(max(c))))
    for i, (name, template) in enumerate(licenses.TEMPLATES):
        size = min(len(count(template)), len(terms))
        for at in range(len(terms) - size + 1):
            if set(terms[at : at + size]) & set(count(template)):
                c = naive_cosines(terms[at : at + size], licenses.TEMPLATES)
                if c[i] > max(x for x, n in zip(c, names) if n != name):
                    found.append((c[i], -i))
    best = max(found)
    whole = naive_cosines(terms, licenses.TEMPLATES)
    if max(whole) >= licenses.LEAST_COSINE:
        return names[whole.index(max(whole))], best[0]
    return (names[-best[1]], best[0]) if best[0] >= licenses.LEAST_COSINE else None


def test_licenses(spark, rows):
    files = [("a/LICENSE", "Released under the MIT License."), ("a/b/c.py", "x = 1"), ("a/b/d.py", "# Licensed under the Apache License, Version 2.0.\ncode " + "of the tool and more " * 9), ("e.py", None), (None, "MIT License"), ("a/b/c.py", "x = 1"), ("ab/c.py", "y"), ("COPYING", "All rights reserved."), ("a/g/t", "GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n" + "everyone is permitted to copy these words " * 50), ("a/g/h/i.c", "int x;")]
    files += [(f"z/{d}.txt", t) for d, t in rows if d is not None and d < 9000 and len(t or "") < 900][:60]
    df = spark.createDataFrame(files, "path string, text string").withColumn("license", F.lit("clash"))
    got = {r["path"]: (r["license"], r["origin"]) for r in licenses.scan(df).collect()}
    assert got["a/LICENSE"] == ("MIT", None) and got["a/b/c.py"] == ("MIT", "a") and got["a/b/d.py"] == ("Apache-2.0", None)
    assert got["e.py"] == ("Proprietary", "") and got["ab/c.py"] == ("Proprietary", "") and len(got) == len({p for p, _ in files if p})
    assert got["a/g/t"] == ("GPL-3.0", None) and got["a/g/h/i.c"] == ("GPL-3.0", "a/g")
    own = {r["path"]: (r["license"], pytest.approx(r["cosine"], abs=1e-6)) for r in licenses.notices(df).where("path IS NOT NULL AND path <> 'a/g/t'").collect()}
    assert own == {p: n for p, t in files if p and p != "a/g/t" and (n := naive_notice(t))}
    marked = {r["path"]: r["license"] for r in licenses.scan(df, F.col("path").endswith("d.py")).collect()}
    assert marked["a/b/c.py"] == "Apache-2.0"
    assert licenses.scan(df.limit(0)).count() == 0


def test_license_query_keeps_every_row(spark, tmp_path):
    rows = [(-5, "MIT License released under the MIT License", "s"), (None, "All rights reserved.", "s"), (7, None, None), (7, None, None), (12, "plain words", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(((r["doc_id"], r["path"], r["license"]) for r in licenses.op8_license_scan(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(-5, "s/-1/-5.txt", "MIT"), (None, None, None), (7, "0/7.txt", None), (7, "0/7.txt", None), (12, "s/0/12.txt", None)], key=str)


def test_top_k(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(300)]
    data[41] = (41, data[0][1])
    data[42] = (42, data[0][1])
    odd = [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 8), (1003, [float("inf")] + [0.0] * 7), (None, data[0][1]), (1020, [])]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = sorted(map(tuple, topk_search.top_k(df, F.col("vec_id") % 20 == 0, 5).collect()))
    q = {i: [math.floor(64 * x) for x in v] for i, v in [*data, odd[-1]]}
    want = []
    for i in q:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i)[:5]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    assert got == sorted(want)
    assert topk_search.top_k(df.limit(0), F.lit(True)).count() == 0


def test_top_k_of_repeated_ids_and_huge_components(spark):
    data = [(0, [1.0, 2.0]), (0, [3.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [1e17, 0.0]), (3, [1e300, -1e300])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    near = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    q = [(i, [near(math.floor(64 * x)) for x in v]) for i, v in data]
    pairs = sorted((-near(sum(a * b for a, b in zip(v, w))), j) for i, v in q if i == 0 for j, w in q if j != 0)
    want = [(0, r, j, -s) for r, (s, j) in enumerate(pairs, 1)]
    assert sorted(map(tuple, topk_search.top_k(df, F.col("vec_id") == 0, 20).collect())) == want and len(want) == 8


def test_pipeline_applies_every_stage(spark):
    docs, sf = spark.read.parquet(f"{SF}/documents.parquet"), SF
    now, first = docs, [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
        if name != "bpe":
            assert now.columns == docs.columns
            now = spark.createDataFrame(now.collect(), docs.schema)
        kept[name] = [(r["doc_id"], r["text"]) for r in now.collect()] if name != "bpe" else sorted(map(tuple, now.collect()))
    want = linked(word_sets(kept["toxicity"]))
    assert sorted(d for d, _ in kept["near duplicates"]) == sorted(d for d in want if want[d] == d)
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not [d for d, t in kept["decontamination"] if any(x in t for x in items)]
    assert len(first) > len(kept["quality"]) >= len(kept["toxicity"]) > len(kept["near duplicates"]) >= len(kept["decontamination"]) > 0.5 * len(first)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == kept["bpe"]


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path, documents):
    """Nulls, empty, long and repeated texts, and columns named as the stages name theirs."""
    odd = documents.withColumns({c: F.lit(i) for i, c in enumerate(("component", "row", "slot", "label", "times"))})
    tables = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark")}
    tables["labels"] = tables["labels"].unionByName(spark.createDataFrame([(None, 1, 0), (9001, None, None), (9006, 1, 0), (9006, 0, 0)], "doc_id long, quality int, toxic int"))
    tables["benchmark"] = tables["benchmark"].unionByName(spark.createDataFrame([(None, "x"), (777, None), (778, "")], "item_id long, text string"))
    for name, limit in (("odd", None), ("empty", 0)):
        for t, frame in (tables | {"documents": odd}).items():
            (frame if limit is None else frame.limit(limit)).write.parquet(f"{tmp_path}/{name}/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    docs = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, f"{tmp_path}/odd")
        assert now.columns == docs.columns, name
        now = spark.createDataFrame(now.collect(), docs.schema)
    kept = collections.Counter((r["doc_id"], bpe_stream.digests(spark.createDataFrame([(0, r["text"])], "doc_id long, text string"), bpe_stream.tokenizer_path("byte_bpe_50k.json")).first()["ids_sha256"]) for r in now.where("doc_id IS NULL OR doc_id > 9000").collect())
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert ids(r["doc_id"] for r in got) == ids(r["doc_id"] for r in now.collect())
    assert collections.Counter((r["doc_id"], r["ids_sha256"]) for r in got if r["doc_id"] is None or r["doc_id"] > 9000) == kept
    assert max(collections.Counter(r["doc_id"] for r in got if r["doc_id"] is not None).values()) == 1


def test_near_duplicate_stage_links_five_word_shingles_at_80_percent(spark):
    rng = np.random.default_rng(17)
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = [(r["doc_id"], r["text"]) for r in base.collect()]
    for i in range(40):
        words = [f"v{x}" for x in rng.integers(0, 10_000, int(rng.integers(30, 160)))]
        docs.append((10_000 + 2 * i, " ".join(words)))
        for at in rng.choice(len(words), int(rng.integers(1, 4)), replace=False):
            words[at] = "changed"
        docs.append((10_001 + 2 * i, " ".join(words)))
    words = [f"w{i}" for i in range(100)]
    docs.append((20_000, " ".join(words)))
    words[30], words[70] = "x", "y"
    docs.append((20_001, " ".join(words)))  # 86 of 106 shingles of five words, 89 of 105 of four
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    want = linked(sets, 80)
    got = [r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(docs, "doc_id long, text string"), SF).collect()]
    assert sorted(got) == sorted(d for d in want if want[d] == d) and 20_000 in got and 20_001 not in got


def test_ngram_join_counts_every_link(spark):
    words, docs = [f"w{i}" for i in range(120)], []
    for i in range(90):
        w = words[:]
        w[3 + i % 40] = f"x{i}" if i % 5 else "same"
        docs.append((i, " ".join(w)))
    docs += [(100 + i, " ".join(words)) for i in range(6)] + [(200, "nothing like it at all"), (201, None)]
    sets = word_sets(docs)
    want = {d: sum(e != d and len(s) > 0 and 100 * len(s & t) >= 85 * len(s | t) for e, t in sets.items()) for d, s in sets.items()}
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string"), count_links=True).collect()}
    assert {d: n for d, (_, n) in got.items()} == want and want[100] == 95 and want[200] == want[201] == 0
    assert {d: c for d, (c, _) in got.items()} == linked(sets)
