"""Classifier, rules and class model: counts against brute force, accuracy on held-out rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from morphloom.llm import class_lm as L
from morphloom.llm import linear_text as X
from morphloom.llm import quality_model as Q
from morphloom.llm import quality_rules as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    where = {}
    for i in range(len(words) - 2):
        where.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text("ab é \n\t#日\x0b", max_size=60))
def test_counts(text):
    assert R.text_counts(text) == brute_counts(text)


def test_counts_of_null_and_very_long_texts():
    assert R.text_counts(None) == (0, 0, 0, 0, 0)
    text = "x" * 700_000 + " " + "lorem ipsum dolor " * 40_000
    assert R.text_counts(text) == brute_counts(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abé", min_size=1, max_size=5), max_size=20))
def test_word_hashes_tell_words_apart(words):
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    s, e = X.word_spans(raw)
    h = X.word_hashes(raw, s, e).tolist()
    assert len(h) == len(words)
    assert [h.index(x) for x in h] == [words.index(w) for w in words]


def test_sparse_rows_and_dots_agree():
    f = X.Features((1, 2), (1, 2), (3,))
    w = np.random.default_rng(0).normal(size=1 << f.bits).astype(np.float32)
    for t in ("", None, "one", "a b a b C!! c", "é" * 50):
        i, x = f.sparse(t)
        assert f.dot(t, w) == pytest.approx(float(w[i].astype(float) @ x.astype(float)), abs=1e-4)


def corpus(n=600):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(60, 120))]
        rows.append((i, " ".join(w if good else w + rng.choice(["&&&", "%%%", "!!"]) for w in words), "en", i))
        labels.append((i, int(good), 0))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    rows += [(1000, None, "en", 1), (1001, "", "en", 1), (None, "a b", None, 2), (5, rows[5][1], "en", 3)]
    labels += [(None, 0, 0), (3, None, 1), (7, 2, 0), (3, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier(tables):
    docs, labels = tables
    got = Q.classify(docs, Q.quality_model(docs, labels)).collect()
    assert len(got) == 604 and {r["lang"] for r in got} == {"en", None}
    held = [r for r in got if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    right = sum(r["predicted"] == int(r["doc_id"] % 4 != 0) for r in held if r["doc_id"] < 1000)
    assert right >= 0.95 * sum(r["doc_id"] < 1000 for r in held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    empty = {r["doc_id"]: r["score"] for r in got if r["doc_id"] in (1000, 1001)}
    assert empty[1000] == empty[1001]


def test_held_out_labels_are_never_used(tables, spark):
    from pyspark.sql import functions as F

    docs, labels = tables
    wrong = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = Q.quality_model(docs, labels), Q.quality_model(docs, wrong)
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_without_labels_nothing_is_known(tables):
    docs, labels = tables
    model = Q.quality_model(docs, labels.limit(0))
    assert {r["score"] for r in Q.classify(docs.limit(5), model).collect()} == {0.5}


def test_rules(tables):
    docs, labels = tables
    got = R.apply_rules(docs, R.rules_model(docs, labels)).collect()
    for r in got:
        n, chars, signs, dups, again = brute_counts(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, signs, dups, again)
        assert r["base_failed"] == (n < 50 or 100 * again > 50 * n)
        assert r["kept"] == (not r["base_failed"] and r["probability"] >= 0.3)
    known = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 1000]
    assert sum(r["kept"] == (r["doc_id"] % 4 != 0) for r in known) >= 0.95 * len(known)


def test_calibration_moves_towards_the_frequencies():
    rng = np.random.default_rng(2)
    z = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(3 * z - 1)))).astype(int)
    m = X.Model(X.Features(), np.zeros(4, np.float32))
    X.calibrate(m, z, y, np.ones(4000))
    assert m.slope == pytest.approx(3, abs=0.4) and m.shift == pytest.approx(-1, abs=0.25)
    X.calibrate(m, z, np.ones(4000, int), np.ones(4000))  # one label: as before
    assert m.slope == pytest.approx(3, abs=0.4)


def lm_docs(n=160):
    rng = random.Random(9)
    sets = [[f"{p}{i}" for i in range(30)] for p in "ab"]
    rows = [(i, " ".join(rng.choice(sets[i % 2]) for _ in range(40))) for i in range(n)]
    return [*rows, (500, None), (501, ""), (502, "A0 a0\x0bnever"), (3, rows[3][1])]


def test_class_model(spark, monkeypatch):
    rows = lm_docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = L.score(docs, *L.train(docs)).collect()
    words = lambda t: WORD.findall((t or "").lower())
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for t in train for w in words(t))
    counts["</s>"] = len(train)
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows) and {r["train_tokens"] for r in got} == {n}
    text = dict(rows)
    for r in got:
        toks = [*words(text[r["doc_id"]]), "</s>"]
        assert r["n_tokens"] == len(toks) and r["n_known"] == sum(counts[w] > 0 for w in toks)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in toks))
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
    held = [r for r in got if r["held_out"] and r["n_tokens"] > 10]
    # two vocabularies that never mix: classes that follow each other tell more than frequencies
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.15 * sum(r["n_tokens"] for r in held)


def test_class_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame(lm_docs(60), "doc_id long, text string")
    model, _ = L.train(docs)
    assert np.allclose((10**model.transition).sum(axis=1), 1)
    places = np.array(list(model.ids.values()))
    counts = np.array([model.counts[w] for w in model.ids], float)
    for c in set(model.classes[places]):
        own = model.classes[places] == c
        assert (10 ** L.emission(model, counts[own], np.full(own.sum(), c))).sum() == pytest.approx(1)


def test_rare_words_take_the_shuffled_way(spark, monkeypatch):
    docs = spark.createDataFrame(lm_docs(60), "doc_id long, text string")
    whole = {(r["doc_id"], r["n_known"], round(r["base_score"], 6)) for r in L.score(docs, *L.train(docs)).collect()}
    monkeypatch.setattr(L, "FREQUENT", 5)
    monkeypatch.setattr(L, "CLUSTERED", 4)
    assert {(r["doc_id"], r["n_known"], round(r["base_score"], 6)) for r in L.score(docs, *L.train(docs)).collect()} == whole


def test_words_beyond_the_most_frequent_have_learned_classes(spark, monkeypatch):
    rows = lm_docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(L, "CLUSTERED", 12)
    monkeypatch.setattr(L, "FREQUENT", 20)  # others meet their classes in the shuffle
    model, table = L.train(docs)
    learned = {r["word"]: (r["n"], r["class"]) for r in table.collect()}
    words = lambda t: WORD.findall((t or "").lower())
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    seen = Counter(w for t in train for w in words(t))
    of = {w: learned[L.name(w.encode())] for w in seen}
    assert {w: n for w, (n, _) in of.items()} == seen
    assert all((c < L.CLASSES) == (n >= L.LEARNED) for n, c in of.values())
    # the two vocabularies never mix, so their words share no class
    assert not {c for w, (n, c) in of.items() if n > 1 and w[0] == "a"} & {c for w, (n, c) in of.items() if n > 1 and w[0] == "b"}
    # transitions are those of the learned classes
    end, n_all = L.CLASSES + L.OPEN, L.CLASSES + L.OPEN + 1
    trans, size = np.zeros((n_all, n_all)), np.zeros(n_all)
    for t in train:
        chain = [end, *(of[w][1] for w in words(t)), end]
        np.add.at(trans, (chain[:-1], chain[1:]), 1)
        np.add.at(size, chain[1:], 1)
    prior = (size + 1) / (size.sum() + n_all)
    assert np.allclose(10**model.transition, (trans + L.STRENGTH * prior) / (trans.sum(axis=1, keepdims=True) + L.STRENGTH))
    kinds = Counter(c for _, c in of.values())
    text = dict(rows)
    for r in L.score(docs, model, table).collect():
        toks = words(text[r["doc_id"]])
        pairs = [of.get(w, (0, L.CLASSES + L.open_class(w.encode()))) for w in toks]
        chain = [end, *(c for _, c in pairs), end]
        emitted = sum(math.log10((n + 1) / (size[c] + kinds[c] + 1) if c >= L.CLASSES else n / size[c]) for n, c in pairs)
        assert r["score"] == pytest.approx(emitted + model.transition[chain[:-1], chain[1:]].sum())


def test_exchange_never_loses_likelihood():
    rng = np.random.default_rng(7)
    words, n_classes, n_all = 60, 6, 9
    pairs = rng.poisson(0.4, (words + 3, words + 3)).astype(float) + np.diag(rng.poisson(3, words + 3))
    pairs[:30, 30:60] += rng.poisson(4, (30, 30))
    classes = np.concatenate([np.arange(words) % n_classes, n_classes + np.arange(3)])

    def by_hand(c):
        t = np.zeros((n_all, n_all))
        np.add.at(t, (c[:, None], c[None, :]), pairs)
        p = t / np.maximum(t.sum(axis=1, keepdims=True), 1) / np.maximum(t.sum(axis=0), 1)
        return float((t * np.log(np.where(t > 0, p, 1))).sum())

    told = [by_hand(classes)]
    now = classes
    for w in range(words):  # a word at a time: each move is the best of all, by full recounts
        one = np.concatenate([[w], np.delete(np.arange(words + 3), w)])
        after, trans, values = L.exchange(pairs[np.ix_(one, one)], now[one], 1, n_classes, n_all, 1)
        back = now.copy()
        back[w] = after[0]
        best = max(by_hand(np.where(np.arange(words + 3) == w, c, now)) for c in range(n_classes))
        assert by_hand(back) == pytest.approx(best) and values[-1] == pytest.approx(best)
        now = back
        told.append(best)
    assert all(b >= a - 1e-9 for a, b in zip(told, told[1:]))
    final, trans, values = L.exchange(pairs, classes, words, n_classes, n_all)
    assert all(b >= a - 1e-9 for a, b in zip(values, values[1:])) and values[-1] > values[0]
    assert values[-1] == pytest.approx(by_hand(final)) and (final[words:] == classes[words:]).all()


def test_rare_words_join_by_all_their_neighbours(spark, monkeypatch):
    monkeypatch.setattr(L, "FLUSH", 3)  # words come in many parts
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randint(0, 30)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    ids = {L.name(w.encode()): i for i, w in enumerate(["ax", "by", "cz"])}
    table = np.random.default_rng(3).normal(size=(2 * L.CLASSES + 2, L.CLASSES)).astype(np.float32)
    got = {r["word"]: (r["n"], r["class"]) for r in L._joined(L._contexts(docs, ids), table).collect()}
    want, gain = Counter(), {}
    for _, t in rows:
        seq = [None, *(L.name(w.encode()) for w in t.split()), None]
        kind = {L.name(w.encode()): L.CLASSES + L.open_class(w.encode()) for w in t.split()}
        of = lambda w: L.CLASSES if w is None else ids.get(w)
        for x, w, y in zip(seq, seq[1:], seq[2:]):
            if w not in ids:
                want[w] += 1
                g = gain.setdefault(w, [np.zeros(L.CLASSES), kind[w]])
                g[0] += (table[of(x)] if of(x) is not None else 0) + (table[L.CLASSES + 1 + of(y)] if of(y) is not None else 0)
    assert got == {w: (n, int(gain[w][0].argmax()) if n >= L.LEARNED else gain[w][1]) for w, n in want.items()}


def test_class_model_of_very_long_texts_and_other_columns(spark):
    long = " ".join(f"w{i % 700}" for i in range(200_000))
    rows = [(1, long, "x"), (2, "w1 w2 w3", None), (2, "w1 w2 w3", None), (4, "w" * 100_000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = L.score(docs, *L.train(docs))
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got.collect()) == [(1, 200_001), (2, 4), (2, 4), (4, 2)]


def test_class_model_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert L.score(docs, *L.train(docs)).count() == 0


def test_most_frequent_are_those_of_a_full_sort(spark):
    from morphloom.llm.counts import most_frequent

    rng = random.Random(12)
    rows = [(f"w{i}", int(rng.paretovariate(0.7))) for i in range(3000)]
    df = spark.createDataFrame(rows, "word string, n long")
    for k in (1, 50, 2999, 5000):
        assert [(r["word"], r["n"]) for r in most_frequent(df, "word", k)] == sorted(rows, key=lambda r: (-r[1], r[0]))[:k]
    assert most_frequent(df.limit(0), "word", 5) == []


def test_rows_beyond_the_memory_are_learned_from_in_each_epoch():
    rng = np.random.default_rng(5)
    rows = [(rng.choice(1 << 8, 12, replace=False).astype(np.int32), rng.random(12), int(i % 3 == 0), 1.0) for i in range(60)]
    whole, spilled = (X.train_ftrl(rows, X.Features(bits=8), keep_bytes=k) for k in (10**9, 2000))
    assert np.array_equal(whole.weights, spilled.weights) and whole.bias == spilled.bias


def test_a_very_long_text_takes_memory_in_slices():
    """Bytes held at once for each byte of the text; 14 for the counts, 38 for the score and 92 for a row of training when whole arrays were made."""
    import tracemalloc

    rng = random.Random(1)
    text = " ".join(rng.choice(["lorem", "ipsum", "dolor"]) + str(rng.randrange(10**4)) for _ in range(400_000))
    text += text[:100_000]
    weights = np.zeros(1 << R.FEATURES.bits, np.float32)
    R.text_counts("warm up " * 9)
    for most, job in ((10, lambda: R.text_counts(text)), (16, lambda: R.FEATURES.dot(text, weights)), (16, lambda: R.FEATURES.sparse(text))):
        tracemalloc.start()
        job()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most * len(text)
