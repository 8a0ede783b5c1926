"""The subword operators against a plain Python version written from their definitions."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from morphloom.functions import measures as M
from morphloom.operators import bigrams as B
from morphloom.operators import encoding as E
from morphloom.operators import evaluation as V
from morphloom.operators import merging as T
from morphloom.operators import probe as P
from morphloom.operators import scoring as S
from morphloom.operators import spectral as Z
from morphloom.operators import words as Wd
from morphloom.sources import corpus as C
from morphloom.sources import sinks

TEXTS = ["the then them\tthe\n anan", "", "aaaa aaa the 𝔞b é  the", "banana bandana banana", "   x y "]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def naive_words(texts):
    out = Counter()
    for t in texts:
        out.update("▁" + w for w in t.split())
    return out


def naive_pairs(segments, counts):
    n, order = Counter(), {}
    for w, toks in segments.items():
        for p in zip(toks, toks[1:]):
            n[p] += counts[w]
            order.setdefault(p, len(order))
    return n, order


def naive_train(counts, k, batches):
    seg, merges = {w: list(w) for w in counts}, []
    for _ in range(batches):
        n, order = naive_pairs(seg, counts)
        used, chosen = set(), {}
        for p in sorted(n, key=lambda p: (-n[p], order[p])):
            if len(chosen) == k:
                break
            if not used & set(p):
                used |= set(p)
                chosen[p] = True
                merges.append(p)
        if not chosen:
            break
        for w, toks in seg.items():
            out, i = [], 0
            while i < len(toks):
                if i + 1 < len(toks) and (toks[i], toks[i + 1]) in chosen:
                    out.append(toks[i] + toks[i + 1])
                    i += 2
                else:
                    out.append(toks[i])
                    i += 1
            seg[w] = out
    return merges, seg


def test_word_counts_match_split(spark):
    got = {r["word"]: r["cnt"] for r in Wd.word_counts(docs(spark)).collect()}
    assert got == dict(naive_words(TEXTS))


def test_bigrams_marginals_and_ppmi(spark):
    counts = naive_words(TEXTS)
    n, _ = naive_pairs({w: list(w) for w in counts}, counts)
    pairs = B.bigram_counts(Wd.segment(Wd.word_counts(docs(spark))))
    assert {(r["a"], r["b"]): r["n"] for r in pairs.collect()} == dict(n)
    z, first, second = sum(n.values()), Counter(), Counter()
    for (a, b), k in n.items():
        first[a] += k
        second[b] += k
    want = {p: math.log((k / z + 1e-12) / (first[p[0]] / z * second[p[1]] / z + 1e-12)) for p, k in n.items() if k >= 2}
    got = {(r["a"], r["b"]): r["ppmi"] for r in B.ppmi(pairs, 2).collect()}
    assert got == pytest.approx({p: v for p, v in want.items() if v > 0})


def test_overlapping_self_pairs(spark):
    words = spark.createDataFrame([("aaa", 3, 0, 0), ("b", 5, 0, 1), ("zz", 0, 0, 2)], "word string, cnt long, first_doc long, first_pos int")
    assert [(r["a"], r["b"], r["n"]) for r in B.bigram_counts(Wd.segment(words)).collect()] == [("a", "a", 6)]


def test_conflict_free_hand_case(spark):
    rows = [("a", "b", 5.0, 0), ("b", "c", 4.0, 1), ("c", "c", 3.0, 2), ("d", "c", 2.0, 3), ("d", "e", 1.0, 4)]
    picks = S.conflict_free(spark.createDataFrame(rows, "a string, b string, score double, first_seen int"), 10)
    assert [p.token for p in picks] == ["ab", "cc", "de"]


def test_merging_is_simultaneous(spark):
    df = spark.createDataFrame([(["a", "a", "a", "b"],), (["x"],), (["a", "b", "c"],), ([],)], "toks array<string>")
    assert [r[0] for r in df.select(T.merged(F.col("toks"), [("a", "a")])).collect()][0] == ["aa", "a", "b"]
    # a token just made isn't merged again in the same pass
    got = df.select(T.merged(F.col("toks"), [("a", "b"), ("ab", "c")]).alias("t")).collect()
    assert [r["t"] for r in got] == [["a", "a", "ab"], ["x"], ["ab", "c"], []]


def test_training_matches_the_plain_loop(spark):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))) for _ in range(40)) for _ in range(4)]
    counts = naive_words(texts)
    merges, seg = naive_train(counts, 3, 4)
    got = T.train(Wd.word_counts(docs(spark, texts)), T.TrainConfig(batch_size=3, max_batches=4))
    assert got.merges == merges
    assert {r["word"]: r["toks"] for r in got.words.collect()} == seg
    assert all("".join(t) == w for w, t in seg.items())


def naive_encode(word, ranks):
    toks = list(word)
    while True:
        found = [(ranks[p], p) for p in zip(toks, toks[1:]) if p in ranks]
        if not found:
            return toks
        p = min(found)[1]
        out, i = [], 0
        while i < len(toks):
            if tuple(toks[i : i + 2]) == p:
                out.append("".join(p))
                i += 2
            else:
                out.append(toks[i])
                i += 1
        toks = out


@settings(max_examples=200, deadline=None)
@given(st.text("ab▁", max_size=9), st.lists(st.sampled_from([("a", "b"), ("a", "a"), ("aa", "b"), ("b", "aa"), ("ab", "a"), ("▁", "a")]), max_size=6))
def test_encode_word(word, merges):
    ranks = E.ranks_of(merges)
    got = E.encode_word(word, ranks)
    assert got == naive_encode(word, {p: i for i, p in enumerate(merges)})
    assert "".join(got) == word


def test_token_ids_fall_back_to_characters(spark):
    coded = spark.createDataFrame([("abq", ["ab", "q"]), ("xab", ["xa", "b"])], "word string, toks array<string>")
    vocab = spark.createDataFrame([("a", 0), ("ab", 1), ("b", 2)], "token string, id int")
    got = defaultdict(list)
    for r in E.token_ids(coded, vocab).orderBy("word", "pos").collect():
        got[r["word"]].append(r["id"])
    assert got == {"abq": [1], "xab": [0, 2]}
    with_unknown = vocab.unionByName(spark.createDataFrame([(E.UNKNOWN, 3)], "token string, id int"))
    assert sorted(r["id"] for r in E.token_ids(coded, with_unknown).collect()) == [1, 2, 3, 3]


def test_document_encoding_is_concatenated_words(spark):
    merges = [("▁", "t"), ("h", "e"), ("▁t", "he")]
    tokens = Wd.vocabulary(Wd.segment(Wd.word_counts(docs(spark)))).unionByName(spark.createDataFrame([(a + b,) for a, b in merges], "token string")).distinct()
    vocab = Wd.with_ids(tokens)
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    got = {r["doc_id"]: r["ids"] for r in E.encode_documents(docs(spark), merges, vocab).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == [ids[p] for w in t.split() for p in naive_encode("▁" + w, E.ranks_of(merges))]


def test_boundary_metrics(spark):
    samples = spark.createDataFrame([("abcd", 2, 3), ("abcd", 2, 3), ("xy", 1, 2)], "word string, boundary int, cnt long")
    r = V.evaluate_boundaries(samples, [("a", "b"), ("c", "d"), ("x", "y")]).first()
    assert (r["precision"], r["recall"], r["avg_tokens_per_word"]) == (1.0, 0.75, 14 / 8)
    assert r["f1"] == pytest.approx(2 * 0.75 / 1.75)
    nothing = V.evaluate_boundaries(samples.limit(0), []).first()
    assert nothing.asDict() == {"precision": 0.0, "recall": 0.0, "f1": 0.0, "boundary_acc": 0.0, "avg_tokens_per_word": 0.0}


@pytest.mark.parametrize(
    ("threshold", "want"),
    [(2.0, (0.5 * 2 * 1 + 0.5 * 1.5 * 1) / 2), (2.5, (0.5 * 2 * 1 + 0.5 * (1 + 0.75) * 0.5) / 1.5), (0.0, None), (4.0, None), (0.5, (0.5 * 2 * 1 + 0.5 * 1.5 * 1) / 3.5)],
)
def test_auc(spark, threshold, want):
    curve = spark.createDataFrame([(0, 4.0, 1.0), (1, 3.0, 1.0), (2, 2.0, 0.5)], "merges int, avg_tokens_per_word double, boundary_acc double")
    got = V.auc_over_tokens(curve, threshold).first()["auc"]
    assert got is None if want is None else got == pytest.approx(want)


def test_auc_needs_two_points(spark):
    one = spark.createDataFrame([(0, 4.0, 1.0)], "merges int, avg_tokens_per_word double, boundary_acc double")
    assert V.auc_over_tokens(one, 2.0).first()["auc"] is None


def test_rank_of_a_repeated_pair_is_the_last(spark):
    merges = spark.createDataFrame([(0, "a", "b"), (1, "c", "d"), (2, "a", "b")], "rank int, a string, b string")
    ranks = V.pair_ranks(merges, spark.createDataFrame([("a", "b"), ("q", "q")], "a string, b string"))
    assert {(r["a"], r["rank"]) for r in ranks.collect()} == {("a", 3), ("q", None)}
    assert V.rank_summary(ranks).first().asDict() == {"min_rank": 3.0, "mean_rank": 3.0, "max_rank": 3.0, "missing": 1}


def test_two_cliques_are_divided(spark):
    left, right = "abcd", "wxyz"
    rows = [(a, b, 1.0) for side in (left, right) for a in side for b in side if a < b] + [("d", "w", 0.05)]
    edges = spark.createDataFrame(rows, "a string, b string, w double")
    ids = Wd.with_ids(spark.createDataFrame([(t,) for t in left + right], "token string"))
    z = {r["token"]: r["z"] for r in Z.embedding(B.symmetric(edges), ids).collect()}
    assert len({z[t] > 0 for t in left}) == 1 and {z[t] > 0 for t in left} != {z[t] > 0 for t in right}
    assert abs(sum(z.values())) < 1e-5


def test_lanczos_agrees_with_the_dense_solver():
    rng = np.random.default_rng(1)
    n = 60
    a = np.triu(rng.random((n, n)) * (rng.random((n, n)) < 0.2), 1)
    a = a + a.T
    i, j = np.nonzero(a)
    d = a.sum(axis=1)
    dense = np.linalg.eigh(np.eye(n) - a / np.sqrt(np.outer(d, d)))[1][:, 1]
    dense = (dense - dense.mean()) / dense.std()
    assert abs(abs(float(dense @ Z.coordinates(n, i, j, a[i, j]))) / n - 1) < 1e-3


def test_small_graphs_have_no_coordinates(spark):
    assert (Z.coordinates(2, np.array([0, 1]), np.array([1, 0]), np.array([1.0, 1.0])) == 0).all()
    assert (Z.coordinates(5, np.zeros(0, int), np.zeros(0, int), np.zeros(0)) == 0).all()


def test_loops_count_twice_and_isolated_tokens_have_one(spark):
    edges = spark.createDataFrame([("a", "a", 1.5), ("a", "b", 1.0)], "a string, b string, w double")
    sym = {(r["a"], r["b"]): r["w"] for r in B.symmetric(edges).collect()}
    assert sym == {("a", "a"): 3.0, ("a", "b"): 1.0, ("b", "a"): 1.0}
    lap = {(r["a"], r["b"]): r["v"] for r in B.laplacian(B.symmetric(edges), spark.createDataFrame([("a",), ("b",), ("c",)], "token string")).collect()}
    assert lap[("c", "c")] == 1.0 and lap[("a", "a")] == pytest.approx(1 - 3 / 4)


def test_affix_probe(spark):
    text = " ".join(["happy"] * 6 + ["unhappy"] * 3 + ["play"] * 6 + ["playing"] * 2 + ["replaying"] * 2 + ["Happy"])
    got = {(r["word"], r["boundary"], r["cnt"]) for r in P.affix_probe(docs(spark, [text])).collect()}
    assert got == {("▁unhappy", 3, 3), ("▁playing", 5, 2)}
    lots = docs(spark, [text + " " + " ".join(["replaying"] * 2 + ["playing"] * 4)])
    assert ("▁replaying", 3, 4) in {(r["word"], r["boundary"], r["cnt"]) for r in P.affix_probe(lots).collect()}
    assert not {r["word"] for r in P.affix_probe(lots, exclude_affixed=True).collect()} & {"▁replaying"}


def test_split_is_positional(spark):
    got = C.split_documents(docs(spark, [str(i) for i in range(25)])).collect()
    assert {r["doc_id"] for r in got if r["part"] == "train"} == set(range(22))
    assert {r["part"] for r in C.split_documents(docs(spark, ["x"])).collect()} == {"val"}


def test_synthetic_words(spark):
    c = C.SyntheticConfig(word_types=200)
    train, val = C.synthetic_words(spark, c)
    assert val.count() == 20
    ends = dict(zip(c.end_chars, c.start_chars))
    for r in val.collect() + C.synthetic_words_distributed(spark, c).collect():
        stem, suffix = r["word"][: r["boundary"]], r["word"][r["boundary"] :]
        assert set(stem) <= set(c.stem_chars) and set(suffix) <= set(c.suffix_chars) and ends[stem[-1]] == suffix[0]
        assert 5 <= len(stem) <= 9 and 3 <= len(suffix) <= 6 and 1 <= r["cnt"] <= 200


def test_spectral_keeps_boundaries_longer_than_frequency(spark):
    from morphloom.plans.stages import synthetic_stage

    study = synthetic_stage(spark, C.SyntheticConfig(word_types=400), vocab_size=60, batch_size=10, methods=("freq", "spectral"), max_merges=10, step=5)
    rows = {r["method"]: r for r in study.summary.collect()}
    assert rows["spectral"]["cross_frac"] <= rows["freq"]["cross_frac"]
    assert study.curves.count() == 6


def test_text_stage_and_saved_model(spark, tmp_path):
    from morphloom.plans.stages import text_stage

    study = text_stage(docs(spark, TEXTS * 4), batch_size=5, methods=("freq", "ppmi_discounted"), max_batches=2, min_base=1)
    assert {r["method"] for r in study.summary.collect()} == {"freq", "ppmi_discounted"}
    study.models["freq"].save(str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m/merges")).count() == len(study.models["freq"].merges)


def test_histogram_and_moving_mean(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(31)] + [("b", 2.0)], "kind string, z double")
    rows = V.histogram(df, "kind", "z").collect()
    assert max(r["bin"] for r in rows if r["kind"] == "a") == 30
    assert sum(r["n"] for r in rows) == 32
    log = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0), (4, 5.0)], "step int, z_dist double")
    assert [(r["step"], r["z_dist"]) for r in V.moving_distance(log, 10, 2).collect()] == [(3, 2.0), (4, 4.0)]
    assert [r["step"] for r in V.moving_distance(log, 10, 9).collect()] == [1, 3, 4]


def test_measures(spark):
    r = spark.range(1).select(
        M.bits_per_byte(F.lit(4.2782), F.lit(68478), F.lit(200262)).alias("bpb"), M.sequence_length(F.lit(0.25), "byte_span", byte_span=510).alias("even"), M.sequence_length(F.lit(9.0), "byte_span").alias("most"), M.sequence_length(F.lit(9.0)).alias("fixed")
    ).first()
    assert r["bpb"] == pytest.approx(2.1105, abs=1e-4)
    assert (r["even"], r["most"], r["fixed"]) == (128, 256, 128)


def test_sinks(spark):
    assert sinks.to_sorted_json(spark.createDataFrame([(1, None)], "b int, a string")).first()[0] == '{"a":null,"b":1}'
    assert sinks.text_table(["m", "long"], [["xyz", 1]]).splitlines() == ["m   | long", "----+-----", "xyz | 1   "]


def test_stream_encoding(spark, tmp_path):
    from morphloom.streaming.encode import encode_stream

    docs(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    q = encode_stream(stream, [("▁", "t"), ("h", "e")]).writeStream.format("memory").queryName("coded").start()
    q.processAllAvailable()
    q.stop()
    got = {r["doc_id"]: r["tokens"] for r in spark.table("coded").collect()}
    assert got[0][:3] == ["▁t", "he", "▁t"] and got[1] == []


def test_entry_registers_queries(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 50


def test_text_files_are_cut(spark, tmp_path):
    (tmp_path / "a.txt").write_text("häuser und\nmehr", encoding="utf-8")
    (tmp_path / "b.txt").write_text("kurz", encoding="utf-8")
    got = sorted(r["text"] for r in C.read_text_files(spark, str(tmp_path), 6).collect())
    assert got == ["häuser", "kurz"]


def test_nth_smallest_value(spark):
    rng = random.Random(6)
    values = [rng.randrange(-50, 50) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    assert [C.nth_smallest(df, "x", n) for n in (1, 37, 200, 400)] == [sorted(values)[n - 1] for n in (1, 37, 200, 400)]


def test_selection_is_maximal_and_free_of_conflicts(spark):
    rng = random.Random(8)
    letters = "abcdefghij"
    rows = {(rng.choice(letters), rng.choice(letters)): float(rng.randrange(1, 6)) for _ in range(60)}
    df = spark.createDataFrame([(a, b, s, i) for i, ((a, b), s) in enumerate(rows.items())], "a string, b string, score double, first_seen int")
    picks = S.conflict_free(df, 100)
    used = [x for p in picks for x in {p.a, p.b}]
    assert len(used) == len(set(used))
    assert all(set(p) & set(used) for p in rows)
    assert [(p.a, p.b) for p in S.conflict_free(df, 2)] == [(p.a, p.b) for p in picks[:2]]


def test_second_vector_of_the_laplacian_is_a_fixed_point(spark):
    """Without isolated tokens, D^-1/2 W D^-1/2 keeps the square roots of the degrees."""
    rows = [("a", "b", 1.0), ("b", "c", 2.0), ("c", "a", 0.5), ("c", "c", 1.0)]
    sym = B.symmetric(spark.createDataFrame(rows, "a string, b string, w double"))
    degree = defaultdict(float)
    for r in sym.collect():
        degree[r["a"]] += r["w"]
    image = defaultdict(float)
    for r in B.laplacian(sym).collect():
        image[r["a"]] += r["v"] * math.sqrt(degree[r["b"]])
    assert all(abs(x) < 1e-9 for x in image.values())


def test_control_has_the_same_values_in_another_order(spark):
    z = spark.createDataFrame([(f"t{i}", i, float(i)) for i in range(30)], "token string, id long, z float")
    got = {r["id"]: r["z"] for r in Z.permuted(z, 5).collect()}
    assert sorted(got.values()) == [float(i) for i in range(30)] and got != {i: float(i) for i in range(30)}
    assert got == {r["id"]: r["z"] for r in Z.permuted(z, 5).collect()}


def test_sigma_is_the_median_gap(spark):
    z = spark.createDataFrame([("a", 0.0), ("b", 1.0), ("c", 4.0)], "token string, z float")
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "a string, b string, w double")
    assert Z.auto_sigma(edges, z, 0.0, 2.0).first()[0] == pytest.approx(2 * (2.0 + 1e-6))
    assert Z.auto_sigma(edges.limit(0), z).first()[0] == 1.0
    assert Z.auto_sigma(edges, z, 0.2, 1.5).first()[0] == pytest.approx(0.3)


def naive_pmi_train(counts, k, size):
    seg, merges = {w: list(w) for w in counts}, []
    vocab = {c for w in counts for c in w}
    while len(vocab) < size:
        n, order = naive_pairs(seg, counts)
        z, first, second = sum(n.values()), Counter(), Counter()
        for (a, b), m in n.items():
            first[a] += m
            second[b] += m
        scores = {p: math.log((m / z + 1e-12) / (first[p[0]] / z * second[p[1]] / z + 1e-12)) for p, m in n.items() if m >= 2}
        used, chosen = set(), []
        for p in sorted((p for p in scores if scores[p] > 0), key=lambda p: (-scores[p], order[p])):
            if len(chosen) < k and not used & set(p):
                used |= set(p)
                chosen.append(p)
        if not chosen:
            break
        merges += chosen
        vocab |= {a + b for a, b in chosen}
        for w, toks in seg.items():
            out = []
            while toks:
                at = 2 if tuple(toks[:2]) in chosen else 1
                out.append("".join(toks[:at]))
                toks = toks[at:]
            seg[w] = out
    return merges


def test_training_queries_run_to_the_end(spark, tmp_path):
    from morphloom.plans.queries import QUERIES

    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(30)) for _ in range(2)]
    docs(spark, texts).withColumn("n_chars", F.length("text")).write.parquet(str(tmp_path / "documents.parquet"))
    counts = naive_words(texts)
    merges, seg = naive_train(counts, 50, 10_000)
    assert len(merges) > 100
    log = QUERIES["train_freq"](spark, str(tmp_path)).orderBy("step").collect()
    assert [(r["a"], r["b"]) for r in log] == merges
    coded = {r["word"]: r["tokens"] for r in QUERIES["encode_words_trained"](spark, str(tmp_path)).collect()}
    ranks = E.ranks_of(merges)
    assert coded == {w: " ".join(naive_encode(w, ranks)) for w in seg}


def test_pmi_query_runs_to_the_end(spark, tmp_path, monkeypatch):
    from morphloom.plans import queries as Q

    monkeypatch.setattr(Q, "BATCH", 3)  # so that a small fixture needs more than two batches
    docs(spark, TEXTS).write.parquet(str(tmp_path / "documents.parquet"))
    merges = naive_pmi_train(naive_words(TEXTS), 3, 4000)
    assert len(merges) > 6
    log = Q.QUERIES["train_pmi_only"](spark, str(tmp_path)).orderBy("step").collect()
    assert [(r["a"], r["b"]) for r in log] == merges


def test_studies_are_registered_whole(spark, monkeypatch):
    from morphloom.plans import queries as Q
    from morphloom.plans import stages

    asked = []
    monkeypatch.setattr(stages, "train", lambda words, config: asked.append(config) or (_ for _ in ()).throw(StopIteration))
    monkeypatch.setattr(Q.C, "read_documents", lambda spark, d: docs(spark))
    for name in ("synthetic_eval", "text_eval"):
        with pytest.raises((StopIteration, RuntimeError)):
            Q.QUERIES[name](spark, "")
    # methods are trained side by side, so some may not have begun when the first one raises
    assert {(c.vocab_size, c.max_batches) for c in asked} == {(2000, T.MAX_BATCHES), (4000, T.MAX_BATCHES)}


def _affinity(edges, n):
    m = np.zeros((n, n))
    for a, b, w in edges:
        m[a, b] += w
        m[b, a] += w
    i, j = np.nonzero(m)
    return i, j, m[i, j], m


@pytest.mark.parametrize("n", [40, 700])
@pytest.mark.parametrize("parts", [1, 2])
def test_coordinates_are_the_first_vector_above_zero(n, parts):
    rng = np.random.default_rng(n + parts)
    size = n // parts
    edges = [(int(a) + p * size, int(b) + p * size, float(rng.random() + 0.1)) for p in range(parts) for a, b in [*zip(range(size - 1), range(1, size)), *rng.integers(0, size, (3 * size, 2))]]
    i, j, w, m = _affinity(edges, n)
    d = m.sum(axis=1)
    values, vectors = np.linalg.eigh(np.eye(n) - m / np.sqrt(np.outer(d, d)))
    assert values[parts] > 1e-4 > values[parts - 1]
    z = vectors[:, parts]
    want = (z - z.mean()) / z.std()
    got = Z.coordinates(n, i, j, w)
    assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-3


def test_coordinates_of_many_components():
    edges = [(3 * p, 3 * p + 1, 1.0) for p in range(5)]
    z = Z.coordinates(16, *_affinity(edges, 16)[:3])
    assert np.isfinite(z).all() and abs(z.mean()) < 1e-5 and z.std() == pytest.approx(1, abs=1e-3)


@pytest.mark.parametrize("method", ["spectral", "spectral_shuffled"])
def test_spectral_training_matches_the_plain_loop(spark, method):
    """Batches chosen by scores that are worked out from numpy's decomposition."""
    rng = random.Random(5)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(2, 4))) + "".join(rng.choice("wxyz") for _ in range(rng.randint(2, 4))): rng.randint(2, 30) for _ in range(60)}
    table = spark.createDataFrame([(w, n, 0, k) for k, (w, n) in enumerate(words.items())], "word string, cnt long, first_doc long, first_pos int")
    got = T.train(table, T.TrainConfig(method=method, vocab_size=10**6, batch_size=3, max_batches=3, sigma=0.5))
    toks, merges = {w: list(w) for w in words}, []
    vocab = sorted({c for w in words for c in w})
    for _ in range(3):
        n, seen = Counter(), {}
        for k, (w, t) in enumerate(toks.items()):
            for at, p in enumerate(zip(t, t[1:])):
                n[p] += words[w]
                seen.setdefault(p, (k, at))
        z = sum(n.values())
        first, second = Counter(), Counter()
        for (a, b), x in n.items():
            first[a] += x
            second[b] += x
        pp = {p: math.log((x / z + 1e-12) / (first[p[0]] / z * second[p[1]] / z + 1e-12)) for p, x in n.items() if x >= 2}
        pp = {p: v for p, v in pp.items() if v > 0}
        ids = {t: i for i, t in enumerate(sorted(vocab))}
        m = np.zeros((len(ids), len(ids)))
        for (a, b), v in pp.items():
            m[ids[a], ids[b]] += v
            m[ids[b], ids[a]] += v
        d = np.maximum(m.sum(axis=1), 1e-9)
        values, vectors = np.linalg.eigh(np.eye(len(ids)) - m / np.sqrt(np.outer(d, d)))
        c = vectors[:, next(k for k in range(3) if values[k] > 1e-7)]
        c = ((c - c.mean()) / (c.std() + 1e-9)).astype(np.float32)
        if method == "spectral_shuffled":
            c = c[np.random.default_rng(0).permutation(len(c))]
        score = {p: v * n[p] * math.exp(-(float(c[ids[p[0]]] - c[ids[p[1]]]) ** 2) / (2 * 0.25)) for p, v in pp.items()}
        used, picks = set(), []
        for p in sorted(score, key=lambda p: (-score[p], seen[p])):
            if len(picks) < 3 and not used & set(p):
                used |= set(p)
                picks.append(p)
        merges += picks
        vocab = sorted({*vocab, *(a + b for a, b in picks)})
        pairs = set(picks)
        for w, t in toks.items():
            out, k = [], 0
            while k < len(t):
                if k + 1 < len(t) and (t[k], t[k + 1]) in pairs:
                    out.append(t[k] + t[k + 1])
                    k += 2
                else:
                    out.append(t[k])
                    k += 1
            toks[w] = out
    assert got.merges == merges


def test_text_files_drop_bytes_that_are_not_text(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"good\xff\xfe text\xc3\xa9 \xe2\x82")
    assert [r["text"] for r in C.read_text_files(spark, str(tmp_path)).collect()] == ["good text\u00e9 "]


def test_lines_are_split_as_one_text(spark):
    texts = ["a\nb\r\nc", "", None, "d\x0be\u2028f", "\n".join("ghijklmnop")]
    lines = C.text_lines(docs(spark, texts))
    want = [(i, k, x) for i, t in enumerate(texts) if t is not None for k, x in enumerate(t.splitlines() or [""])]
    assert sorted(tuple(r) for r in lines.collect()) == sorted(want)
    got = sorted((r["doc_id"], r["pos"], r["part"]) for r in C.split_lines(lines).collect())
    at = int(len(want) * 0.9)
    assert got == [(i, k, "train" if r < at else "val") for r, (i, k, _) in enumerate(sorted(want))]
    assert C.split_lines(lines.limit(0)).count() == 0


def test_training_stops_at_its_target(spark):
    words = spark.createDataFrame([(w, 5, 0, i) for i, w in enumerate(["abcd", "abce", "bcda", "dabc"])], "word string, cnt long, first_doc long, first_pos int")
    t = T.train(words, T.TrainConfig(vocab_size=7, batch_size=1))
    assert len(t.vocab) == 7 and len(t.merges) == 2
    assert len(T.train(words, T.TrainConfig(vocab_size=7, batch_size=50)).vocab) >= 7  # a batch may overshoot


def test_words_are_trained_as_arrays(spark, tmp_path):
    """A batch writes a row for each block and share of pairs, not one for each word; merges and pairs are those of the plain loop."""
    from morphloom.operators import segments as G

    rng = random.Random(9)
    words = sorted({"".join(rng.choice("aab𝔞") for _ in range(rng.randint(1, 9))) for _ in range(900)})
    rows = [(w, rng.randint(0, 5), rng.choice([None, 3, -1]), i) for i, w in enumerate(words)]
    table = spark.createDataFrame(rows, "word string, cnt long, first_doc long, first_pos int")
    first = G.first_segments(table.repartition(3), str(tmp_path / "0"))
    assert first.count() <= 3 * (G.SHARES + 2) < len(words)
    assert sorted(map(chr, G.symbols(first))) == sorted({*"ab𝔞"})
    names = {ord(c): c for c in "ab𝔞"} | {G.MERGED + 1: "aa", G.MERGED + 2: "b𝔞"}
    after = G.next_segments(first, [(ord("a"), ord("a"), G.MERGED + 1), (ord("b"), ord("𝔞"), G.MERGED + 2)], str(tmp_path / "1"))
    for segments, picks in ((first, []), (after, [("a", "a"), ("b", "𝔞")])):
        want = {w: naive_encode_once(list(w), picks) for w in words}
        got = {r["word"]: r for r in G.segmented_words(segments, names).collect()}
        assert {w: r["toks"] for w, r in got.items()} == want
        assert sorted(((r["word"], r["cnt"], r["first_doc"], r["first_pos"]) for r in got.values()), key=lambda r: r[3]) == rows
        n, seen = Counter(), {}
        for w, cnt, doc, pos in rows:
            for at, p in enumerate(zip(want[w], want[w][1:])):
                if cnt:
                    n[p] += cnt
                    seen[p] = min(seen.get(p, (math.inf,)), (G.NO_DOC if doc is None else doc, pos, at))
        pairs = G.segment_pairs(segments).collect()
        assert {(names[r["a"]], names[r["b"]]): (r["n"], tuple(r["first_seen"])) for r in pairs} == {p: (n[p], seen[p]) for p in n}
        assert len(pairs) == len(n)


def naive_encode_once(toks, picks):
    out, i = [], 0
    while i < len(toks):
        if tuple(toks[i : i + 2]) in picks:
            out.append("".join(toks[i : i + 2]))
            i += 2
        else:
            out.append(toks[i])
            i += 1
    return out


def test_token_ids_neither_shuffle_nor_sort(spark):
    coded = spark.createDataFrame([("abq", ["ab", "q"])], "word string, toks array<string>")
    vocab = spark.createDataFrame([("a", 0), ("ab", 1)], "token string, id int")
    plan = E.token_ids(coded, vocab)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Sort", "Window"))


def test_an_encoder_is_bounded_in_bytes(monkeypatch):
    """100,000 words of some 40 symbols: their ids as lists took 59 MB of a memo of any 200,000 words."""
    import tracemalloc

    monkeypatch.setattr(E, "MEMO_BYTES", 5_000_000, raising=False)
    coder = E.TextEncoder([], {c: i + 1000 for i, c in enumerate("▁0123456789")})
    tracemalloc.start()
    for i in range(100_000):
        assert i % 9999 or coder.of_text(f"{i:040d}")[-1] == 1001 + i % 10
        coder.of_text(f"{i:040d}")
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 10_000_000
    assert coder.of_text("7 7") == [1000, 1008, 1000, 1008]


def test_few_words_are_few_files_whatever_the_partitions(spark, monkeypatch):
    parts = []
    step = T.next_segments
    monkeypatch.setattr(T, "next_segments", lambda segments, *more: parts.append(segments.where("ids is not null").count()) or step(segments, *more))
    words = spark.createDataFrame([(f"{i:05d}", 1, 0, i) for i in range(2000)], "word string, cnt long, first_doc long, first_pos int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        T.train(words, T.TrainConfig(max_batches=1))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert parts[0] < 10
