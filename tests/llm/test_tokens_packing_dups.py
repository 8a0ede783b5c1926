"""Token ids, lexicon, store, packing and near duplicates against the library and brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer

from morphloom.llm import lexicon as X
from morphloom.llm import near_dups as N
from morphloom.llm import packing as P
from morphloom.llm import token_store as S
from morphloom.llm.scratch import new_path
from morphloom.llm.tokens import Encoder, encoder, vocabulary

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    "Hello, wörld!  It's 12 o'clock.\nNew line \n\n end ", "", None, " ", "a", "x<|endoftext|>y", "日本語 text ΣΑΣ İ", "the " * 3000, "tab\there\r\n", "don't DON'T we'll", "Æ ſ ŉ ĸ", "a\x1cb\x00c",
    "One two three four five six seven.\nEight nine ten.", "One two three four five six seven.\nEight nine ten.",
]


def library(name):
    t = Tokenizer.from_file(vocabulary(name))
    t.no_padding()
    t.no_truncation()
    return t


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "other") for i, t in enumerate(texts)], "doc_id long, text string, ids string")


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(max_codepoint=0x200, exclude_categories=("Cs",)) | st.sampled_from(" \n'st"), max_size=40), st.sampled_from(FILES))
def test_encoder_is_the_library(text, name):
    got = np.frombuffer(encoder(vocabulary(name)).encode(text), "<u4").tolist()
    assert got == library_ids(name, text)


_LIBRARIES: dict = {}


def library_ids(name, text):
    t = _LIBRARIES.setdefault(name, None) or library(name)
    _LIBRARIES[name] = t
    return t.encode(text, add_special_tokens=False).ids


def test_lexicon_finds_its_words_only():
    words = {w.encode(): np.arange(len(w) % 4 + 1, dtype="<u4").tobytes() for w in ("a", "ab", "abc", "bc", "xbc", "é", "tion", "station", "nation")}
    lex = X.Lexicon(X.compile_lexicon(words))
    assert all(lex.find(w) == ids for w, ids in words.items())
    assert not any(lex.find(w) for w in (b"", b"b", b"abcd", b"tio", b"\xff", b"zz"))
    assert X.Lexicon(X.compile_lexicon({})).find(b"a") is None


def test_equal_suffixes_share_states():
    def size(words):
        seen, todo = set(), [X.minimal_automaton(sorted(words))]
        while todo:
            s = todo.pop()
            if id(s) not in seen:
                seen.add(id(s))
                todo += s.arcs.values()
        return len(seen)

    assert size([b"nation", b"station", b"ration"]) < size([b"nation"]) + 4


def test_lexicon_encodes_and_decodes_as_the_library(spark):
    path, t = vocabulary(FILES[0]), library(FILES[0])
    rows = X.encode_documents(frame(spark), path, X.build_lexicon(frame(spark), path, 20)).orderBy("doc_id").collect()
    for r, text in zip(rows, TEXTS, strict=True):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == ids
        assert r["decoded"] == t.decode(ids, skip_special_tokens=False)


def test_store_gives_back_every_id(spark):
    t = library(FILES[1])
    texts = [*TEXTS, *(" ".join(random.Random(i // 2).choices(["alpha", "beta", "gamma", "δ", "e"], k=6000)) for i in range(4))]
    path = S.write_store(frame(spark, texts), new_path(spark, "store"), vocabulary(FILES[1]), 2)
    want = [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]
    start = np.cumsum([0, *map(len, want)])
    got = S.read_ids(spark, path).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["start"], r["ids"]) for r in got] == [(i, s, x) for i, (s, x) in enumerate(zip(start, want))]
    told = S.read_summary(spark, path).orderBy("doc_id").collect()
    assert [tuple(r) for r in told] == [(i, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, (s, x) in enumerate(zip(start, want))]
    keys = [bytes(r["key"]) for r in S._folder(spark, path, "chunk").select("key").collect()]
    assert len(keys) == len(set(keys)) < sum(len(S.cuts(np.array(x))) for x in want)
    assert [r["doc_id"] for r in spark.read.parquet(f"{path}/manifest").orderBy("start", "seq").collect()] == list(range(len(texts)))
    assert len(S.store_root(spark, path)) == 16


def test_a_broken_chunk_is_noticed():
    import pyarrow as pa

    ids = np.arange(50, dtype="<u4")
    batch = pa.record_batch({"key": [S.digest(ids.tobytes())], "n": [50], "data": [ids[::-1].astype("<u2").tobytes()]})
    with pytest.raises(ValueError, match="doesn't match"):
        list(S._check_chunks(iter([batch])))


def test_chunks_survive_shifts():
    ids = np.random.default_rng(0).integers(0, 50000, 60_000).astype("<u4")

    def names(x):
        c = [0, *S.cuts(x)]
        return {S.digest(x[a:b].tobytes()) for a, b in zip(c, c[1:])}

    assert len(names(ids) & names(np.concatenate([[7, 7, 7], ids]).astype("<u4"))) > 0.8 * len(names(ids))
    assert all(b - a <= S.MOST for a, b in zip([0, *S.cuts(ids)], S.cuts(ids)))
    assert S.cuts(ids[:0]) == []


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=300), min_size=1, max_size=5), max_size=4))
def test_crc_joined(strings):
    flat, owner = [x for xs in strings for x in xs], [i for i, xs in enumerate(strings) for _ in xs]
    got = S.crc_joined(np.array([zlib.crc32(x) for x in flat], np.int64), np.array([len(x) for x in flat], np.int64), np.array(owner, np.int64), len(strings))
    assert got.tolist() == [zlib.crc32(b"".join(xs)) for xs in strings]


def test_cuts_of_documents_in_a_row_are_those_of_each():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50_000, n).astype("<u4") for n in (1, 63, 64, 65, 900, 1, 30_000, 200)] + [np.full(20_000, 7, "<u4")]
    ends = np.cumsum([len(x) for x in docs])
    want = [int(e - len(x) + c) for x, e in zip(docs, ends) for c in S.cuts(x)]
    assert S.cuts(np.concatenate(docs), ends.tolist()) == want


def test_stored_forms_of_chunks_are_widened():
    import pyarrow as pa

    parts = [np.arange(5, dtype="<u4"), np.array([70_000, 1], "<u4"), np.arange(3, dtype="<u4")]
    narrow = [parts[0].astype("<u2").tobytes(), parts[2].astype("<u2").tobytes()]
    assert [bytes(x) for x in S.widened(pa.array(narrow, pa.binary()), np.array([5, 3]))] == [parts[0].tobytes(), parts[2].tobytes()]
    mixed = [narrow[0], parts[1].tobytes(), narrow[1]]
    assert [bytes(x) for x in S.widened(pa.array(mixed, pa.binary()), np.array([5, 2, 3]))] == [x.tobytes() for x in parts]


@pytest.mark.parametrize("end", [2, 70_000])
def test_a_worker_keeps_nothing_of_the_batches_it_has_encoded(end):
    import gc
    import sys

    import pyarrow as pa

    rng, t = random.Random(5), library(FILES[1])
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=1000)) for _ in range(50)]
    batch = pa.record_batch({"doc_id": list(range(50)), "text": texts})
    run = S._objects(vocabulary(FILES[1]), end)
    chunks, recipes = run(iter([batch]))
    ids = {k.as_py(): bytes(x) for k, x in zip(chunks["key"], S.widened(chunks["data"], chunks["n"].to_numpy()))}
    want = [np.array([*t.encode(x, add_special_tokens=False).ids, end], "<u4").tobytes() for x in texts]
    assert [b"".join(ids[k] for k in keys) for keys in recipes["chunks"].to_pylist()] == want
    gc.collect()
    before = sys.getallocatedblocks()
    for _ in range(10):
        for _ in run(iter([batch])):
            pass
    gc.collect()
    assert sys.getallocatedblocks() - before < 100  # ten batches of more than 50 chunks each


def test_empty_store(spark):
    path = S.write_store(frame(spark).limit(0), new_path(spark, "store"), vocabulary(FILES[1]), 2)
    assert S.read_summary(spark, path).count() == S.read_ids(spark, path).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=25), st.sampled_from([60, 61, 64]))
def test_packing_holds_every_piece_once(counts, capacity):
    found = Counter()
    patterns = P.pack_lengths(counts, capacity)
    for bins, items in patterns:
        assert bins > 0 and sum(x * k for x, k in items) <= capacity
        assert sum(k for x, k in items if 3 * x > capacity) <= 2
        for x, k in items:
            found[x] += bins * k
    assert found == Counter(counts)
    # no worse than first-fit decreasing by more than a bin in ten
    bins: list[int] = []
    for x in sorted(Counter(counts).elements(), reverse=True):
        at = next((i for i, left in enumerate(bins) if left >= x), None)
        if at is None:
            bins.append(capacity - x)
        else:
            bins[at] -= x
    assert sum(n for n, _ in patterns) <= 1.1 * len(bins) + 1


def check_packed(rows, want):
    """rows of pack_documents hold the ids of want, gapless and within the capacity."""
    pieces, spans = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(want)
    for i, ids in want.items():
        assert sorted(pieces[i]) == [(k, s, len(x := ids[s : s + 2048]), zlib.crc32(np.array(x, "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    for s in spans.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0, *(n for _, n in s)])[:-1].tolist() and sum(n for _, n in s) <= 2048
    return len(spans)


def test_documents_are_packed(spark):
    t = library(FILES[0])
    rows = P.pack_documents(frame(spark), vocabulary(FILES[0]), 0).collect()
    check_packed(rows, {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in enumerate(TEXTS)})
    assert P.pack_documents(frame(spark).limit(0), vocabulary(FILES[0]), 0).count() == 0


def near(base, rng, share):
    words = base.split()
    for i in rng.sample(range(len(words)), int(share * len(words))):
        words[i] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def brute_classes(rows):
    def shingles(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return set(zip(w, w[1:])) if len(w) > 1 else set(w)

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                if x != y:
                    root[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def dup_rows(groups=6, size=12):
    rng = random.Random(1)
    rows = [(3, "One Two"), (4, "one  two"), (1, "word"), (2, "WORD"), (90, None), (91, ""), (92, " \n"), (93, "two one")]
    for g in range(groups):
        base = " ".join(f"w{rng.randrange(3000)}" for _ in range(120))
        for k in range(size):
            rows.append((100 + 37 * len(rows) % 9973, near(base, rng, 0.05) if k else base))
        # a chain, whose ends are far from each other
        text = " ".join(f"c{rng.randrange(3000)}" for _ in range(150))
        for _ in range(5):
            rows.append((20_000 + len(rows), text))
            text = near(text, rng, 0.04)
    rows += [(50_000 + i, rows[20][1]) for i in range(30)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1024, 4])
def test_classes_match_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", block)
    rows = dup_rows()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n long, node long")
    got = {r["doc_id"]: r for r in N.near_duplicates(df).collect()}
    want = brute_classes(rows)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    left = N.drop_near_duplicates(df)
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == {i for i, r in got.items() if r["kept"]}


def test_components_of_a_large_bucket_are_joined_before_it_is_compared_whole(spark, monkeypatch):
    rng, sizes, stored = random.Random(6), {}, N.stored

    def counted(df, name):
        out = stored(df, name)
        sizes[name] = sizes.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(N, "stored", counted)
    monkeypatch.setattr(N, "BLOCK", 8)
    rows = [(i, " ".join(f"w{rng.randrange(17)}" for _ in range(600))) for i in range(120)]  # few words: most pairs are near the threshold
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)
    assert sizes["paired-nodes"] < 8000, sizes  # 17,061 when all mixed buckets were compared whole


def test_dup_edges(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "x y z"), (7, "A B C")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in N.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, 1, False), (None, None, True), (7, 1, False)], key=str)
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_pruning_keeps_what_is_similar():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (20_000, N.HASHES), dtype=np.uint8)
    other = rng.integers(0, 256, a.shape, dtype=np.uint8)
    b = np.where(rng.random(a.shape) < 0.8, a, other)
    assert (N.survivors(a, b) >= 0).mean() > 0.9995
    assert (N.survivors(a, np.where(rng.random(a.shape) < 0.3, a, other)) >= 0).mean() < 0.001


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r["node"]: r["root"] for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert {x: got.get(x, x) for x in root} == {x: find(x) for x in root}


def test_a_passage_of_a_usual_length_is_shared():
    rng = np.random.default_rng(8)
    passage = rng.integers(0, 50_000, 600)
    names = []
    for n in (300, 517):
        ids = np.concatenate([rng.integers(0, 50_000, n), passage, rng.integers(0, 50_000, n)]).astype("<u4")
        c = [0, *S.cuts(ids)]
        names.append({S.digest(ids[a:b].tobytes()): b - a for a, b in zip(c, c[1:])})
    assert sum(names[0][x] for x in names[0].keys() & names[1].keys()) >= 200


@pytest.mark.parametrize("wrong", ["lost", "doubled"])
def test_a_lost_or_doubled_manifest_row_is_noticed(spark, wrong):
    path = S.write_store(frame(spark), new_path(spark, "store"), vocabulary(FILES[1]), 2)
    rows = spark.read.parquet(f"{path}/manifest").collect()
    rows = rows[1:] if wrong == "lost" else [*rows, rows[0]]
    schema = spark.read.parquet(f"{path}/manifest").schema
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/manifest")
    for read in (S.read_summary, S.read_ids):
        with pytest.raises(ValueError, match="manifest"):
            read(spark, path)


def test_rows_that_share_an_id_are_dropped_apart(spark):
    rows = [(3, "one two three four"), (5, "a b c d e"), (5, "one two three four"), (8, "a b c d e"), (None, "a b c d e"), (None, "x y z"), (9, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {(r["doc_id"], r["text"]) for r in N.drop_near_duplicates(df).collect()}
    assert kept == {(3, "one two three four"), (5, "a b c d e"), (None, "x y z"), (9, None), (None, None)}


def test_store_of_repeated_and_null_ids(spark):
    rows = [(5, "one two"), (5, "one two"), (5, "three"), (None, "four"), (None, None), (-1, "x")]
    path = S.write_store(spark.createDataFrame(rows, "doc_id long, text string"), new_path(spark, "store"), vocabulary(FILES[1]), 2)
    t = library(FILES[1])
    want = sorted((i is not None, i or 0, [*t.encode(x or "", add_special_tokens=False).ids, 2]) for i, x in rows)
    got = S.read_ids(spark, path).orderBy("start").collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids"]) for r in got) == want
    assert [r["doc_id"] for r in got] == [None, None, -1, 5, 5, 5]
    assert [r["start"] for r in got] == [sum(len(r["ids"]) for r in got[:i]) for i in range(len(got))]
    assert sorted(tuple(r)[:3] for r in S.read_summary(spark, path).where("doc_id is not null").collect()) == sorted((r["doc_id"], r["start"], len(r["ids"])) for r in got if r["doc_id"] is not None)


def test_a_recipe_that_does_not_match_its_root_is_noticed(spark):
    texts = [" ".join(random.Random(i).choices(["alpha", "beta", "gamma"], k=900)) for i in range(2)]
    path = S.write_store(frame(spark, texts), new_path(spark, "store"), vocabulary(FILES[1]), 2)
    rows = [r.asDict() for r in spark.read.parquet(f"{path}/manifest").collect()]
    rows[0]["chunks"] = rows[0]["chunks"][::-1]
    schema = spark.read.parquet(f"{path}/manifest").schema
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/manifest")
    with pytest.raises(Exception, match="root"):
        S.read_summary(spark, path).collect()


WORLD = ["it\u2019s", "a", "\u201cquoted\u201d", "text\u2014with", "\u65e5\u672c\u8a9e", "\u30c6\u30b9\u30c8", "\U0001f600", "\U0001f469\u200d\U0001f467", "nai\u0308ve", "\u0130stanbul", "\u03a3\u0391\u03a3", "\u0661\u0662", "\u0939\u093f", "\u3000", "\xa0", "\u200b", "x\xb2", "<|endoftext|>", "<|startoftext|>", "\x1c", "\t", "\r\n", "\n", "don't", "12"]


@pytest.mark.parametrize("name", FILES)
def test_any_script_is_encoded_as_the_library_does(name):
    rng, enc, t = random.Random(4), Encoder(vocabulary(name)), library(name)
    for _ in range(3000):
        text = "".join(rng.choice(WORLD) + rng.choice([" ", "", " "]) for _ in range(rng.randint(1, 8)))
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_words_of_any_script_come_through_the_lexicon(spark):
    path = vocabulary(FILES[0])
    docs = frame(spark, ["it\u2019s a \u201cquoted\u201d text \u65e5\u672c\u8a9e \U0001f600"] * 3)
    words = X.frequent_words(docs, path)
    assert {"\u65e5\u672c\u8a9e", "quoted", "\u201c", "\U0001f600", "\u2019", "s"} <= set(words)
    enc = X.LexiconEncoder(path, X.build_lexicon(docs, path))
    asked = []
    enc.lexicon.find, find = (lambda w: asked.append(find(w)) or asked[-1]), enc.lexicon.find
    for r in docs.collect():
        enc.encode(r["text"])
    assert len(asked) >= len(words) and all(x is not None for x in asked)


def test_lexicon_of_no_texts(spark):
    path = vocabulary(FILES[0])
    docs = frame(spark).limit(0)
    assert X.encode_documents(docs, path, X.build_lexicon(docs, path)).count() == 0
