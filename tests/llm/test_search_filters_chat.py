"""Exact search, URL cascade and chat formatting against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from morphloom.llm import chat, hamming, url_cascade as U


def brute(rows, k):
    out = {}
    for q, qc in rows:
        near = sorted({(bin((qc ^ c) & (2**64 - 1)).count("1"), i) for i, c in rows if i != q})
        out[q] = near[:k]
    return out


@pytest.mark.parametrize("kind", ["random", "copies"])
def test_top_k_is_exact(spark, kind, monkeypatch):
    rng = random.Random(4)
    pool = [rng.getrandbits(64) - 2**63 for _ in range(40)]
    if kind == "copies":
        rows = [(i, pool[0] if i % 3 else rng.choice(pool) ^ (1 << rng.randrange(60))) for i in range(400)]
    else:
        rows = [(i, rng.choice(pool) ^ rng.getrandbits(12)) for i in range(300)]
    monkeypatch.setattr(hamming, "GROUP", 40)
    monkeypatch.setattr(hamming, "BLOCK", 30)
    monkeypatch.setattr(hamming, "CELLS", 50)
    df = spark.createDataFrame(rows, "id long, code long")
    got = {}
    for r in hamming.top_k(df, df.where("id % 20 = 0"), 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["neighbor_id"]))
    want = brute(rows, 5)
    for q in range(0, len(rows), 20):
        assert [(d, i) for _, d, i in sorted(got[q])] == want[q]


def test_top_k_edges(spark):
    df = spark.createDataFrame([(0, 5), (0, 5), (1, 5), (2, None), (None, 7)], "id long, code long")
    assert [tuple(r) for r in hamming.top_k(df, df.where("id = 0"), 10).collect()] == [(0, 1, 1, 0)]
    empty = df.limit(0)
    assert hamming.top_k(empty, empty).count() == 0
    v = spark.createDataFrame([([1.0, -1.0, None, 2.0] + [0.0] * 59 + [3.0],), ([],), (None,)], "v array<double>")
    assert [r[0] for r in v.select(hamming.sign_code(F.col("v"))).collect()] == [9 - 2**63, 0, None]


def verdicts(spark, urls, listed, **more):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rows = U.judge_urls(pages, U.RULES, spark.createDataFrame([(x,) for x in listed], "key string")).orderBy("page_id").collect()
    return [(r["host"], r["path"], r["rule"], r["verdict"]) for r in rows]


def test_rules_and_hosts(spark):
    got = verdicts(
        spark,
        ["HTTP://WWW.Example.COM/en/x?y#z", "http://a.example.com/en/", "http://com/", "http://x.com", "http://b.net/es/1", "https://bad.org/p", None, "bad.org/p", "http://a.bad.org#q", "ftp://notbad.org/", "http://x.com/en/"],
        ["bad.org", None],
    )
    assert got == [
        ("www.example.com", "/en/x", "www.example.com/en/", "allow"), ("a.example.com", "/en/", "example.com/en/", "block"), ("com", "/", "com/", "allow"), ("x.com", "", None, "allow"), ("b.net", "/es/1", "net/es/", "block"),
        ("bad.org", "/p", None, "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.bad.org", "", None, "block"), ("notbad.org", "/", None, "allow"), ("x.com", "/en/", "com/", "allow"),
    ]


@pytest.mark.parametrize("sharded", [False, True])
def test_cascade_is_exact_for_its_universe(spark, monkeypatch, sharded):
    hosts = [f"h{i}.example.org" for i in range(3000)]
    listed = [h for i, h in enumerate(hosts) if i % 7 == 0]
    if sharded:
        monkeypatch.setattr(U, "MAX_LITERAL_BITS", 0)
        monkeypatch.setattr(U, "SHARD_KEYS", 500)
    got = verdicts(spark, [f"http://{h}/" for h in hosts], listed)
    assert [v for _, _, _, v in got] == ["block" if i % 7 == 0 else "allow" for i in range(3000)]


def test_empty_pages_and_lists(spark):
    assert verdicts(spark, [], ["a"]) == []
    assert [v for *_, v in verdicts(spark, ["http://a/"], [])] == ["allow"]


def chats(spark, convs):
    rows = [(c, t, role, text, "extra") for c, turns in convs.items() for t, (role, text) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string")


def test_prefixes_and_copies_collapse(spark):
    full = [("user", "a"), ("assistant", "b"), ("user", "c")]
    convs = {1: full[:1], 2: full[:2], 3: full, 4: full, 5: [("user", "a"), ("assistant", "x")], 6: [("user", "")], 7: [("user", None)], 8: [(None, "q")]}
    got = {r["conv_id"]: (r["part"], r["n_turns"], r["text"]) for r in chat.render_chats(chats(spark, convs)).collect()}
    assert set(got) == {3, 5, 6, 7, 8}
    assert got[3] == (0, 3, "<|user|>\na<|end|>\n<|assistant|>\nb<|end|>\n<|user|>\nc<|end|>\n")
    assert got[8][2] == "<|unknown|>\nq<|end|>\n" and got[7][2] == got[6][2] == "<|user|>\n<|end|>\n"


def test_random_snapshots_match_brute_force(spark):
    rng = random.Random(5)
    convs = {}
    for c in range(120):
        n = rng.choice([1, 2, 3, 5, 300])
        convs[c] = [("user", rng.choice("ab")) if i < 4 else ("user", "z") for i in range(n)]
    got = {r["conv_id"] for r in chat.maximal_conversations(chats(spark, convs)).collect()}
    want = {c for c, t in convs.items() if not any((len(o) > len(t) and o[: len(t)] == t) or (o == t and d < c) for d, o in convs.items())}
    assert got == want


def test_gaps_nulls_and_repeats(spark):
    rows = [(1, 5, "user", "a"), (1, 900, "user", "b"), (2, 0, "user", "a"), (3, None, "user", "x"), (3, 1, "user", "y"), (None, 0, "user", "a"), (4, 0, "user", "r"), (4, 0, "user", "r"), (5, 0, "user", "r")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {(r["conv_id"], r["n"]) for r in chat.maximal_conversations(df).collect()} == {(1, 2), (3, 2), (4, 2)}
    assert chat.render_chats(df.limit(0)).count() == 0


def test_native_plans_have_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    plans = [U.judge_urls(pages, U.RULES, spark.createDataFrame([("a.org",)], "key string")), chat.render_chats(chats(spark, {1: [("user", "a")]}))]
    for df in plans:
        assert not any(x in df._jdf.queryExecution().toString() for x in ("Python", "Pandas", "ArrowEval"))


def test_longer_vectors_are_refused(spark):
    whole, longer = (spark.createDataFrame([([1.0] * n,)], "v array<float>").select(hamming.sign_code(F.col("v"))) for n in (64, 65))
    assert whole.first()[0] == -1
    with pytest.raises(Exception, match="more than 64 components"):
        longer.collect()


def test_ids_with_several_codes(spark, monkeypatch):
    monkeypatch.setattr(hamming, "GROUP", 8)
    rows = [(0, c) for c in (0, 1, 2, 4)] + [(i, 1 << (i + 8)) for i in range(1, 8)] + [(20, 3), (20, -1), (3, 0), (3, 0), (9, None), (None, 5)]
    df = spark.createDataFrame(rows, "id long, code long")
    got = [tuple(r) for r in hamming.top_k(df, df.where("id % 20 = 0"), 3).collect()]
    whole = [(i, c % (1 << 64)) for i, c in rows if i is not None and c is not None]
    want = []
    for q in (0, 20):
        near: dict = {}
        for a in (c for i, c in whole if i == q):
            for i, c in whole:
                if i != q:
                    near[i] = min(near.get(i, 64), (a ^ c).bit_count())
        want += [(q, r + 1, i, d) for r, (d, i) in enumerate(sorted((d, i) for i, d in near.items())[:3])]
    assert sorted(got) == want


@pytest.mark.parametrize("sharded", [False, True])
def test_very_long_hosts_and_clashing_columns(spark, monkeypatch, sharded):
    if sharded:
        monkeypatch.setattr(U, "MAX_LITERAL_BITS", 0)
        monkeypatch.setattr(U, "SHARD_KEYS", 3)
    hosts = ["a." * 500_000 + "bad.org", "x" * 1_000_000, "b.bad.org", "xbad.org", "bad.org", "org", "." * 1000, "deep.er.bad.net", "er.bad.net", "bad.net", "", "b.bad.org"]
    rows = [(i, f"http://{h}/p", True, "k", 1, 2, 3) for i, h in enumerate(hosts)]
    pages = spark.createDataFrame(rows, "page_id long, url string, bad boolean, key string, word int, shard int, miss int")
    listed = spark.createDataFrame([("bad.org",), ("er.bad.net",), (None,), ("",)], "key string")
    got = U.judge_urls(pages, (), listed)
    assert got.columns == [*pages.columns, "host", "path", "rule", "verdict"]
    want = {i: "block" if any(h == k or h.endswith("." + k) for k in ("bad.org", "er.bad.net")) else "allow" for i, h in enumerate(hosts)}
    assert {r["page_id"]: r["verdict"] for r in got.select("page_id", "verdict").collect()} == want
