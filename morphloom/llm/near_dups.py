"""Near-duplicate classes of whole texts: MinHash bands, sequential Bayesian verification, exact confirmation.

A document's set holds its distinct 2-word shingles. Documents of equal sets become one node at once. Nodes that agree
in one of BANDS bands of ROWS MinHash values are candidates. Their signatures are compared in batches; after each
batch a pair is dropped when the posterior probability that its similarity reaches the threshold, given the matches so
far and a uniform prior, is below MISS. What survives is confirmed on the full word pairs of both texts.

Only classes are asked for, so no group ever yields all its pairs. First each node meets the smallest node of its
bands (linear), and the best such pair of a node is confirmed. Buckets that then still hold several components go
through rounds (linear too) in which each of their nodes meets one node of another component, and the best pair of
each component is confirmed, until a round joins few of them. Buckets that still hold several components are compared in
blocks of bounded size, across components only: first by signatures, which tell the nodes that have a surviving pair
in a block, then by the full sets (of 64-bit shingle hashes) of these nodes alone; only links that join two components
are given out. Buckets with the same nodes are compared once. Hence no link between candidates is lost,
and no pair leaves its block before it is confirmed. A pair of similarity 0.8 is missed with probability 4.8e-6: 3e-6
by the bands, (1 - 0.8**ROWS)**BANDS, the rest by the pruning.

Components are found by large-star and small-star rounds over tables. Node ids are 64-bit digests of sets: two
different sets among n get the same with probability n * n / 2**65.

Edge cases: null, empty and wordless texts have the empty set, are linked with nothing and are kept. A one-word text
has that word as its only shingle. Repeated rows are linked through their equal sets. Rows of one doc_id with
different texts are told apart by their text. Rows with null doc_id belong to classes but do not name them; a class
of such rows alone has component_id null and is kept. Ties between candidates go to the larger node. A very long text
is one set of shingles, whose signature is worked out in slices. Other columns, of whatever name, are left alone. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import bounded_batches, give_back, stored

PERCENT = 80
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
BATCH = 32  # signature values compared at a time
MISS = 1e-6
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000  # nodes and shingles in a block of a large bucket, on average at most
WORTH = 10  # rounds go on while they find a link for one in so many of the components that share buckets
HOT = 1000  # nodes of a component whose representative is told by broadcast
BROADCAST_ROWS = 1_000_000  # ids that may be broadcast; beyond, joins shuffle

_M = np.uint64(0x9E3779B97F4A7C15)


@cache
def _family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(5))
    return rng.integers(0, 1 << 32, (HASHES, 1), dtype=np.uint32), rng.integers(0, 1 << 32, (HASHES, 1), dtype=np.uint32) | np.uint32(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the 2-word shingles."""
    words = (text or "").encode().translate(_LOWER).split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < 2:
        return h
    with np.errstate(over="ignore"):
        p = (h[:-1] ^ (h[:-1] >> np.uint64(31))) * _M + h[1:]
        return np.unique((p ^ (p >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))


_LOWER = bytes(range(256)).lower()


def shingle_set(text: str | None) -> set:
    """The set itself."""
    words = (text or "").encode().translate(_LOWER).split()
    return set(zip(words, words[1:])) if len(words) > 1 else set(words)


def signature(s: np.ndarray) -> np.ndarray:
    """HASHES minima over a set of hashes, 4096 at a time."""
    flip, odd = _family()
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    x = (s >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(out, ((x[None, i : i + 4096] ^ flip) * odd).min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.arange(1, BANDS + 1, dtype=np.uint64) * _M
        for row in sig.reshape(BANDS, ROWS).T:
            out = (out ^ row) * np.uint64(0xFF51AFD7ED558CCD)
            out ^= out >> np.uint64(32)
    return out.view(np.int64)


def small_values(sig: np.ndarray) -> np.ndarray:
    """8 bits of each minimum."""
    return ((sig * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


@cache
def least_matches() -> tuple[int, ...]:
    """After 1, 2, ... batches: the fewest matches with which a pair may still reach the threshold.

    The posterior of the similarity J, uniform before, after m of n matches of probability J + (1 - J) / 256 each.
    """
    j = (np.arange(8000) + 0.5) / 8000
    r = j + (1 - j) / 256
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(r) + (n - m) * np.log1p(-r)
            w = np.exp(log - log.max())
            if w[j >= PERCENT / 100].sum() >= MISS * w.sum():
                out.append(m)
                break
    return tuple(out)


def survivors(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matches of the pairs of signatures (rows of a and b) that are not pruned, and -1 of the others."""
    out = np.full(len(a), -1, np.int64)
    left, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for i, least in enumerate(least_matches()):
        s = slice(i * BATCH, (i + 1) * BATCH)
        matches = matches + (a[left, s] == b[left, s]).sum(axis=1)
        fine = matches >= least
        left, matches = left[fine], matches[fine]
    out[left] = matches
    return out


def _features(docs: DataFrame) -> DataFrame:
    """doc_id, tkey (hash of the text), node, n (size of the set), bands, sig; node null for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, n, bands, sig = [], [], [], []
            for t in b.column("text").to_pylist():
                s = shingles(t)
                n.append(len(s))
                if len(s):
                    values = signature(s)
                    node.append(int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True))
                    bands.append(band_keys(values))
                    sig.append(small_values(values).tobytes())
                else:
                    for x in (node, bands, sig):
                        x.append(None)
            yield pa.record_batch(
                {"doc_id": b.column("doc_id"), "tkey": b.column("tkey"), "node": pa.array(node, pa.int64()), "n": pa.array(n, pa.int64()), "bands": pa.array(bands, pa.list_(pa.int64())), "sig": pa.array(sig, pa.binary())}
            )
        give_back()

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tkey"), "text")
    return rows.mapInArrow(run, "doc_id long, tkey long, node long, n long, bands array<bigint>, sig binary")


def _bounded(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of edges (a, b); root is the smallest node that can be reached."""
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        edges = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        joined = edges.join(least, "a")
        edges = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a != b").distinct()
        edges = stored(edges, "edges")
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def _pairs_survive(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs (a, b) that aren't pruned, with their matches."""

    def run(sa: pa.Array, sb: pa.Array) -> pa.Array:
        sides = [np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(-1, HASHES) for x in (sa, sb)]
        return pa.array(survivors(*sides))

    side = [nodes.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("n").alias(f"n_{c}")) for c in "ab"]
    found = pairs.join(side[0], "a").join(side[1], "b").where(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
    return found.select("a", "b", F.arrow_udf(run, "long")("sig_a", "sig_b").alias("matches")).where("matches >= 0")


def _texts(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes. Only their texts are shuffled."""
    keys = stored(wanted.join(nodes.select("node", "rep.doc_id", "rep.tkey"), "node"), "wanted")
    texts = docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text").join(_bounded(keys), ["doc_id", "tkey"]).select("node", "text")
    return texts.dropDuplicates(["node"])


def _confirm(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    texts = stored(_texts(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, docs), "texts")

    def run(ta: pa.Array, tb: pa.Array) -> pa.Array:
        out, last, hub = [], None, set()
        for x, y in zip(ta.to_pylist(), tb.to_pylist(), strict=True):
            if y != last:
                last, hub = y, shingle_set(y)
            own = shingle_set(x)
            both = len(own & hub)
            out.append(100 * both >= PERCENT * (len(own) + len(hub) - both))
        return pa.array(out, pa.bool_())

    side = [texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab"]
    joined = pairs.select("a", "b").join(side[0], "a").join(side[1], "b")
    return joined.select("a", "b", F.arrow_udf(run, "boolean")("text_a", "text_b").alias("linked")).where("linked").select("a", "b")


def similar(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the others (sorted sets) reach the threshold with one; exact."""
    sizes = np.array([len(x) for x in others])
    flat = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    both = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(sizes)[:-1]]), dtype=np.int64)
    return 100 * both >= PERCENT * (len(one) + sizes - both)


def links_across(node: np.ndarray, root: np.ndarray, block: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], one_block: bool) -> list[tuple[int, int]]:
    """Links between components in one block of a bucket or between two, as many as join what belongs together."""
    found = []
    part = np.unique(root, return_inverse=True)[1]
    n = np.array([len(x) for x in sets])
    for i in range(len(node) - 1):
        fits = (part[i + 1 :] != part[i]) & (100 * np.minimum(n[i + 1 :], n[i]) >= PERCENT * np.maximum(n[i + 1 :], n[i]))
        if not one_block:
            fits &= block[i + 1 :] != block[i]
        rest = np.flatnonzero(fits) + i + 1
        if len(rest):
            rest = rest[survivors(np.broadcast_to(sig[i], (len(rest), HASHES)), sig[rest]) >= 0]
        for lo in range(0, len(rest), 256):
            some = rest[lo : lo + 256]
            some = some[part[some] != part[i]]
            if len(some):
                for j in some[similar(sets[i], [sets[j] for j in some])]:
                    if part[j] != part[i]:
                        found.append((int(node[i]), int(node[j])))
                        part[part == part[j]] = part[i]
    return found


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted blocks (key, lo, hi; block, node, root, n, bands, sig) the nodes with a pair across components that isn't pruned.

    A pair that shares several buckets counts in that of the smallest key only.
    """
    held: list[dict] = []

    def told() -> pa.RecordBatch:
        root, block, n = (np.array([r[c] for r in held]) for c in ("root", "block", "n"))
        sig = np.frombuffer(b"".join(r["sig"] for r in held), np.uint8).reshape(-1, HASHES)
        bands, key = np.array([r["bands"] for r in held], np.int64), held[0]["key"]
        one_block, hit = held[0]["lo"] == held[0]["hi"], np.zeros(len(held), bool)
        for i in range(len(held) - 1):
            fits = (root[i + 1 :] != root[i]) & (100 * np.minimum(n[i + 1 :], n[i]) >= PERCENT * np.maximum(n[i + 1 :], n[i]))
            if not one_block:
                fits &= block[i + 1 :] != block[i]
            if hit[i]:  # only others still matter
                fits &= ~hit[i + 1 :]
            rest = np.flatnonzero(fits) + i + 1
            if len(rest):
                rest = rest[survivors(np.broadcast_to(sig[i], (len(rest), HASHES)), sig[rest]) >= 0]
                rest = rest[((bands[rest] == bands[i]) & (bands[i] < key)).sum(axis=1) == 0]
                hit[rest] = True
                hit[i] |= len(rest) > 0
        kinds = {"key": pa.int64(), "lo": pa.int32(), "hi": pa.int32(), "block": pa.int32(), "node": pa.int64(), "root": pa.int64()}
        return pa.record_batch({c: pa.array([held[i][c] for i in np.flatnonzero(hit)], k) for c, k in kinds.items()})

    for b in batches:
        for r in b.to_pylist():
            if held and any(r[c] != held[0][c] for c in ("key", "lo", "hi")):
                yield told()
                held.clear()
            held.append(r)
    if held:
        yield told()
    held.clear()
    give_back()


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, node, root) of the buckets that hold several components."""
    now = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    now = stored(now, "bucket-roots")
    several = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
    return stored(now.join(several, "key"), "mixed-buckets")


def _merged(members: DataFrame, nodes: DataFrame, roots: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roots, mixed): components joined in rounds as long as that joins many, and the buckets that still hold several.

    In a round, a bucket's nodes meet one node of it, another in each round, and the best pair of a component is
    confirmed. So a round costs as much as there are rows in mixed buckets, however large a bucket is.
    """
    turn, gained = 0, True
    while not (mixed := _mixed(members, roots)).isEmpty() and gained:
        turn += 1
        heads = mixed.groupBy("key").agg(F.min_by(F.struct("node", "root"), F.struct(F.xxhash64(F.lit(turn), "node"), "node")).alias("head"))
        met = mixed.join(heads, "key").where("root != head.root").select(F.col("node").alias("a"), F.col("head.node").alias("b"), "root").distinct()
        met = stored(met, "met")
        near = _pairs_survive(met.select("a", "b"), nodes).join(met, ["a", "b"])
        best = near.groupBy("root").agg(F.max_by(F.struct("a", "b"), F.struct("matches", "a", "b")).alias("p")).select("p.a", "p.b")
        found = stored(_confirm(stored(best, "tested"), nodes, docs), "links")
        if not (links := found.count()):
            break
        gained = WORTH * links >= mixed.select("root").distinct().count()
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found))
        members = mixed.select("key", "node")
    return roots, mixed


def _across(mixed: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): confirmed links between components, from buckets that hold several.

    The nodes of a bucket's largest component and its other nodes are cut into blocks by hash. Each block of others
    meets each block, itself included, and each such pair is a group of its own: the largest component is never
    compared with itself.
    """
    now = mixed.join(nodes.select("node", "n"), "node")
    parts = now.groupBy("key", "root").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"), *(F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"x{i}") for i in (1, 2)))
    main = F.max(F.struct("size", "root", "shingles")).alias("main")
    whole = parts.groupBy("key").agg(main, F.sum("size").alias("size"), F.sum("shingles").alias("shingles"), *(F.bit_xor(x).alias(x) for x in ("x1", "x2")))

    def blocks(size: Column, shingles: Column) -> Column:
        return F.greatest(F.ceil(size / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")

    few, many = blocks(F.col("size") - F.col("main.size"), F.col("shingles") - F.col("main.shingles")), blocks(F.col("main.size"), F.col("main.shingles"))
    # Buckets with the same nodes have the same components too; of these the smallest key stays, as _paired asks.
    cuts = whole.groupBy("size", "x1", "x2").agg(F.min("key").alias("key"), F.max("main.root").alias("main"), F.max(few).alias("few"), F.max(many).alias("many"))
    inside, block = F.col("root") == F.col("main"), F.xxhash64(F.lit(9), "node")
    rows = mixed.join(cuts.select("key", "main", "few", "many"), "key")
    rows = rows.withColumn("block", F.when(inside, F.col("few") + F.pmod(block, F.col("many"))).otherwise(F.pmod(block, F.col("few"))).cast("int"))
    rows = rows.withColumn("last", F.when(inside, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)

    other = F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other")
    rows = rows.select("key", "block", "node", "root", other).select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "root")
    at = ["key", "lo", "hi"]
    paired = rows.join(nodes.select("node", "n", "bands", "sig"), "node").repartition(*at).sortWithinPartitions(*at, "node").mapInArrow(_paired, "key long, lo int, hi int, block int, node long, root long")
    paired = stored(paired, "paired-nodes")

    def to_set(texts: pa.Array) -> pa.Array:
        return pa.array([shingles(t).tobytes() for t in texts.to_pylist()], pa.binary())

    sets = _texts(paired.select("node").distinct(), nodes, docs).select("node", F.arrow_udf(to_set, "binary")("text").alias("shingles"))
    sets = stored(sets.join(nodes.select("node", "sig"), "node"), "sets")
    rows = paired.join(sets, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def told() -> pa.RecordBatch:
            node, root, block = (np.array([r[c] for r in held]) for c in ("node", "root", "block"))
            sig = np.frombuffer(b"".join(r["sig"] for r in held), np.uint8).reshape(-1, HASHES)
            sets = [np.frombuffer(r["shingles"], np.uint64) for r in held]
            found = links_across(node, root, block, sig, sets, held[0]["lo"] == held[0]["hi"])
            return pa.record_batch({c: pa.array([f[i] for f in found], pa.int64()) for i, c in enumerate("ab")})

        for b in batches:
            for r in b.to_pylist():
                if held and any(r[c] != held[0][c] for c in ("key", "lo", "hi")):
                    yield told()
                    held.clear()
                held.append(r)
        if held:
            yield told()
        held.clear()
        give_back()

    found = rows.repartition(*at).sortWithinPartitions(*at, "node").mapInArrow(run, "a long, b long")
    return found.distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    return _judged(docs).drop("tkey")


def _judged(docs: DataFrame) -> DataFrame:
    """As near_duplicates, and tkey, the hash of the text."""
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    rows = stored(_features(docs), "features")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tkey")).alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    nodes = stored(nodes, "nodes")
    keys = nodes.select("node", F.explode("bands").alias("key"))
    heads = keys.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head != last").select("key", "head")
    members = stored(keys.join(heads, "key").select("key", "node", "head"), "members")
    star = members.where("node != head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    near = stored(_pairs_survive(star, nodes), "survivors")
    best = near.groupBy("a").agg(F.max_by("b", F.struct("matches", "b")).alias("b"))
    links = stored(_confirm(stored(best, "tested"), nodes, docs), "links")
    roots = components(links)
    roots, mixed = _merged(members.select("key", "node"), nodes, roots, docs)
    more = stored(_across(mixed, nodes, docs), "links")
    if not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    named = nodes.select("node", F.col("rep.doc_id").alias("first")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = stored(named, "roots-of-nodes")
    least = stored(named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("size")), "components")
    hot = least.where(F.col("size") > HOT).select("root", "component_id")  # at most a HOT-th of the nodes
    cold = named.join(_bounded(hot), "root", "left_anti").join(least.where(F.col("size") <= HOT), "root")
    named = named.join(_bounded(hot), "root").select("node", "component_id").unionByName(cold.select("node", "component_id"))
    out = rows.select("doc_id", "tkey", "n", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "tkey", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns. Of repeated rows that are kept all stay.

    A row is known by its doc_id, null included, and its text: rows of one doc_id with different texts are judged
    apart. What goes is mostly far less than what stays, so what goes is joined.
    """
    gone = _judged(docs).where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("tkey").alias("gone_key")).distinct()
    gone = stored(gone, "gone")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_key"))
    return docs.join(_bounded(gone), same, "left_anti").select(*docs.columns)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') t from documents),
s as (select doc_id, list_distinct(case when len(t) < 2 then t else list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) end) g from w),
e as materialized (select doc_id, unnest(g) g from s),
p as (select a.doc_id x, b.doc_id y, count(*) c from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as materialized (select x, y from p join s i on i.doc_id = x join s j on j.doc_id = y where 100 * c >= 80 * (len(i.g) + len(j.g) - c)),
b as materialized (select x, y from l union all select y, x from l),
r(doc_id, root) as (select doc_id, doc_id from s union select r.doc_id, b.y from r join b on b.x = r.root)
select doc_id, any_value(len(g))::bigint n_shingles, min(root) component_id, doc_id = min(root) as kept from r join s using (doc_id) group by doc_id"""

QUERIES = {"op5_minhash_near_dedup": op5_minhash_near_dedup}
ORACLE_SQL = {"op5_minhash_near_dedup": _SQL}
