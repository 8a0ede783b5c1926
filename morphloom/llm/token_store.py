"""Content-addressed store of token ids.

Each document's id stream is cut where a rolling hash of its last ids says so, thus equal passages of several chunks
share those inside wherever they stand. Chunks of about 190 ids are well below a usual document. A chunk is named by
its digest and stored once. A document is kept as a recipe, the digests of its chunks in order, with the Merkle root
over them; each part of the manifest has the root over its documents, and the store has one over its parts. Reading
checks every chunk against its name, every recipe against its root, and the manifest against the number of documents,
the number of ids and the root of each part.

The store is a folder:
  objects/kind=chunk     digest, n (ids), data: little-endian ids of 16 bits, or of 32 where one needs it; Parquet compresses
  manifest               doc_id, seq, start, n_tokens, chunks (digests in order), root; sorted, in ascending doc_id order
  parts                  part, first_start, n_docs, n_tokens, root
Texts are encoded once. Chunks and raw recipes leave that pass together and meet in one shuffle by digest; a task
sends a chunk only once however many copies it read.

Edge cases: a null or empty text is a stream of the end id alone. Repeated rows are documents of their own that share
their chunks; among equal doc_ids the order is that of a hash of their roots. Null doc_id comes first. An empty table gives an
empty store. Only doc_id and text are read, so further columns don't matter. A very long text is encoded as one and
cut in slices, so what it takes is a small multiple of its own size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import bounded_batches, give_back, new_path, stored
from .tokens import encoder, vocabulary

LEAST, MASK, MOST = 64, 127, 8192  # ids in a chunk: at least, on average about MASK more, at most
REMEMBERED = 80 << 20  # bytes for white-space units whose ids a worker remembers
SEEN = 100_000  # digests that a task remembers to have sent
SLICE = 1 << 18  # ids whose rolling hashes are worked out at a time
_OBJECT = "kind string, key binary, n long, data binary, doc_id long, chunks array<binary>, root binary"


@lru_cache
def _gear() -> np.ndarray:
    x = np.arange(1, 65537, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _candidates(ids: np.ndarray) -> np.ndarray:
    """Places after which the rolling hash of the last 16 ids asks for a cut."""
    found = []
    for lo in range(0, len(ids), SLICE):
        skip = min(lo, 15)
        h = _gear()[ids[lo - skip : lo + SLICE] & 0xFFFF]
        for k in (1, 2, 4, 8):
            h[k:] += h[:-k].copy() << np.uint64(k)
        found.append(np.flatnonzero((h[skip:] >> np.uint64(20)) & np.uint64(MASK) == 0) + (lo + 1))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def cuts(ids: np.ndarray, ends: list[int] | None = None) -> list[int]:
    """Ends of the chunks of documents that stand one after another and end at ends (one document, if not given).

    A cut depends on the 16 ids before it and, through LEAST and MOST, on the cut before; as no chunk is shorter than
    LEAST but the last of a document, ids of other documents never matter.
    """
    ends = [len(ids)] * bool(len(ids)) if ends is None else ends
    places = _candidates(ids)
    upto = np.searchsorted(places, ends).tolist()
    places = places.tolist()
    out, at, i = [], 0, 0
    for end, to in zip(ends, upto, strict=True):
        for p in places[i:to]:
            while p - at > MOST:
                at += MOST
                out.append(at)
            if p - at >= LEAST:
                out.append(p)
                at = p
        while end - at > MOST:
            at += MOST
            out.append(at)
        if end > at:
            out.append(end)
        at, i = end, to
    return out


def digest(raw: bytes) -> bytes:
    return blake2b(raw, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root over digests; an odd one moves up as it is."""
    if not leaves:
        return digest(b"")
    while len(leaves) > 1:
        leaves = [digest(b"\x01" + b"".join(leaves[i : i + 2])) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


def widened(column: pa.Array, sizes: np.ndarray) -> list[memoryview]:
    """Each chunk's ids as little-endian 32-bit bytes, from its stored form."""
    if (pc.binary_length(column).to_numpy(zero_copy_only=False) == 2 * sizes).all():  # one step for all of them
        flat = b"".join(column.to_pylist())
        raw, ends = memoryview(np.frombuffer(flat, "<u2").astype("<u4").tobytes()), (4 * np.cumsum(sizes)).tolist()
        return [raw[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False)]
    return [memoryview(x if len(x) == 4 * n else np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x, n in zip(column.to_pylist(), sizes.tolist(), strict=True)]


def _times(matrix: list[int], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


@lru_cache
def _skip(power: int) -> list[int]:
    """What 2**power zero bytes do to a CRC, as a matrix over bits."""
    if power == 0:
        one = [0xEDB88320, *(1 << i for i in range(31))]
        for _ in range(3):
            one = [_times(one, x) for x in one]
        return one
    half = _skip(power - 1)
    return [_times(half, x) for x in half]


@lru_cache
def _skip_table(power: int) -> list[np.ndarray]:
    """The same for each value of each byte of a CRC."""
    return [np.array([_times(_skip(power)[8 * i : 8 * i + 8], x) for x in range(256)], np.int64) for i in range(4)]


def crc_joined(crcs: np.ndarray, sizes: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
    """CRC32 of each owner's byte strings put together, from theirs and their lengths; owner ascends.

    That of a string with n bytes after it counts as if n zero bytes followed; those of one owner are added by XOR.
    """
    ends = np.cumsum(sizes)
    last = np.zeros(owners, np.int64)
    last[owner] = ends  # of several the last is kept
    after, out = last[owner] - ends, crcs.astype(np.int64)
    for power in range(int(after.max(initial=0)).bit_length()):
        at = np.flatnonzero(after >> power & 1)
        a, b, c, d = _skip_table(power)
        x = out[at]
        out[at] = a[x & 255] ^ b[x >> 8 & 255] ^ c[x >> 16 & 255] ^ d[x >> 24]
    whole = np.zeros(owners, np.int64)
    np.bitwise_xor.at(whole, owner, out)
    return whole


def _objects(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sent = encoder(path, REMEMBERED), set()
        tail = np.array([end], "<u4").tobytes()
        for b in batches:
            if not b.num_rows:
                continue
            raws = [enc.encode(t) + tail for t in b.column(1).to_pylist()]
            n = np.array([len(x) // 4 for x in raws], np.int64)
            whole = b"".join(raws)
            raw = memoryview(whole)
            raws.clear()
            ids, ends = np.frombuffer(raw, "<u4"), np.cumsum(n)
            to = cuts(ids, ends.tolist())
            names = [digest(raw[4 * lo : 4 * hi]) for lo, hi in zip([0, *to], to, strict=False)]
            fresh = []
            for i, x in enumerate(names):
                if x not in sent:
                    fresh.append(i)
                    if len(sent) < SEEN:
                        sent.add(x)
            wide = len(ids) and int(ids.max()) > 0xFFFF
            # bytes, as pa.array never lets go of a memoryview: a worker would keep the ids of every batch it has seen
            short = whole if wide else ids.astype("<u2").tobytes()
            starts, width = [0, *to], 4 if wide else 2
            data = [short[width * starts[i] : width * to[i]] for i in fresh]
            if wide:
                data = [x if int(i.max()) > 0xFFFF else i.astype("<u2").tobytes() for x in data for i in (np.frombuffer(x, "<u4"),)]
            sizes = np.diff(starts)
            yield _rows("chunk", len(fresh), key=pa.array([names[i] for i in fresh], pa.binary()), n=pa.array(sizes[fresh]), data=pa.array(data, pa.binary()))
            first = np.concatenate([[0], np.searchsorted(to, ends) + 1]).astype(np.int32)
            roots = pa.array([merkle(names[lo:hi]) for lo, hi in zip(first.tolist(), first[1:].tolist(), strict=False)], pa.binary())
            yield _rows("recipe", len(n), key=roots, n=pa.array(n), doc_id=b.column(0), chunks=pa.ListArray.from_arrays(pa.array(first), pa.array(names, pa.binary())), root=roots)
        give_back()

    return run


def _rows(kind: str, rows: int, **columns: pa.Array) -> pa.RecordBatch:
    kinds = {"key": pa.binary(), "n": pa.int64(), "data": pa.binary(), "doc_id": pa.int64(), "chunks": pa.list_(pa.binary()), "root": pa.binary()}
    return pa.record_batch({"kind": pa.array([kind] * rows, pa.string())} | {c: columns.get(c, pa.nulls(rows, t)) for c, t in kinds.items()})


def write_store(docs: DataFrame, path: str, tokenizer: str, end: int) -> str:
    """Write docs (doc_id long, text) as a store at path; returns path."""
    spark = docs.sparkSession
    bounded_batches(spark)
    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_objects(tokenizer, end), _OBJECT)
    # recipes are dealt by doc_id, chunks by name; of several copies of a chunk the first stays
    spread = F.when(F.col("kind") == "chunk", F.xxhash64("key")).otherwise(F.xxhash64(F.lit(3), "doc_id", F.monotonically_increasing_id()))
    made = made.withColumn("spread", spread)
    once = made.withColumn("copy", F.row_number().over(W.partitionBy("spread", "kind", "key").orderBy("n"))).where("kind = 'recipe' or copy = 1")
    once.drop("spread", "copy").write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/objects")
    _write_manifest(spark, path)
    return path


def _folder(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(_OBJECT).parquet(f"{path}/objects").where(F.col("kind") == kind)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Local starts and places of sorted recipes."""
    part, start, seq = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        n = b.column("n").to_numpy(zero_copy_only=False)
        upto = start + np.cumsum(n)
        yield pa.record_batch({"part": pa.array(np.full(len(n), part)), "seq": pa.array(seq + np.arange(len(n))), "doc_id": b.column("doc_id"), "start": pa.array(upto - n), "n_tokens": b.column("n")} | {c: b.column(c) for c in ("chunks", "root")})
        start, seq = (int(upto[-1]) if len(n) else start), seq + len(n)


def _part_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each part from its rows in order: a Merkle root by a stack of subtrees, so memory stays small."""
    now, stack, docs, tokens = None, [], 0, 0

    def told() -> pa.RecordBatch:
        return pa.record_batch({"part": [now], "n_docs": [docs], "n_tokens": [tokens], "root": pa.array([merkle([x for _, x in stack])], pa.binary())})

    for b in batches:
        for r in b.to_pylist():
            if r["part"] != now:
                if now is not None:
                    yield told()
                now, stack, docs, tokens = r["part"], [], 0, 0
            node = (0, r["root"])
            while stack and stack[-1][0] == node[0]:
                node = (node[0] + 1, digest(b"\x01" + stack.pop()[1] + node[1]))
            stack.append(node)
            docs, tokens = docs + 1, tokens + r["n_tokens"]
    if now is not None:
        yield told()


def _write_manifest(spark: SparkSession, path: str) -> None:
    recipes = _folder(spark, path, "recipe").select("doc_id", "n", "chunks", "root").withColumn("tie", F.xxhash64("root"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    local = recipes.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    local = stored(local.mapInArrow(_number, "part long, seq long, doc_id long, start long, n_tokens long, chunks array<binary>, root binary"), "recipes")
    # one row for each part; parts are as many as shuffle partitions
    totals = local.groupBy("part").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("d"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in "td"))
    whole = local.join(F.broadcast(totals), "part").withColumns({"start": F.col("start") + F.col("t0"), "seq": F.col("seq") + F.col("d0")})
    whole.sortWithinPartitions("part", "seq").drop("t0", "d0").write.option("compression", "zstd").parquet(f"{path}/manifest")
    _parts_of(spark, path).coalesce(1).write.parquet(f"{path}/parts")


def _parts_of(spark: SparkSession, path: str) -> DataFrame:
    """part, n_docs, n_tokens, root as the manifest's rows have them."""
    kept = spark.read.parquet(f"{path}/manifest").select("part", "seq", "n_tokens", "root").repartition("part").sortWithinPartitions("part", "seq")
    return kept.mapInArrow(_part_roots, "part long, n_docs long, n_tokens long, root binary")


def _verified(spark: SparkSession, path: str) -> DataFrame:
    """The manifest, whose rows must give the parts as they were written. Parts are as many as shuffle partitions."""
    told, found = ({r["part"]: tuple(r) for r in x.select("part", "n_docs", "n_tokens", "root").collect()} for x in (spark.read.parquet(f"{path}/parts"), _parts_of(spark, path)))
    for part in sorted(told.keys() | found.keys()):
        if told.get(part) != found.get(part):
            raise ValueError(f"part {part} of the manifest doesn't match its root and totals")
    return spark.read.parquet(f"{path}/manifest")


def store_root(spark: SparkSession, path: str) -> bytes:
    """The root over the parts, of which there are as many as shuffle partitions."""
    return merkle([bytes(r["root"]) for r in spark.read.parquet(f"{path}/parts").orderBy("part").collect()])


def _checked(keys: pa.Array, sizes: np.ndarray, data: pa.Array) -> list[memoryview]:
    """The ids of chunks, each of which must match its name."""
    raws = widened(data, sizes)
    for key, raw in zip(keys.to_pylist(), raws, strict=True):
        if digest(raw) != key:
            raise ValueError(f"chunk {key.hex()} doesn't match its name")
    return raws


def _check_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raws = _checked(b.column("key"), b.column("n").to_numpy(zero_copy_only=False), b.column("data"))
        yield pa.record_batch({"key": b.column("key"), "size": b.column("n"), "crc": pa.array(map(zlib.crc32, raws), pa.int64())})
    give_back()


def _rebuilt(parts: pa.Array, roots: pa.Array) -> pa.Array:
    """CRC32 of each document from those of its chunks; null where recipe and root differ."""
    n = np.array([len(x) for x in parts], np.int64)
    flat = parts.flatten()
    if flat.field("crc").null_count:
        raise ValueError("a chunk of a recipe is missing")
    crcs, sizes = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("crc", "size"))
    whole = crc_joined(crcs, 4 * sizes, np.repeat(np.arange(len(n)), n), len(n)).tolist()
    keys, ends = flat.field("key").to_pylist(), np.cumsum(n).tolist()
    return pa.array([x if merkle(keys[lo:hi]) == root else None for x, lo, hi, root in zip(whole, [0, *ends], ends, roots.to_pylist(), strict=False)], pa.int64())


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    Each chunk is read, decoded and checked once; its length and CRC then stand for it in the recipes, and the CRC of
    a document's whole stream follows from those of its chunks. A broken chunk or recipe stops the query.
    """
    bounded_batches(spark)
    chunks = _folder(spark, path, "chunk").select("key", "n", "data").mapInArrow(_check_chunks, "key binary, size long, crc long")
    manifest = _verified(spark, path)
    used = manifest.select("seq", F.posexplode("chunks").alias("pos", "key")).join(chunks, "key", "left")
    parts = used.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("pos", "key", "size", "crc"))).alias("parts"), F.sum("size").alias("n"))
    rebuilt = F.arrow_udf(_rebuilt, "long")
    out = manifest.select("seq", "doc_id", "start", "root").join(parts, "seq").withColumn("ids_crc32", rebuilt("parts", "root"))
    fine = F.when(F.col("ids_crc32").isNull(), F.raise_error(F.lit("a recipe doesn't match its root"))).otherwise(F.col("ids_crc32"))
    return out.select("doc_id", "start", F.col("n").alias("n_tokens"), fine.cast("long").alias("ids_crc32"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids: the documents put together again."""
    bounded_batches(spark)

    def opened(keys: pa.Array, sizes: pa.Array, data: pa.Array) -> pa.Array:
        raws = _checked(keys, sizes.to_numpy(zero_copy_only=False), data)
        return pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in raws], pa.list_(pa.int64()))

    chunks = _folder(spark, path, "chunk").withColumn("ids", F.arrow_udf(opened, "array<bigint>")("key", "n", "data")).select("key", "ids")
    manifest = _verified(spark, path)
    used = manifest.select("seq", F.posexplode("chunks").alias("pos", "key")).join(chunks, "key")
    whole = used.groupBy("seq").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ids"))), lambda x: x["ids"])).alias("ids"))
    return manifest.select("seq", "doc_id", "start").join(whole, "seq").select("doc_id", "start", "ids")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_summary(spark, write_store(docs, new_path(spark, "store"), vocabulary("byte_bpe_50k.json"), 2))


QUERIES = {"op7_token_store": op7_token_store}
ORACLE_SQL: dict[str, str] = {}
