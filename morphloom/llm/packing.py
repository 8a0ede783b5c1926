"""Best-fit packing of token sequences by large-item matching.

Only lengths matter for packing, and there are at most CAPACITY of them. So the packing is worked out over the counts
by length, whatever the number of documents: pieces above a third of the capacity meet at most twice in a bin, by a
greedy matching (the largest with the largest that still fits); smaller ones, by falling length, go into the smallest
gap that holds them. The result is a list of patterns with multiplicities, bounded by the capacity. Each piece then
finds its place from its rank among the pieces of its length. Ranks are counted in buckets of each length, so that a
length that a third of all pieces have is ranked by many tasks.

Edge cases: a null or empty text is the end id alone. Repeated rows are packed each. An empty table has no pieces.
Only documents longer than the capacity are cut, into full pieces and a rest.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import bounded_batches, stored
from .tokens import encoder, vocabulary

CAPACITY = 2048


def pack_lengths(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Patterns (number of bins, ((length, copies), ...)) that hold counts[length] pieces of each length."""
    left = {x: n for x, n in counts.items() if n}
    large = sorted(x for x in left if 3 * x > capacity)
    groups: dict[int, list[tuple[int, tuple]]] = {}
    gaps: list[int] = []

    def add(gap: int, bins: int, items: tuple) -> None:
        if gap not in groups:
            groups[gap] = []
            insort(gaps, gap)
        groups[gap].append((bins, items))

    while large:
        x = large[-1]
        at = bisect_right(large, min(x, capacity - x)) - 1
        if at < 0:
            add(capacity - x, left[x], ((x, 1),))
            large.pop()
        elif large[at] == x:
            if left[x] > 1:
                add(capacity - 2 * x, left[x] // 2, ((x, 2),))
            left[x] %= 2
            if left[x]:  # the odd one takes the next largest
                below = at - 1
                if below >= 0:
                    y = large[below]
                    add(capacity - x - y, 1, ((x, 1), (y, 1)))
                    left[y] -= 1
                    if not left[y]:
                        large.pop(below)
                else:
                    add(capacity - x, 1, ((x, 1),))
            large.remove(x)
        else:
            y = large[at]
            n = min(left[x], left[y])
            add(capacity - x - y, n, ((x, 1), (y, 1)))
            for z in (x, y):
                left[z] -= n
                if not left[z]:
                    large.remove(z)
    for x in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        n = left[x]
        while n:
            at = bisect_left(gaps, x)
            if at == len(gaps):
                add(capacity, -(-n // (capacity // x)), ())
                continue
            gap = gaps[at]
            bins, items = groups[gap].pop()
            if not groups[gap]:
                del groups[gap]
                gaps.pop(at)
            copies = gap // x
            full = min(bins, n // copies)
            used = full or 1
            if not full:
                copies = n
            n -= used * copies
            if bins > used:
                add(gap, bins - used, items)
            add(gap - copies * x, used, (*items, (x, copies)))
    return [(bins, items) for gap in gaps for bins, items in groups[gap] if items]


def places(patterns: list[tuple[int, tuple[tuple[int, int], ...]]]) -> np.ndarray:
    """Rows (length, first rank, copies, first sequence, offset) by length and rank: where the pieces of a length go."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for bins, items in patterns:
        offset = 0
        for x, copies in items:
            rows.append((x, used.get(x, 0), copies, sequence, offset))
            used[x] = used.get(x, 0) + copies * bins
            offset += copies * x
        sequence += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (length from 1 to capacity, other columns) with sequence_id and offset."""
    spark = pieces.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = stored(pieces.withColumn("_uid", F.monotonically_increasing_id()), "pieces").withColumn("_bucket", F.pmod(F.xxhash64("_uid"), F.lit(buckets)))
    sizes = stored(pieces.groupBy("length", "_bucket").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    table = places(pack_lengths(counts, capacity))
    sent = spark.sparkContext.broadcast(table)  # its size is bounded by the capacity

    def find(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        t = sent.value
        x, r = np.asarray(lengths), np.asarray(ranks)
        row = t[np.searchsorted((t[:, 0] << 44) + t[:, 1], (x << 44) + r, "right") - 1]
        bin_, copy = np.divmod(r - row[:, 1], row[:, 2])
        return pa.StructArray.from_arrays([pa.array(row[:, 3] + bin_), pa.array(row[:, 4] + copy * x)], ["sequence_id", "offset"])

    before = W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("length", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    ranked = pieces.withColumn("_rank", F.row_number().over(W.partitionBy("length", "_bucket").orderBy("_uid")).cast("long"))
    ranked = ranked.join(sizes, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before") - 1)
    out = ranked.withColumn("_place", F.arrow_udf(find, "struct<sequence_id:bigint,offset:bigint>")("length", "_rank"))
    return out.withColumns({c: F.col("_place")[c] for c in ("sequence_id", "offset")}).drop("_place", "_rank", "_before", "_bucket", "_uid")


def cut_documents(docs: DataFrame, path: str, end: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids (binary, little-endian 32-bit) of all pieces."""
    bounded_batches(docs.sparkSession)
    tail = np.array([end], "<u4").tobytes()

    def code(texts: pa.Array) -> pa.Array:
        enc = encoder(path)
        return pa.array([enc.encode(t) + tail for t in texts.to_pylist()], pa.binary())

    coded = docs.select("doc_id", F.arrow_udf(code, "binary")("text").alias("all"))
    coded = coded.withColumn("n", (F.octet_length("all") / 4).cast("long"))
    cut = coded.select("doc_id", "all", "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {capacity})")).alias("piece"))
    return cut.select(
        "doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("long").alias("length"),
        F.substring("all", (F.col("piece") * capacity * 4 + 1).cast("int"), F.lit(capacity * 4)).alias("ids"),
    )


def pack_documents(docs: DataFrame, path: str, end: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of docs (doc_id, text).

    The ids themselves come from ``cut_documents``; packing needs their lengths only, so no ids are shuffled.
    """
    pieces = cut_documents(docs, path, end, capacity)
    return pack_pieces(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    packed = pack_documents(docs, vocabulary("word_bpe_49k.json"), 0)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op4_best_fit_packing": op4_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
