"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are cut into segments. The index is a table with a row for each segment of each code, in groups by the first bits
of the segment's value, large groups in blocks. Queries start with their own segment values, then take all values at
distance 1, 2, ...; a round covers STEP radii: each query goes to the groups that can hold such values, meets their rows
in an equi-join, and its best are merged with those of earlier rounds. Once radius r has been searched in all of m
segments, every code within m * (r + 1) - 1 bits has been met, so a query ends as soon as its k-th verified distance is
that small; only the others go on. No code is verified twice: it counts for the first of its nearest segments only.

Equal codes are reduced to their k + 1 smallest ids before anything is compared (more can't be among the k nearest),
and equal queries are searched once. What is shuffled in a round is the index, once, and a number of rows for each
query that goes on which depends on the radius, not on the number of codes.

Edge cases: the k nearest other ids are given, by distance, then id; fewer if there are fewer. A vector is no
neighbour of its own id. Null vectors and null ids are left out. Repeated rows of an id count once. An id with several
codes is searched with each and found by each: the least distance between codes of two ids counts, and ranks are given
once for each query id. Vectors are bounded in length (see below); other columns aren't read.
The code has one bit for each component, which is whether it is positive; nulls inside a vector count as 0. A vector of
more than 64 components is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import bounded_batches, give_back, stored

WIDTH = 64
GROUP, BLOCK = 1 << 14, 1 << 16  # codes in a group on average, and in a block of one at most
MAX_PREFIX = 14  # bits that may tell groups apart
STEP = 2  # radii in a round
CELLS = 1 << 20  # values looked up at a time
K = 10


def sign_code(vector: Column) -> Column:
    """64 bits as a long: bit i tells whether component i is positive. Longer vectors stop the query."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    placed = F.transform(F.slice(vector, 1, WIDTH), lambda x, i: F.when(x > 0, F.call_function("shiftleft", one, i)).otherwise(none))
    code = F.aggregate(placed, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    return F.when(F.size(vector) > WIDTH, F.raise_error(F.lit(f"a vector has more than {WIDTH} components")).cast("long")).otherwise(code)


def segments_for(n: int) -> int:
    """About log2(n) bits a segment, as makes a value hold one code on average; 4 to 16 segments of a width that divides."""
    bits = min(16, max(4, round(np.log2(max(n, 2)))))
    return next(m for m in (4, 8, 16) if WIDTH // m <= bits)


def masks(bits: int, ones: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in combinations(range(bits), ones)], np.int64)


class Group:
    """Codes that share the first bits of a segment, sorted by the rest of it."""

    def __init__(self, segment: int, prefix: int, codes: np.ndarray, ids: np.ndarray, segments: int, prefix_bits: int) -> None:
        self.s, self.prefix, self.m, self.width = segment, prefix, segments, WIDTH // segments
        self.bits = self.width - prefix_bits
        rest = self.value(codes, segment) & ((1 << self.bits) - 1)
        order = np.argsort(rest, kind="stable")
        self.codes, self.ids = codes[order], ids[order]
        self.start = np.searchsorted(rest[order], np.arange((1 << self.bits) + 1))

    def value(self, codes: np.ndarray, s: int) -> np.ndarray:
        return ((codes >> np.uint64(s * self.width)) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def search(self, queries: np.ndarray, limits: np.ndarray, radii: range, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of queries, ids and distances: the k nearest ids of each query in this group by segment distances in radii."""
        own = self.value(queries, self.s)
        away = np.bitwise_count((own >> self.bits) ^ self.prefix).astype(np.int64)
        rest = own & ((1 << self.bits) - 1)
        found: list[tuple[np.ndarray, ...]] = []
        for r in radii:
            for d in np.unique(away[(away <= r) & (away >= r - self.bits)]).tolist():
                flips, whose = masks(self.bits, r - d), np.flatnonzero(away == d)
                for lo in range(0, len(whose), max(1, CELLS // len(flips))):
                    who = whose[lo : lo + max(1, CELLS // len(flips))]
                    found += self._verified(queries, limits, who, (rest[who][:, None] ^ flips).ravel(), len(flips), r)
        if not found:
            return (np.zeros(0, np.int64),) * 3
        q, ids, distance = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((distance, ids, q))  # an id may be met by several codes
        q, ids, distance = q[order], ids[order], distance[order]
        once = np.ones(len(q), bool)
        once[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
        order = np.flatnonzero(once)[np.lexsort((ids[once], distance[once], q[once]))]
        rank = np.arange(len(order)) - np.searchsorted(q[order], q[order])
        order = order[rank < k]
        return q[order], ids[order], distance[order]

    def _verified(self, queries: np.ndarray, limits: np.ndarray, who: np.ndarray, values: np.ndarray, times: int, r: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Queries, ids and distances of the codes with these values, in parts of about CELLS."""
        first, n = self.start[values], self.start[values + 1] - self.start[values]
        upto = np.cumsum(n)
        at = 0
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CELLS, "right")))
            size = n[at:to]
            place = np.repeat(first[at:to] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            q = who[np.repeat(np.arange(at, to) // times, size)]
            code, asked = self.codes[place], queries[q]
            differ = code ^ asked
            distance = np.bitwise_count(differ).astype(np.int64)
            fine = distance <= limits[q]
            for t in range(self.m):  # this segment is the first of the nearest
                if t != self.s:
                    d = np.bitwise_count(self.value(differ, t))
                    fine &= (d > r) if t < self.s else (d >= r)
            yield q[fine], self.ids[place[fine]], distance[fine]
            at = to


def _search(segments: int, prefix_bits: int, radii: range, k: int):
    """Of sorted rows (s, prefix, block, kind, code, x): the codes of a block (kind 0, x their id), then queries (kind 1, x their limit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, codes, ids, group = None, [], [], None
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("s", "prefix", "block", "kind")])
            code, x = (b.column(c).to_numpy(zero_copy_only=False) for c in ("code", "x"))
            edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                at, kind = tuple(key[:3, lo].tolist()), key[3, lo]
                if at != now:
                    now, codes, ids, group = at, [], [], None
                own = code[lo:hi].view(np.uint64)
                if kind == 0:
                    codes.append(own)
                    ids.append(x[lo:hi])
                elif codes:
                    if group is None:
                        group = Group(at[0], at[1], np.concatenate(codes), np.concatenate(ids), segments, prefix_bits)
                    q, found, distance = group.search(own, x[lo:hi], radii, k)
                    yield pa.record_batch({"code": pa.array(own[q].view(np.int64)), "neighbor_id": pa.array(found), "distance": pa.array(distance)})
        give_back()

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank (from 1), neighbor_id, distance for queries (id, code) among vectors (id, code)."""
    spark = vectors.sparkSession
    bounded_batches(spark, 1 << 14)  # rows are short
    own = W.partitionBy("code").orderBy("id")
    rows = vectors.where("id is not null and code is not null").distinct().withColumn("place", F.row_number().over(own)).where(F.col("place") <= k + 1).drop("place")
    rows = stored(rows, "codes")
    asked = stored(queries.where("id is not null and code is not null").distinct(), "queries")
    n, ids = rows.agg(F.count("*"), F.count_distinct("id")).first()
    segments = segments_for(n)
    width = WIDTH // segments
    prefix_bits = min(MAX_PREFIX, width, max(0, int(np.ceil(np.log2(max(n, 1) / GROUP)))))

    def by_segment(codes: DataFrame, *more: str) -> DataFrame:
        cut = F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("s")
        value = F.expr(f"cast(shiftrightunsigned(code, s * {width}) & {(1 << width) - 1} as int)")
        return codes.select("code", *more, cut).withColumn("prefix", F.shiftright(value, width - prefix_bits))

    index = by_segment(rows, "id")
    # as many groups as segments and prefixes at most
    groups = stored(index.groupBy("s", "prefix").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "groups")
    index = index.join(F.broadcast(groups), ["s", "prefix"]).withColumn("block", F.pmod(F.xxhash64("code", "id"), F.col("blocks")).cast("int"))
    index = stored(index.select("s", "prefix", "block", F.lit(0).alias("kind"), "code", F.col("id").alias("x")), "index")
    active = asked.select("code", F.lit(WIDTH).cast("long").alias("limit")).distinct()
    best = spark.createDataFrame([], "code long, neighbor_id long, distance long")
    for r in range(0, width + 1, STEP):
        radii = range(r, min(r + STEP, width + 1))
        flips = [int(x) for d in range(min(prefix_bits, radii[-1]) + 1) if d >= radii[0] - (width - prefix_bits) for x in masks(prefix_bits, d)]
        flip = F.explode(F.split(F.lit(",".join(map(str, flips))), ",").cast("array<int>"))
        probes = by_segment(active, "limit").select("code", "limit", "s", "prefix", flip.alias("flip")).withColumn("prefix", F.col("prefix").bitwiseXOR(F.col("flip")))
        probes = probes.join(F.broadcast(groups), ["s", "prefix"]).select("s", "prefix", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "code", F.col("limit").alias("x"))
        met = index.unionByName(probes).repartition("s", "prefix", "block").sortWithinPartitions("s", "prefix", "block", "kind")
        found = met.mapInArrow(_search(segments, prefix_bits, radii, k + 1), "code long, neighbor_id long, distance long")
        near = found.unionByName(best).groupBy("code", "neighbor_id").agg(F.min("distance").alias("distance"))
        place = F.row_number().over(W.partitionBy("code").orderBy("distance", "neighbor_id"))
        best = stored(near.withColumn("place", place).where(F.col("place") <= k + 1).drop("place"), "best")
        told = best.groupBy("code").agg(F.count("*").alias("n"), F.max("distance").alias("last"))
        full = F.coalesce(F.col("n"), F.lit(0)) >= min(k + 1, ids)
        open_ = active.select("code").join(told, "code", "left").where(~(full & (F.col("last") <= segments * (radii[-1] + 1) - 1)))
        active = stored(open_.select("code", F.when(F.col("n") > k, F.col("last")).otherwise(F.lit(WIDTH)).cast("long").alias("limit")), "open")
        if active.isEmpty():
            break
    lists = best.groupBy("code").agg(F.collect_list(F.struct("neighbor_id", "distance")).alias("near"))  # k + 1 at most
    pairs = asked.join(lists, "code").select(F.col("id").alias("query_id"), F.explode("near").alias("x")).select("query_id", "x.neighbor_id", "x.distance").where("query_id != neighbor_id")
    pairs = pairs.groupBy("query_id", "neighbor_id").agg(F.min("distance").alias("distance"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "neighbor_id")).cast("long")
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code"))
    return top_k(codes, codes.where("id % 20 = 0"))


_SQL = f"""
with c as (select distinct vec_id id, array_to_string(list_transform(range(0, 64), lambda i: case when embedding[i + 1] > 0 then '1' else '0' end), '') code from embeddings where embedding is not null and vec_id is not null),
d as (select q.id query_id, c.id neighbor_id, min(hamming(q.code, c.code))::bigint distance from c q, c where q.id % 20 = 0 and q.id <> c.id group by 1, 2)
select query_id, row_number() over (partition by query_id order by distance, neighbor_id) as rank, neighbor_id, distance from d qualify rank <= {K}"""

QUERIES = {"op1_exact_top_k": op1_exact_top_k}
ORACLE_SQL = {"op1_exact_top_k": _SQL}
