"""Segmented words in blocks of numbers: batches of merges and weighted bigrams without a row for each word.

A symbol is its code point; merged tokens are numbered from MERGED on. A block holds words in order of their first
place, so that the first occurrence of a pair in it is the first one in the texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import stored_at

MERGED = 0x110000
BLOCK = 1 << 21  # symbols in a block, about
NO_DOC = -(1 << 63)  # stands for a null first_doc, which comes first

PARTS = {"ids": np.int32, "n": np.int32, "cnt": np.int64, "doc": np.int64, "pos": np.int32}
#: A pair in a block: its numbers, weight and first place.
PAIR = np.dtype([("a", np.int32), ("b", np.int32), ("w", np.int64), ("fd", np.int64), ("fp", np.int32), ("fa", np.int32)])
SHARES = 32  # in which pairs are dealt to those who add them up
SCHEMA = ", ".join(f"{c} binary" for c in PARTS) + ", share int, pairs binary"
_SCHEMA = pa.schema([(c, pa.binary()) for c in PARTS] + [("share", pa.int32()), ("pairs", pa.binary())])

Block = dict[str, np.ndarray]
Merge = tuple[int, int, int]  # a, b and what they become


def block_of(words: list[str], cnt: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> Block:
    """Of words of one symbol or more."""
    order = np.lexsort((pos, doc))
    text = "".join([words[i] for i in order])
    n = np.fromiter(map(len, words), np.int32, len(words))[order]
    return {"ids": np.frombuffer(text.encode("utf-32-le"), np.int32), "n": n, "cnt": cnt[order], "doc": doc[order], "pos": pos[order]}


def merged_block(block: Block, merges: Sequence[Merge]) -> Block:
    """After one pass from the left in which all merges are made at once; no two of them share a symbol."""
    ids, n = block["ids"], block["n"]
    if len(ids) < 2 or not merges:
        return block
    size = max(int(ids.max()), *(a for a, _, _ in merges)) + 1
    partner, made = np.full(size, -1, np.int32), np.zeros(size, np.int32)
    for a, b, new in merges:
        partner[a], made[a] = b, new
    ends = np.cumsum(n)
    hit = partner[ids[:-1]] == ids[1:]
    hit[ends[:-1] - 1] = False
    own = np.flatnonzero(hit & (ids[:-1] == ids[1:]))
    if len(own):  # of a run of one symbol every other place
        starts = np.diff(own, prepend=-2) != 1
        hit[own[(own - own[starts][np.cumsum(starts) - 1]) % 2 == 1]] = False
    at = np.flatnonzero(hit)
    ids, keep = ids.copy(), np.ones(len(ids), bool)
    ids[at] = made[ids[at]]
    keep[at + 1] = False
    n = n - np.bincount(np.searchsorted(ends, at, "right"), minlength=len(n)).astype(np.int32)
    return block | {"ids": ids[keep], "n": n}


def _groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal pairs lie together, stable, and where each begins. Small numbers are sorted by counting."""
    seen = np.zeros(max(int(a.max()), int(b.max())) + 1, bool)
    seen[a] = seen[b] = True
    few = (np.cumsum(seen) - 1).astype(np.uint16 if seen.sum() < 1 << 16 else np.int32)
    a, b = few[a], few[b]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    return order, np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))


def pair_counts(block: Block) -> np.ndarray:
    """The distinct neighbours in words that count."""
    ids, n, cnt = block["ids"], block["n"], block["cnt"]
    ends = np.cumsum(n)
    fine = np.repeat(cnt > 0, n)
    fine[ends - 1] = False
    at = np.flatnonzero(fine)
    if not len(at):
        return np.zeros(0, PAIR)
    order, starts = _groups(ids[at], ids[at + 1])
    out = np.empty(len(starts), PAIR)
    first = at[order[starts]]
    word = np.searchsorted(ends, first, "right")
    out["a"], out["b"], out["w"] = ids[first], ids[first + 1], np.add.reduceat(np.repeat(cnt, n)[at[order]], starts)
    out["fd"], out["fp"], out["fa"] = block["doc"][word], block["pos"][word], first - (ends[word] - n[word])
    return out


def added_up(pairs: np.ndarray) -> np.ndarray:
    """Each pair once, with the sum of its weights and the least of its first places."""
    if not len(pairs):
        return pairs
    order, starts = _groups(pairs["a"], pairs["b"])
    pairs = pairs[order]
    out, size = pairs[starts], np.diff(starts, append=len(pairs))
    out["w"] = np.add.reduceat(pairs["w"], starts)
    least = np.ones(len(pairs), bool)
    for c in ("fd", "fp", "fa"):
        out[c] = np.minimum.reduceat(np.where(least, pairs[c], np.iinfo(PAIR[c]).max), starts)
        least &= pairs[c] == np.repeat(out[c], size)
    return out


def _told(block: Block, symbols: bool) -> Iterator[pa.RecordBatch]:
    """The block as a row, its pairs by share, and if wanted its symbols as share -1."""

    def batch(n: int, /, **columns: pa.Array) -> pa.RecordBatch:
        return pa.record_batch([columns.get(f.name, pa.nulls(n, f.type)) for f in _SCHEMA], schema=_SCHEMA)

    yield batch(1, **{c: pa.array([block[c].astype(k, copy=False).tobytes()], pa.binary()) for c, k in PARTS.items()})
    found = pair_counts(block)
    share = ((found["a"].astype(np.uint32) * np.uint32(0x9E3779B1) + found["b"].astype(np.uint32) * np.uint32(0x85EBCA6B)) >> np.uint32(16)) % np.uint32(SHARES)
    order = np.argsort(share.astype(np.uint8), kind="stable")
    ends = np.cumsum(np.bincount(share, minlength=SHARES))
    own = np.split(found[order], ends[:-1])
    yield batch(SHARES, share=pa.array(range(SHARES), pa.int32()), pairs=pa.array([x.tobytes() for x in own], pa.binary()))
    if symbols:
        yield batch(1, share=pa.array([-1], pa.int32()), pairs=pa.array([np.unique(block["ids"]).astype(np.int32).tobytes()], pa.binary()))


def _blocks(batch: pa.RecordBatch) -> Iterator[Block]:
    for i in range(batch.num_rows):
        yield {c: np.frombuffer(batch.column(c)[i].as_buffer(), k) for c, k in PARTS.items()}


def first_segments(words: DataFrame, path: str) -> DataFrame:
    """words (word, cnt, first_doc long, first_pos) as blocks of their code points with the pairs of these, written to path.

    Null and empty words, which have no symbols, are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def block() -> Block:
            t = pa.Table.from_batches(held)
            return block_of(t["word"].to_pylist(), *(t[c].to_numpy().astype(k) for c, k in (("cnt", np.int64), ("doc", np.int64), ("pos", np.int32))))

        for b in batches:
            held.append(b)
            size += pc.sum(pc.utf8_length(b.column("word"))).as_py() or 0
            if size >= BLOCK:
                yield from _told(block(), True)
                held.clear()
                size = 0
        if size:
            yield from _told(block(), True)

    rows = words.where("word != ''").select("word", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"), F.coalesce(F.col("first_doc").cast("long"), F.lit(NO_DOC)).alias("doc"), F.coalesce(F.col("first_pos").cast("int"), F.lit(-1)).alias("pos"))
    return stored_at(rows.mapInArrow(run, SCHEMA), path)


def next_segments(segments: DataFrame, merges: Sequence[Merge], path: str) -> DataFrame:
    """segments after a batch of merges, with the pairs that they have then, written to path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in _blocks(b):
                yield from _told(merged_block(block, merges), False)

    return stored_at(segments.where("ids is not null").select(*PARTS).mapInArrow(run, SCHEMA), path)


def symbols(segments: DataFrame) -> list[int]:
    """The distinct symbols of first_segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({"a": pa.array(np.unique(np.frombuffer(b"".join(b.column("pairs").to_pylist()), np.int32)))})

    return [r[0] for r in segments.where("share = -1").select("pairs").mapInArrow(run, "a int").distinct().collect()]


def segment_pairs(segments: DataFrame) -> DataFrame:
    """a, b (numbers), n and first_seen, as bigram_counts has them. Pairs are shuffled in arrays, not as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = added_up(np.frombuffer(b"".join(x for b in batches for x in b.column("pairs").to_pylist()), PAIR))
        for i in range(0, len(found), 1 << 16):
            own = {c: pa.array(np.ascontiguousarray(found[c][i : i + (1 << 16)])) for c in PAIR.names}
            seen = pa.StructArray.from_arrays([own["fd"], own["fp"], own["fa"]], ["first_doc", "first_pos", "at"])
            yield pa.record_batch({"a": own["a"], "b": own["b"], "n": own["w"], "first_seen": seen})

    tasks = min(SHARES, segments.sparkSession.sparkContext.defaultParallelism)
    dealt = segments.where("share >= 0").select("share", "pairs").repartition(tasks, "share").select("pairs")
    return dealt.mapInArrow(run, "a int, b int, n long, first_seen struct<first_doc: long, first_pos: int, at: int>")


def segmented_words(segments: DataFrame, names: dict[int, str]) -> DataFrame:
    """word, cnt, first_doc, first_pos, toks; names tells the merged tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _blocks(batch):
                known = {int(i): names.get(int(i)) or chr(i) for i in np.unique(b["ids"])}
                ends = np.cumsum(b["n"])
                for i in range(0, len(ends), 10_000):
                    own = slice(i, i + 10_000)
                    lo = int(ends[i] - b["n"][i])
                    toks = [known[x] for x in b["ids"][lo : ends[own][-1]].tolist()]
                    cuts = np.concatenate([[0], ends[own] - lo]).tolist()
                    yield pa.record_batch(
                        {
                            "word": pa.array(["".join(toks[x:y]) for x, y in zip(cuts, cuts[1:])], pa.string()),
                            "cnt": pa.array(b["cnt"][own]),
                            "first_doc": pa.array(b["doc"][own], mask=b["doc"][own] == NO_DOC),
                            "first_pos": pa.array(b["pos"][own]),
                            "toks": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(toks, pa.string())),
                        }
                    )

    return segments.where("ids is not null").select(*PARTS).mapInArrow(run, "word string, cnt long, first_doc long, first_pos int, toks array<string>")
