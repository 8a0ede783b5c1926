"""Rank-ordered encoding with a learned merge table, and token ids."""

from __future__ import annotations

from array import array
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import MARK
from ..llm.scratch import bounded_batches

UNKNOWN = MARK + "<unk>"


def ranks_of(merges: Sequence[tuple[str, str]]) -> dict[tuple[str, str], int]:
    """Of a pair that was merged twice the last rank counts."""
    return {pair: i for i, pair in enumerate(merges)}


def encode_word(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Merge all places of the lowest-ranked neighbours, from the left, until none is ranked."""
    toks = list(word)
    while len(toks) > 1:
        best = min((ranks.get(p, -1) for p in zip(toks, toks[1:], strict=False) if p in ranks), default=None)
        if best is None:
            break
        out, i = [], 0
        while i < len(toks):
            if i + 1 < len(toks) and ranks.get((toks[i], toks[i + 1])) == best:
                out.append(toks[i] + toks[i + 1])
                i += 2
            else:
                out.append(toks[i])
                i += 1
        toks = out
    return toks


def encode_words(words: DataFrame, merges: Sequence[tuple[str, str]], first: int | None = None) -> DataFrame:
    """words (word, ...) with toks. Give it distinct words: each is encoded once, in Arrow batches.

    The merge table is bounded by the vocabulary's size; first keeps only so many merges.
    """
    sent = words.sparkSession.sparkContext.broadcast(ranks_of(merges[:first]))

    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if w is None else encode_word(w, sent.value) for w in column.to_pylist()], pa.list_(pa.string()))

    return words.withColumn("toks", F.arrow_udf(run, "array<string>")("word"))


def token_ids(encoded: DataFrame, vocab: DataFrame) -> DataFrame:
    """word, pos, id of encoded words (word, toks): a piece's id in vocab (token, id), else that of the unknown token if there is
    one, else those of its known characters; pos counts what remains.

    vocab is collected, as its size is bounded; ids are looked up where the words lie, so nothing is shuffled or sorted.
    """
    spark = encoded.sparkSession
    sent = spark.sparkContext.broadcast({r["token"]: r["id"] for r in vocab.select("token", "id").collect()})

    def run(column: pa.Array) -> pa.Array:
        known = sent.value
        return pa.array([None if toks is None else ids_of(toks, known) for toks in column.to_pylist()], pa.list_(pa.int64()))

    ids = encoded.select("word", F.posexplode(F.arrow_udf(run, "array<long>")("toks")).alias("pos", "id"))
    return ids.select("word", F.col("pos").cast("long").alias("pos"), F.col("id").cast(vocab.schema["id"].dataType).alias("id"))


def ids_of(toks: Sequence[str], known: dict[str, int]) -> list[int]:
    unknown, out = known.get(UNKNOWN), []
    for token in toks:
        i = known.get(token, unknown)
        out += [i] if i is not None else [known[c] for c in token if c in known]
    return out


MEMO_BYTES = 48_000_000  # of the words that a worker remembers, and their ids
ENTRY = 200  # bytes of an entry beside its characters and ids


class TextEncoder:
    """ids of texts, as token_ids has them; merges and vocabulary are bounded by the vocabulary's size."""

    def __init__(self, merges: Sequence[tuple[str, str]], vocab: dict[str, int]) -> None:
        self.ranks, self.vocab, self.memo, self.room = ranks_of(merges), vocab, {}, MEMO_BYTES

    def of_word(self, word: str) -> list[int]:
        """Of a word without its mark."""
        return ids_of(encode_word(MARK + word, self.ranks), self.vocab)

    def packed(self, text: str) -> bytes:
        """The ids as 32-bit integers. Frequent words are remembered so too: as lists they took several times as much."""
        out: list[bytes] = []
        for word in text.split():
            ids = self.memo.get(word)
            if ids is None:
                ids = array("i", self.of_word(word)).tobytes()
                if self.room > 0 and len(word) < 64:
                    self.memo[word] = ids
                    self.room -= ENTRY + 4 * len(word) + len(ids)
            out.append(ids)
        return b"".join(out)

    def of_text(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()


def encode_documents(docs: DataFrame, merges: Sequence[tuple[str, str]], vocab: DataFrame, lower: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (in order) of every text. vocab: token, id; it is collected, as its size is bounded.

    Texts are encoded where they lie, in Arrow batches: nothing is shuffled, and a worker encodes a frequent word once.
    Batches and the memo are bounded in bytes, so a worker holds the same however many texts there are.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast((list(merges), {r["token"]: r["id"] for r in vocab.select("token", "id").collect()}))
    made: list[TextEncoder] = []

    def run(column: pa.Array) -> pa.Array:
        if not made:  # one for each worker
            made.append(TextEncoder(*sent.value))
        found = [made[0].packed(t.as_py() or "") for t in column]
        ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32)))

    text = F.lower("text") if lower else F.col("text")
    coded = docs.select("doc_id", F.arrow_udf(run, "array<int>")(text).alias("ids"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")
