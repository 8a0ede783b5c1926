"""BPE through a minimal acyclic transducer of the corpus's frequent words.

The words (pre-tokens) of all whole texts are counted; the ``WORDS`` most frequent are encoded by the tokenizer's own
model and compiled into a minimal acyclic automaton: equal suffixes share states, and each arc carries how many words
lie before it, so that the sum along a path is the word's number, under which its ids are found. The automaton is laid
out in a few flat arrays (states overlap in one table of arcs) that workers map into memory from a file without a name.
Words that it lacks are merged by the tokenizer's model, which is exact; short ones are remembered up to a bound.

Edge cases: null and empty texts have no ids and decode to the empty text. Texts of any script and texts with the
vocabulary's added tokens come through the lexicon too: ``tokens`` tells how they are cut. Very long texts are coded
whole; an Arrow batch then holds that text alone. The file of the mapping lies in the worker's own temporary folder and
is made anew by any worker that needs it, so nothing is lost with an executor. Repeated rows are encoded each; an empty table compiles an empty automaton. Other columns of the documents are kept.
"""

from __future__ import annotations

import mmap
import struct
import tempfile
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .counts import most_frequent
from .scratch import bounded_batches, stored
from .tokens import Encoder, encoder, vocabulary

WORDS = 1 << 16
FLUSH = 400_000  # distinct units that a task counts before it passes their words on
_NONE = 0xFFFFFFFF


class _State:
    __slots__ = ("arcs", "final", "number")

    def __init__(self) -> None:
        self.arcs: dict[int, _State] = {}
        self.final = False
        self.number = -1

    def key(self) -> tuple:
        return self.final, tuple((b, id(s)) for b, s in self.arcs.items())


def minimal_automaton(words: Iterable[bytes]) -> _State:
    """Of distinct words in ascending order; a state is replaced by its equal as soon as its subtree is complete."""
    root, known, path, last = _State(), {}, [], b""
    path = [root]
    for word in words:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        _merge(path, same, known, last)
        for b in word[same:]:
            state = _State()
            path[-1].arcs[b] = state
            path.append(state)
        path[-1].final = True
        last = word
    _merge(path, 0, known, last)
    return root


def _merge(path: list[_State], to: int, known: dict, word: bytes) -> None:
    while len(path) > to + 1:
        state = path.pop()
        path[-1].arcs[word[len(path) - 1]] = known.setdefault(state.key(), state)


def compile_lexicon(entries: dict[bytes, bytes]) -> bytes:
    """words and their ids (little-endian 32-bit) to one block of memory.

    Layout: counts of arc slots, states and words; then 32-bit arrays base[state], final[state], owner[slot],
    target[slot], before[slot], start[word + 1] (in ids) and the ids.
    """
    words = sorted(entries)
    root = minimal_automaton(words)
    states, below = [root], {}
    root.number = 0
    for state in states:  # grows
        for to in state.arcs.values():
            if to.number < 0:
                to.number = len(states)
                states.append(to)

    def size(state: _State) -> int:
        stack = [state]
        while stack:
            x = stack[-1]
            todo = [y for y in x.arcs.values() if y.number not in below]
            if todo:
                stack.extend(todo)
            else:
                below[x.number] = x.final + sum(below[y.number] for y in x.arcs.values())
                stack.pop()
        return below[state.number]

    size(root)
    base, taken, next_fit = [0] * len(states), set(), Counter()
    for state in sorted(states, key=lambda s: -len(s.arcs)):
        if state.arcs:
            labels = list(state.arcs)
            first = next_fit[len(labels)]  # states with as many arcs didn't fit before
            while first in taken or any(first - labels[0] + b in taken for b in labels) or first < labels[0]:
                first += 1
            next_fit[len(labels)] = first + 1
            at = base[state.number] = first - labels[0]
            taken.update(at + b for b in labels)
    slots = max(taken, default=0) + 257
    owner, target, before = (array("I", [_NONE]) * slots for _ in range(3))
    for state in states:
        n = int(state.final)
        for b, to in state.arcs.items():
            i = base[state.number] + b
            owner[i], target[i], before[i] = state.number, to.number, n
            n += below[to.number]
    starts, ids = array("I", [0]), b"".join(entries[w] for w in words)
    for w in words:
        starts.append(starts[-1] + len(entries[w]) // 4)
    return struct.pack("<3I", slots, len(states), len(words)) + b"".join(x.tobytes() for x in (array("I", base), array("I", [s.final for s in states]), owner, target, before, starts)) + ids


class Lexicon:
    """The compiled block, mapped into memory."""

    def __init__(self, block: bytes) -> None:
        with tempfile.TemporaryFile() as f:
            f.write(block)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        slots, states, words = struct.unpack("<3I", self.map[:12])
        view, at = memoryview(self.map)[12:].cast("I"), 0
        parts = []
        for n in (states, states, slots, slots, slots, words + 1):
            parts.append(view[at : at + n])
            at += n
        self.base, self.final, self.owner, self.target, self.before, self.starts = parts
        self.ids = view[at:]

    def find(self, word: bytes) -> bytes | None:
        """The word's ids, or None if it isn't in the lexicon."""
        base, owner, target, before = self.base, self.owner, self.target, self.before
        state = number = 0
        for b in word:
            i = base[state] + b
            if owner[i] != state:
                return None
            number += before[i]
            state = target[i]
        return self.ids[self.starts[number] : self.starts[number + 1]].tobytes() if self.final[state] else None


class LexiconEncoder(Encoder):
    """An Encoder that asks the lexicon first."""

    def __init__(self, path: str, block: bytes) -> None:
        super().__init__(path)
        self.lexicon = Lexicon(block)

    def of_word(self, word: str) -> bytes:
        found = self.lexicon.find(word.encode())
        return super().of_word(word) if found is None else found


def frequent_words(docs: DataFrame, path: str, k: int = WORDS) -> list[str]:
    """The k most frequent pre-tokens of all texts, ties in code-point order; k bounds what reaches the driver.

    For vocabularies that drop white space and case.
    """
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(path), Counter()

        def told() -> pa.RecordBatch:
            words: Counter[str] = Counter()
            for unit, n in seen.items():
                for word in enc.pre_tokens(unit):
                    words[word] += n
            return pa.record_batch({"word": pa.array(words.keys(), pa.string()), "n": pa.array(words.values(), pa.int64())})

        for b in batches:
            for text in b.column(0).to_pylist():
                for part in enc.without_added(text or ""):
                    seen.update(enc.units(part))
                if len(seen) > FLUSH:
                    yield told()
                    seen.clear()
        yield told()

    counts = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in most_frequent(stored(counts, "pre-token-counts"), "word", k)]


def build_lexicon(docs: DataFrame, path: str, k: int = WORDS) -> bytes:
    enc = encoder(path)
    return compile_lexicon({w.encode(): enc.of_word(w) for w in frequent_words(docs, path, k)})


@cache
def _worker_encoder(path: str, key: int, block: object) -> LexiconEncoder:
    return LexiconEncoder(path, block.value)


def encode_documents(docs: DataFrame, path: str, block: bytes) -> DataFrame:
    """docs with ids (binary, little-endian 32-bit) and decoded (the text that decoding them gives)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(block)  # bounded by the number of words in the lexicon

    def code(texts: pa.Array) -> pa.Array:
        enc = _worker_encoder(path, id(sent), sent)
        ids = [enc.encode(t) for t in texts.to_pylist()]
        back = [enc.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(back, pa.string())], ["ids", "decoded"])

    return docs.withColumn("_coded", F.arrow_udf(code, "struct<ids:binary,decoded:string>")("text")).withColumns({"ids": F.col("_coded")["ids"], "decoded": F.col("_coded")["decoded"]}).drop("_coded")


def op9_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = vocabulary("word_bpe_49k.json")
    coded = encode_documents(docs, path, build_lexicon(docs, path))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op9_bpe_lexicon": op9_bpe_lexicon}
ORACLE_SQL: dict[str, str] = {}
