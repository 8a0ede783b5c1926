"""Brown class-based bigram model: exchange clustering of words, class transitions and word emissions.

Counts cover every training text. Words are named by 64-bit hashes (two of n words share one with probability
n * n / 2**65). Every word seen LEARNED times or more gets one of CLASSES classes. The CLUSTERED most frequent ones
begin: one word at a time moves to the class with which the likelihood of the class bigrams is largest, against counts
that are always up to date, so the likelihood never falls; sweeps go on until no word moves or a sweep gains too
little. The driver does this on the bigrams of these words, a table whose size CLUSTERED bounds. Then every other word
joins the class that its own neighbours make likeliest, the classes of the first being held: each task adds up the
neighbouring classes of its words, and they meet in one shuffle by word. Transitions are counted anew with the classes
of all words. Words seen less often, down to never, have one of OPEN classes by their last two bytes: what is seen
once tells how often new words come. The end of a text has a class of its own, in which every text also begins.

  P(w | v) = P(class w | class v) * P(w | class w)
  P(c | d) = (N(d, c) + STRENGTH * (N(c) + 1) / (N + number of classes)) / (N(d) + STRENGTH)
  P(w | c) = (N(w) + 1) / (N(c) + V(c) + 1) in open classes, whose last part is for words never seen; N(w) / N(c) in others

Frequent words have their classes and scores from a table of bounded size that travels with the tasks. Rarer ones are
gathered in each text and meet the full table of counts and classes in a shuffle by word, so nothing that grows with
the corpus is broadcast and no frequent word is shuffled. The chains of classes that come of it are counted for the
transitions and scored with them.

Edge cases: a null, empty or wordless text is the end alone. Repeated rows are counted and scored each; rows with null
doc_id belong to the training part. Without training texts all counts are 0 and all scores come from the smoothing.
Ties between classes go to the first; a word without a neighbour of a learned class joins the first class. A very long
text is one row of words and places. Only doc_id and text are read, so further columns don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .counts import most_frequent
from .scratch import bounded_batches, give_back, stored

CLUSTERED, CLASSES, OPEN = 2048, 64, 32
LEARNED = 2  # times that a word is seen, at least, to have a learned class
FREQUENT = 1 << 17  # words whose counts and classes travel with the tasks
SWEEPS, LEAST_GAIN = 40, 1e-5  # sweeps at most, and the share of the likelihood that one must gain for another to follow
STRENGTH = 20.0
RARE = 255  # in a chain, the place of a word whose class isn't known yet
FLUSH = 400_000  # distinct words or bigrams that a task holds before it passes them on
NEAR = np.dtype([("c", "u1"), ("n", "<u4")])  # a neighbouring class, and how often
_LOWER = bytes(range(256)).lower()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


def name(word: bytes) -> int:
    """The word's hash as a signed 64-bit number."""
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def open_class(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word[-2:]) % OPEN


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash), n over docs; the end of a text isn't among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            return pa.record_batch({"word": pa.array(map(name, seen), pa.int64()), "n": pa.array(seen.values(), pa.int64())})

        for b in batches:
            for t in b.column("text").to_pylist():
                seen.update(words_of(t))
                if len(seen) > FLUSH:
                    yield told()
                    seen.clear()
        yield told()

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _bigrams(docs: DataFrame, ids: dict[int, int]) -> DataFrame:
    """(a, b, n): neighbours among the clustered words (by place), the open classes and the end (the last number)."""
    sent = docs.sparkSession.sparkContext.broadcast(ids)  # CLUSTERED entries
    others, end, size = CLUSTERED, CLUSTERED + OPEN, CLUSTERED + OPEN + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers(sent.value, others)
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        parts: list[np.ndarray] = []
        pending = 0
        for b in batches:
            for t in b.column("text").to_pylist():
                seq = np.fromiter(map(numbers.__getitem__, words_of(t)), np.int64)
                seq = np.concatenate([[end], seq, [end]])
                parts.append(seq[:-1] * size + seq[1:])
                pending += len(seq)
                if pending > 4_000_000:
                    keys, n = _summed(keys, n, parts)
                    pending = 0
                    if len(keys) > 4 * FLUSH:
                        yield pa.record_batch({"a": pa.array((keys // size).astype(np.int32)), "b": pa.array((keys % size).astype(np.int32)), "n": pa.array(n)})
                        keys, n = keys[:0], n[:0]
        keys, n = _summed(keys, n, parts)
        yield pa.record_batch({"a": pa.array((keys // size).astype(np.int32)), "b": pa.array((keys % size).astype(np.int32)), "n": pa.array(n)})

    return docs.select("text").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _summed(keys: np.ndarray, n: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return keys, n
    k, m = np.unique(np.concatenate(parts), return_counts=True)
    parts.clear()
    both, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
    return both, np.bincount(at, np.concatenate([n, m])).astype(np.int64)


class _Numbers(dict):
    """Word to its place among the clustered words, else others + its open class; remembers size words."""

    def __init__(self, ids: dict[int, int], others: int, size: int = 300_000) -> None:
        super().__init__()
        self.ids, self.others, self.size = ids, others, size

    def __missing__(self, word: bytes) -> int:
        out = self.ids.get(name(word))
        if out is None:
            out = self.others + open_class(word)
        if len(self) < self.size and len(word) < 64:
            self[word] = out
        return out


class _Slots(dict):
    """Word to its place among the frequent words, else their number + its open class; remembers size words."""

    def __init__(self, counts: dict[int, int], size: int = 400_000) -> None:
        super().__init__()
        self.places, self.size = {w: i for i, w in enumerate(counts)}, size

    def __missing__(self, word: bytes) -> int:
        out = self.places.get(name(word))
        if out is None:
            out = len(self.places) + open_class(word)
        if len(self) < self.size and len(word) < 64:
            self[word] = out
        return out


class _Local(dict):
    """Word to a number of its own; names, open classes and learned classes (-1 where ids lacks the word) by number."""

    def __init__(self, ids: dict[int, int]) -> None:
        super().__init__()
        self.ids = ids
        self.clear()

    def __missing__(self, word: bytes) -> int:
        h = name(word)
        self.names.append(h)
        self.kinds.append(open_class(word))
        self.classes.append(self.ids.get(h, -1))
        self[word] = out = len(self.names) - 1
        return out

    def clear(self) -> None:
        super().clear()
        self.names, self.kinds, self.classes = [], [], []


def _contexts(docs: DataFrame, ids: dict[int, int]) -> DataFrame:
    """word, kind, n, near of the words not in ids (hash to class): a row for each task and flush.

    near has the classes before (c) and after (CLASSES + 1 + c), the end being class CLASSES; neighbours that aren't
    in ids either say nothing.
    """
    sent = docs.sparkSession.sparkContext.broadcast(ids)  # CLUSTERED entries
    side = CLASSES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = _Local(sent.value)
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        times, known = np.zeros(0, np.int64), np.zeros(0, np.int64)  # by local number: how often, and the class
        parts: list[np.ndarray] = []
        pending = 0

        def told() -> pa.RecordBatch:
            own = np.flatnonzero(np.array(local.classes, np.int64) < 0)
            near = np.empty(len(keys), NEAR)
            near["c"], near["n"] = keys % (2 * side), n
            column = _binary(near, np.searchsorted(keys, (own + 1) * 2 * side))
            count = np.zeros(len(local.names), np.int64)
            count[: len(times)] = times
            return pa.record_batch({"word": pa.array(np.array(local.names, np.int64)[own]), "kind": pa.array(np.array(local.kinds, np.int32)[own]), "n": pa.array(count[own]), "near": column})

        for b in batches:
            seqs = [np.fromiter(map(local.__getitem__, words_of(t)), np.int64) for t in b.column("text").to_pylist()]
            seq = np.concatenate([x for s in seqs for x in (s, [-1])]) if seqs else np.zeros(0, np.int64)
            known = np.concatenate([known, np.array(local.classes[len(known) :], np.int64)])
            c = np.where(seq < 0, side - 1, known[seq] if len(known) else -1)
            at = np.flatnonzero(c < 0)
            word = seq[at]
            new = np.bincount(word, minlength=len(local.names))
            new[: len(times)] += times
            times = new
            before, after = c[at - 1], c[np.minimum(at + 1, len(c) - 1)]  # what stands before the first is the last end
            parts += [(word * (2 * side) + before)[before >= 0], (word * (2 * side) + side + after)[after >= 0]]
            pending += 2 * len(at)
            if pending > 2_000_000 or len(local) > FLUSH:
                keys, n = _summed(keys, n, parts)
                pending = 0
                if len(keys) > 4 * FLUSH or len(local) > FLUSH:
                    yield told()
                    keys, n, times, known = keys[:0], n[:0], times[:0], known[:0]
                    local.clear()
        keys, n = _summed(keys, n, parts)
        yield told()
        give_back()

    return docs.select("text").mapInArrow(run, "word long, kind int, n long, near binary")


def gains(trans: np.ndarray) -> np.ndarray:
    """For each neighbour as in _contexts and each learned class: what the neighbour tells for the class.

    trans: counts of pairs of classes, the last of which is the end. It is the log of how much likelier the neighbour
    is next to the class than anywhere, smoothed as transitions are.
    """
    keep = [*range(CLASSES), len(trans) - 1]
    size = trans.sum(axis=0) + 1
    prior = size / size.sum()
    follows = np.log((trans + STRENGTH * prior) / (trans.sum(axis=1, keepdims=True) + STRENGTH) / prior)
    return np.concatenate([follows[keep][:, :CLASSES], follows[:CLASSES][:, keep].T]).astype(np.float32)


def _joined(contexts: DataFrame, table: np.ndarray) -> DataFrame:
    """(word, n, class) of all words of contexts: the class that their neighbours tell for, or the open one."""
    sent = contexts.sparkSession.sparkContext.broadcast(table)  # bounded by the number of classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = sent.value
        held = None  # the last word: its rows may go on in the next batch

        def told(word: np.ndarray, kind: np.ndarray, n: np.ndarray, gain: np.ndarray) -> pa.RecordBatch:
            own = np.where(n >= LEARNED, gain.argmax(axis=1), CLASSES + kind)
            return pa.record_batch({"word": pa.array(word), "n": pa.array(n), "class": pa.array(own.astype(np.int32))})

        for b in batches:
            if not b.num_rows:
                continue
            word, kind, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("word", "kind", "n"))
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            owner = np.cumsum(np.concatenate([[0], (word[1:] != word[:-1]).astype(np.int64)]))
            word, kind, n = word[first], kind[first], np.add.reduceat(n, first)
            goes_on = held is not None and held[0][0] == word[0]
            # words seen too seldom need no class; the first and the last may be seen more often in other batches
            told_for = n >= LEARNED
            told_for[[0, -1]] = True
            raw = b.column("near").to_pylist()
            some = np.flatnonzero(told_for[owner]).tolist()
            sizes = np.array([len(raw[i]) // NEAR.itemsize for i in some], np.int64)
            flat = np.frombuffer(b"".join([raw[i] for i in some]), NEAR)
            whose = np.repeat(owner[some], sizes)
            gain = np.zeros((len(word), CLASSES))
            for lo in range(0, len(flat), 1 << 15):
                part, who = flat[lo : lo + (1 << 15)], whose[lo : lo + (1 << 15)]
                at = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
                gain[who[at]] += np.add.reduceat(values[part["c"]] * part["n"].astype(np.float32)[:, None], at, axis=0, dtype=np.float64)
            if goes_on:
                n[0] += held[2][0]
                gain[0] += held[3][0]
            elif held is not None:
                yield told(*held)
            yield told(word[:-1], kind[:-1], n[:-1], gain[:-1])
            held = word[-1:], kind[-1:], n[-1:], gain[-1:]
        if held is not None:
            yield told(*held)
        give_back()

    return contexts.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word long, n long, class int")


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(trans: np.ndarray) -> float:
    """The log likelihood of the class bigrams, but for what no exchange changes."""
    return float(_f(trans).sum() - _f(trans.sum(axis=1)).sum() - _f(trans.sum(axis=0)).sum())


def exchange(pairs: np.ndarray, classes: np.ndarray, movable: int, n_classes: int, n_all: int, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes by place, counts of pairs of classes, and the likelihood at the beginning and after each sweep.

    pairs[v, w]: how often place w follows place v. The first movable places move one at a time, each to the best of
    the first n_classes classes if that is better than its own; all others keep theirs.
    """
    classes = classes.copy()
    member = np.zeros((len(classes), n_all))
    member[np.arange(len(classes)), classes] = 1
    left, right = pairs.T @ member, pairs @ member  # how often a class stands before, after a place
    trans = member.T @ right
    told = [likelihood(trans)]
    for _ in range(sweeps):
        moved = 0
        for w in range(movable):
            now, own = classes[w], pairs[w, w]
            before, after = left[w].copy(), right[w].copy()
            before[now] -= own
            after[now] -= own
            if not own and not before.any() and not after.any():
                continue
            trans[:, now] -= before
            trans[now] -= after
            trans[now, now] -= own
            into, out = trans[:, :n_classes], trans[:n_classes]
            b, a = np.flatnonzero(before), np.flatnonzero(after)
            gain = (_f(into[b] + before[b, None]) - _f(into[b])).sum(axis=0) + (_f(out[:, a] + after[a]) - _f(out[:, a])).sum(axis=1)
            # the cell of a class with itself gets both, and the pairs of the word with itself
            self_now = np.diagonal(trans)[:n_classes]
            x, y = before[:n_classes], after[:n_classes]
            gain += _f(self_now + x + y + own) - _f(self_now + x) - _f(self_now + y) + _f(self_now)
            # totals: what stands after the word counts for its classes wherever the word goes
            for total, more in ((into.sum(axis=0) + y, before.sum() + own), (out.sum(axis=1) + x, after.sum() + own)):
                gain -= _f(total + more) - _f(total)
            best = int(gain.argmax())
            if gain[best] > gain[now] + 1e-7:
                moved += 1
                classes[w] = best
                left[:, now] -= pairs[w]
                left[:, best] += pairs[w]
                right[:, now] -= pairs[:, w]
                right[:, best] += pairs[:, w]
                before, after = left[w].copy(), right[w].copy()
                before[best] -= own
                after[best] -= own
            at = classes[w]
            trans[:, at] += before
            trans[at] += after
            trans[at, at] += own
        told.append(likelihood(trans))
        if not moved or told[-1] - told[-2] < LEAST_GAIN * abs(told[-1]):
            break
    return classes, trans, told


@dataclass
class ClassModel:
    """ids: hash to place of the clustered words; classes of places, open classes and the end; totals and tables.

    counts and class_of have the count and the class of the frequent words, clustered ones included.
    """

    ids: dict[int, int]
    classes: np.ndarray
    counts: dict[int, int]
    class_of: dict[int, int]
    transition: np.ndarray
    size: np.ndarray
    kinds: np.ndarray
    tokens: int
    distinct: int
    ends: int

    @property
    def base_floor(self) -> float:
        return float(self.tokens + self.distinct + 1)


def train(docs: DataFrame) -> tuple[ClassModel, DataFrame]:
    """The model of the training rows of docs, and the table (word, n, class) of their words."""
    model, counts = classed(docs)
    return with_transitions(model, chains(docs.where(~held_out(F.col("doc_id"))), model, counts)), counts


def classed(docs: DataFrame) -> tuple[ClassModel, DataFrame]:
    """As train, but for the transitions, which are left at 0."""
    bounded_batches(docs.sparkSession)
    learn = docs.where(~held_out(F.col("doc_id"))).select("text")
    counts = stored(word_counts(learn), "word-counts")
    ends = learn.count()
    begun = most_frequent(counts, "word", CLUSTERED)
    ids = {r["word"]: i for i, r in enumerate(begun)}
    size, n_all = CLUSTERED + OPEN + 1, CLASSES + OPEN + 1
    found = _bigrams(learn, ids).toArrow()  # the square of CLUSTERED and the open classes at most
    pairs = np.zeros((size, size))
    pairs[found["a"].to_numpy(), found["b"].to_numpy()] = found["n"].to_numpy()
    # words start in classes by frequency; open classes and the end keep theirs
    classes = np.concatenate([np.arange(CLUSTERED) % CLASSES, CLASSES + np.arange(OPEN + 1)]).astype(np.int64)
    classes, trans, _ = exchange(pairs, classes, len(ids), CLASSES, n_all)
    # all other words join the classes
    first = {w: int(classes[i]) for w, i in ids.items()}
    known = docs.sparkSession.createDataFrame([(r["word"], r["n"], first[r["word"]]) for r in begun], "word long, n long, class int")
    bounded_batches(docs.sparkSession, 20_000)  # rows of words are short
    counts = stored(_joined(_contexts(learn, first), gains(trans)).unionByName(known), "word-classes")
    bounded_batches(docs.sparkSession)
    # sizes and kinds of the classes
    size_of, kinds = np.zeros(n_all), np.zeros(n_all)
    for r in counts.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        size_of[r["class"]], kinds[r["class"]] = r["n"], r["v"]
    tokens, distinct = int(size_of.sum()), int(kinds.sum())
    size_of[-1], kinds[-1] = ends, bool(ends)
    rows = most_frequent(counts, "word", FREQUENT)
    known, class_of = {r["word"]: r["n"] for r in rows}, {r["word"]: r["class"] for r in rows}
    return ClassModel(ids, classes, known, class_of, np.zeros((n_all, n_all)), size_of, kinds, tokens + ends, distinct + bool(ends), ends), counts


def with_transitions(model: ClassModel, chained: DataFrame) -> ClassModel:
    """The model with the transitions that chains of training rows have."""
    n_all = len(model.size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(n_all * n_all, np.int64)
        for b in batches:
            for x in b.column("chain").to_pylist():
                c = np.frombuffer(x, np.uint8).astype(np.int64)
                n += np.bincount(c[:-1] * n_all + c[1:], minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.record_batch({"pair": pa.array(at), "n": pa.array(n[at])})

    rows = chained.select("chain").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    trans = np.zeros(n_all * n_all)
    for r in rows:
        trans[r["pair"]] = r["n"]
    trans = trans.reshape(n_all, n_all)
    prior = (model.size + 1) / (model.size.sum() + n_all)
    return replace(model, transition=np.log10((trans + STRENGTH * prior) / (trans.sum(axis=1, keepdims=True) + STRENGTH)))


def emission(model: ClassModel, n: np.ndarray, c: np.ndarray) -> np.ndarray:
    """log10 P(word | class) from the word's count."""
    free = (c >= CLASSES) & (c < CLASSES + OPEN)
    return np.log10(np.where(free, (n + 1) / (model.size[c] + model.kinds[c] + 1), np.maximum(n, 0.5) / np.maximum(model.size[c], 1)))


def score(docs: DataFrame, model: ClassModel, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    return scored(chains(docs, model, counts), model)


def chains(docs: DataFrame, model: ClassModel, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base, score (of the emissions), chain (a byte for each class, ends included), stored."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # bounded by FREQUENT words and the squares of the classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        floor, end = np.log10(m.base_floor), CLASSES + OPEN
        slots = _Slots(m.counts)
        # by slot: frequent words first, then the open classes of all others
        n = np.array([*m.counts.values(), *[0] * OPEN], np.float64)
        c = np.array([*(m.class_of[w] for w in m.counts), *range(CLASSES, CLASSES + OPEN)], np.int64)
        base_of, score_of, byte_of = np.log10(n + 1) - floor, emission(m, n, c), c.astype(np.uint8)
        first_other = len(m.counts)
        for b in batches:
            texts = [words_of(t) for t in b.column("text").to_pylist()]
            size = np.array([len(x) for x in texts], np.int64)
            words = [w for x in texts for w in x]
            texts.clear()
            slot = np.fromiter(map(slots.__getitem__, words), np.int64, len(words))
            text = np.repeat(np.arange(len(size)), size)
            rare = np.flatnonzero(slot >= first_other)
            known = np.ones(len(slot), bool)
            known[rare] = False
            base, emitted = (np.bincount(text[known], v[slot[known]], len(size)) for v in (base_of, score_of))
            # chains: an end, the words' classes, an end
            to = np.cumsum(size + 2)
            chain = np.full(int(to[-1]) if len(to) else 0, end, np.uint8)
            place = np.arange(len(slot)) + 2 * text + 1
            chain[place] = byte_of[slot]
            chain[place[rare]] = RARE
            # the rare words of each text, each once, and which of them stands at each RARE
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(words[i]) for i in rare.tolist()), np.uint64, len(rare)).view(np.int64)
            order = np.lexsort((hashes, text[rare]))
            own, whose = hashes[order], text[rare][order]
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (whose[1:] != whose[:-1])
            first = np.flatnonzero(new)
            ends = np.searchsorted(whose[first], np.arange(len(size) + 1)).astype(np.int32)
            nth = np.empty(len(own), "<u4")
            nth[order] = np.cumsum(new) - 1 - ends[whose]
            times = np.diff([*first, len(own)])
            lists = {"words": own[first], "times": times.astype(np.int32), "kinds": (slot[rare][order][first] - first_other).astype(np.int8)}
            yield pa.record_batch(
                {"doc_id": b.column("doc_id"), "n_tokens": pa.array(size + 1), "n_known": pa.array(np.bincount(text[known], minlength=len(size)) + int(m.ends > 0)), "base": pa.array(base + np.log10(m.ends + 1) - floor), "score": pa.array(emitted)}
                | {c: pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for c, v in lists.items()}
                | {"chain": _binary(chain, to), "places": _binary(nth, np.cumsum(np.bincount(text[rare], minlength=len(size))))}
            )
        give_back()

    schema = "doc_id long, n_tokens long, n_known long, base double, score double, words array<bigint>, times array<int>, kinds array<tinyint>, chain binary, places binary"
    told = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema).withColumn("uid", F.monotonically_increasing_id())
    told = stored(told, "scored")
    # the rare words of each text meet the counts; an unseen word has none and its open class
    rare = told.select("uid", F.posexplode(F.arrays_zip("words", "times", "kinds")).alias("place", "r"))
    rare = rare.select("uid", "place", F.col("r.words").alias("word"), F.col("r.times").alias("k"), (CLASSES + F.col("r.kinds")).cast("int").alias("kind"))
    met = rare.join(counts, "word", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "class": F.coalesce("class", "kind")})

    def table(values: np.ndarray) -> Column:
        return F.get(F.split(F.lit(",".join(repr(float(x)) for x in values)), ",").cast("array<double>"), F.col("class"))

    opened = F.col("class") >= CLASSES
    below = np.log10(np.where(np.arange(len(model.size)) >= CLASSES, model.size + model.kinds + 1, np.maximum(model.size, 1)))
    sums = met.groupBy("uid").agg(
        F.sum(F.col("k") * (F.log10(F.col("n") + 1) - F.lit(float(np.log10(model.base_floor))))).alias("more_base"), F.sum(F.col("k") * (F.log10(F.col("n") + F.when(opened, 1).otherwise(0)) - table(below))).alias("more_score"), F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("more_known"), F.array_sort(F.collect_list(F.struct("place", "class"))).alias("met")
    )
    whole = told.drop("words", "times", "kinds").join(sums, "uid", "left")
    plus = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
    chain = F.arrow_udf(_filled, "binary")("chain", "places", F.transform("met", lambda x: x["class"])).alias("chain")
    return stored(whole.select("doc_id", "n_tokens", plus("n_known", "more_known"), plus("base", "more_base"), plus("score", "more_score"), chain), "chains")


def _binary(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The parts of flat that end at ends, as binary values."""
    offsets = np.concatenate([[0], ends]).astype(np.int32) * np.int32(flat.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())])


def _filled(chains: pa.Array, places: pa.Array, classes: pa.Array) -> pa.Array:
    """Chains with the classes of their rare words, which places tells by order."""
    out = []
    for x, p, c in zip(chains.to_pylist(), places.to_pylist(), classes.to_pylist(), strict=True):
        if c:
            chain = np.frombuffer(x, np.uint8).copy()
            chain[chain == RARE] = np.array(c, np.uint8)[np.frombuffer(p, "<u4")]
            x = chain.tobytes()
        out.append(x)
    return pa.array(out, pa.binary())


def scored(chained: DataFrame, model: ClassModel) -> DataFrame:
    """What score gives, from the chains."""

    def run(chains: pa.Array) -> pa.Array:
        flat = model.transition.ravel()
        out = []
        for x in chains.to_pylist():
            c = np.frombuffer(x, np.uint8).astype(np.int64)
            out.append(float(flat[c[:-1] * len(model.size) + c[1:]].sum()))
        return pa.array(out, pa.float64())

    score = F.col("score") + F.arrow_udf(run, "double")("chain")
    return chained.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), score.alias("score"))


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model, counts = classed(docs)
    chained = chains(docs, model, counts)
    return scored(chained, with_transitions(model, chained.where(~held_out(F.col("doc_id")))))


QUERIES = {"op6_class_lm": op6_class_lm}
ORACLE_SQL: dict[str, str] = {}
