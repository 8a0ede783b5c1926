"""Applying a batch of merges, and the training loop over batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.measures import token_domain
from ..plans.lineage import drop, new_path, stored_at
from .bigrams import association, edge_weights
from .scoring import Pick, conflict_free, score
from .segments import MERGED, first_segments, next_segments, segment_pairs, segmented_words, symbols
from .spectral import auto_sigma, coordinates

MAX_BATCHES = 10_000
LOG = "step int, a string, b string, new_token string, score double, batch_id int, is_cross_boundary boolean, z_dist double"


#: Marks around tokens, and around tokens just made. They are white space, so no word holds them.
OPEN, CLOSE, NEW_OPEN, NEW_CLOSE = "\x1c", "\x1d", "\x1e", "\x1f"


def merged(toks: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """toks after one pass from the left in which all pairs are merged at once; a new token isn't looked at again.

    The pairs share no symbol, so their order doesn't matter: each is a replacement in the joined tokens, which Arrow's
    kernels do for whole columns. As nested expressions each batch would be compiled anew, to a method too long to be
    optimised (2.8 s a batch, with a fold 3.8 s, on 94,000 words).
    """
    steps = [(OPEN + a + CLOSE + OPEN + b + CLOSE, NEW_OPEN + a + b + NEW_CLOSE) for a, b in pairs]

    def run(column: pa.Array) -> pa.Array:
        for old, new in steps:
            column = pc.replace_substring(column, old, new)
        return column

    s = F.concat(F.lit(OPEN), F.array_join(toks, CLOSE + OPEN), F.lit(CLOSE))
    s = F.translate(F.arrow_udf(run, "string")(s), NEW_OPEN + NEW_CLOSE, OPEN + CLOSE)
    return F.when(F.size(toks) > 0, F.split(F.substring(s, F.lit(2), F.length(s) - 2), CLOSE + OPEN)).otherwise(toks)


def apply_batch(words: DataFrame, picks: Sequence[Pick]) -> DataFrame:
    """words with toks rewritten."""
    if not picks:
        return words
    return words.withColumn("toks", merged(F.col("toks"), [(p.a, p.b) for p in picks]))


@dataclass(frozen=True)
class TrainConfig:
    """alpha discounts counts, sigma <= 0 estimates it, shuffle_seed deals the control's coordinates."""

    method: str = "freq"
    vocab_size: int = 4000
    batch_size: int = 50
    tau: int = 2
    alpha: float = 0.0
    sigma: float = 0.2
    sigma_mult: float = 1.0
    gamma: float = 1.0
    recompute_every: int = 1
    shuffle_seed: int = 0
    log_z: bool = False
    stem_chars: str | None = None
    suffix_chars: str | None = None
    max_batches: int = MAX_BATCHES


@dataclass
class Trained:
    """merges in order, the log, the vocabulary and the first embedding; words as segmented at the end."""

    method: str
    merges: list[tuple[str, str]]
    log: DataFrame
    vocab: list[str]
    words: DataFrame
    z_snapshot: DataFrame | None = None
    sigma: float | None = None
    config: TrainConfig = field(default_factory=TrainConfig)

    @property
    def spark(self) -> SparkSession:
        return self.words.sparkSession

    def merge_table(self) -> DataFrame:
        """rank, a, b, new_token."""
        return self.spark.createDataFrame([(i, a, b, a + b) for i, (a, b) in enumerate(self.merges)], "rank int, a string, b string, new_token string")

    def vocab_table(self) -> DataFrame:
        """token, id."""
        return self.spark.createDataFrame([(t, i) for i, t in enumerate(sorted(self.vocab))], "token string, id int")

    def save(self, path: str) -> None:
        """As tables in a folder; the configuration as one row."""
        self.merge_table().write.parquet(f"{path}/merges")
        self.vocab_table().write.parquet(f"{path}/vocab")
        self.log.write.parquet(f"{path}/log")
        if self.z_snapshot is not None:
            self.z_snapshot.write.parquet(f"{path}/z_snapshot")
        self.spark.createDataFrame([(self.method, self.sigma, repr(self.config))], "method string, sigma double, config string").write.parquet(f"{path}/model")


def _counted(pairs: DataFrame) -> DataFrame:
    """pairs with their marginals, which the vocabulary's size bounds: they go through the driver, as joins would sort the pairs."""
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("id"), "n"), F.struct(F.lit(1).alias("side"), F.col("b").alias("id"), "n")))
    sums = pairs.select(sides.alias("s")).groupBy("s.side", "s.id").agg(F.sum("s.n").alias("n")).collect()
    out = pairs.withColumn("z", F.lit(sum(r["n"] for r in sums if r["side"] == 0)).cast("long"))
    for side, (c, name) in enumerate((("a", "n_first"), ("b", "n_second"))):
        own = [r for r in sums if r["side"] == side]
        table = pa.table({c: pa.array([r["id"] for r in own], pa.int32()), name: pa.array([r["n"] for r in own], pa.int64())})
        out = out.join(F.broadcast(pairs.sparkSession.createDataFrame(table)), c)
    return out


def _solved(edges: DataFrame, order: Sequence[int]) -> np.ndarray:
    """Coordinates of the symbols in order from edges (a, b, w), worked out in one task, as the graph has a vocabulary's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches), pa.schema([("a", pa.int32()), ("b", pa.int32()), ("w", pa.float64())]))
        place = np.zeros(max(order) + 1, np.int64)
        place[order] = range(len(order))
        a, b, w = place[t["a"].to_numpy()], place[t["b"].to_numpy()], t["w"].to_numpy()
        i, j, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
        by = np.lexsort((w, j, i))
        i, j, w = i[by], j[by], w[by]
        starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(i)), bool), (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        w = np.add.reduceat(w, starts) if len(starts) else w
        yield pa.record_batch({"z": pa.array([coordinates(len(order), i[starts], j[starts], w).tobytes()], pa.binary())})

    return np.frombuffer(edges.coalesce(1).mapInArrow(run, "z binary").first()["z"], np.float32)


def train(words: DataFrame, config: TrainConfig = TrainConfig()) -> Trained:
    """Learn merges in batches from word counts (word, cnt, first_doc, first_pos).

    Words are blocks of numbers (see ``segments``). One job a batch merges and counts neighbours by the block, so a
    batch costs some passes over arrays and not a row for each word and symbol. Blocks are written after each batch, and
    those before dropped, as are the tables of a batch: the disk that it takes doesn't grow with the batches. The
    driver holds what the vocabulary's size bounds.
    """
    c, spark = config, words.sparkSession
    if c.method != "freq" and not c.batch_size:
        raise ValueError("batch_size must be positive")
    place = new_path(spark, "words")
    # A file a task from here on, as many as the words need and not as the setting of shuffle partitions says: no batch shuffles words again.
    now = first_segments(words.repartition("word"), place)
    names = {i: chr(i) for i in symbols(now)}
    numbers = {t: i for i, t in names.items()}
    merges: list[tuple[str, str]] = []
    rows: list[tuple] = []
    z = coordinate = snapshot = sigma = None
    at: dict[str, np.float32] = {}
    needs_z = c.method.startswith("spectral") or c.log_z
    z_size, batch = -1, 0
    while len(numbers) < c.vocab_size and batch < min(c.max_batches, MAX_BATCHES):
        used = [place]
        pairs, associated = segment_pairs(now), None
        if c.method != "freq" or c.log_z:
            used.append(new_path(spark, "pairs"))
            pairs = stored_at(pairs, used[-1])
            associated = association(_counted(pairs), c.tau)
        if needs_z and (z is None or z_size != len(numbers) or batch % max(1, c.recompute_every) == 0):
            edges = edge_weights(associated, c.alpha)
            known = sorted(numbers)
            raw = _solved(edges, [numbers[t] for t in known])

            def placed(values: np.ndarray, known=known) -> DataFrame:
                return spark.createDataFrame(pa.table({"token": pa.array([numbers[t] for t in known], pa.int32()), "z": pa.array(values, pa.float32())}))

            sigma = c.sigma * c.sigma_mult if c.sigma > 0 else auto_sigma(edges, placed(raw), c.sigma, c.sigma_mult).first()[0]
            coordinate = raw[np.random.default_rng(c.shuffle_seed).permutation(len(raw))] if c.method == "spectral_shuffled" else raw
            z, z_size = placed(coordinate), len(numbers)
            if snapshot is None:
                snapshot = spark.createDataFrame(pa.table({"token": known, "id": pa.array(range(len(known)), pa.int64()), "z": pa.array(coordinate, pa.float32())}))
            at = dict(zip(known, coordinate, strict=True))
        picks = conflict_free(score(pairs, c.method, c.tau, c.alpha, z, sigma, c.gamma, associated), c.batch_size)
        if not picks:
            break
        made: list[tuple[int, int, int]] = []
        for p in picks:
            a, b = names[p.a], names[p.b]
            merges.append((a, b))
            gap = float(abs(at[a] - at[b])) if a in at and b in at else None
            rows.append((len(merges), a, b, a + b, p.score, batch, gap))
            new = numbers.setdefault(a + b, MERGED + len(merges))
            names[new] = a + b
            made.append((p.a, p.b, new))
        place = new_path(spark, "words")
        now = next_segments(now, made, place)
        for path in used:
            drop(spark, path)
        batch += 1
    log = spark.createDataFrame(rows, "step int, a string, b string, new_token string, score double, batch_id int, z_dist double")
    both = c.stem_chars is not None and c.suffix_chars is not None
    cross = token_domain(F.col("new_token"), c.stem_chars, c.suffix_chars) == 3 if both else F.lit(None).cast("boolean")
    log = log.withColumn("is_cross_boundary", cross).select("step", "a", "b", "new_token", "score", "batch_id", "is_cross_boundary", "z_dist")
    return Trained(c.method, merges, log, sorted(numbers), segmented_words(now, names), snapshot, sigma, c)
