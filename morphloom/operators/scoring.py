"""Scores of candidate merges, their order, and the choice of a batch without conflicts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bigrams import ppmi
from .spectral import z_gap

METHODS = ("freq", "pmi_only", "ppmi_discounted", "spectral", "spectral_shuffled")


@dataclass(frozen=True)
class Pick:
    a: str
    b: str
    score: float

    @property
    def token(self) -> str:
        return self.a + self.b


def score(pairs: DataFrame, method: str, tau: int = 2, alpha: float = 0.0, z: DataFrame | None = None, sigma: DataFrame | float | None = None, gamma: float = 1.0, associated: DataFrame | None = None) -> DataFrame:
    """a, b, score, first_seen of the pairs with a positive score.

    z and sigma (a number, or a one-row frame) are for the spectral methods; associated saves computing PPMI again.
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    if method == "freq":
        return pairs.select("a", "b", F.col("n").cast("double").alias("score"), "first_seen").where("score > 0")
    known = ppmi(pairs, tau) if associated is None else associated
    discounted = F.col("ppmi") * F.col("n") * F.pow(F.col("n").cast("double"), F.lit(alpha))
    if method == "pmi_only":
        out = known.withColumn("score", F.col("ppmi"))
    elif method == "ppmi_discounted":
        out = known.withColumn("score", discounted)
    else:
        gaps = z_gap(known, z)
        gaps = gaps.join(F.broadcast(sigma)) if isinstance(sigma, DataFrame) else gaps.withColumn("sigma", F.lit(sigma))
        coherence = F.exp(-gamma * F.col("dz") * F.col("dz") / (2.0 * F.col("sigma") * F.col("sigma")))
        out = gaps.withColumn("score", discounted * coherence)
    return out.select("a", "b", "score", "first_seen").where("score > 0")


def conflict_free(scored: DataFrame, k: int) -> list[Pick]:
    """The first k pairs by falling score (ties: first seen first) of which no two share a symbol.

    A greedy choice depends on what comes before only, so it reads growing heads of the order: a distributed top-n,
    not the whole table. In the usual case the first head suffices. Give it a stored table: each head reads it anew.
    """
    size = max(8192, 16 * k)
    while True:
        head = scored.orderBy(F.desc("score"), "first_seen").limit(size).select("a", "b", "score").collect()
        used: set[str] = set()
        out: list[Pick] = []
        for a, b, s in head:
            if len(out) == k:
                break
            if a not in used and b not in used:
                used |= {a, b}
                out.append(Pick(a, b, s))
        if len(out) == k or len(head) < size:
            return out
        size *= 8
