"""One coordinate for each token from the association graph, its spread, and its permuted control."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-7
STEPS, CLOSE = 1000, 1e-10  # of the iteration at most, and the residual at which it ends


def _components(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each node can reach."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _largest(i: np.ndarray, j: np.ndarray, s: np.ndarray, n: int, known: np.ndarray) -> tuple[float, np.ndarray]:
    """The largest eigenpair of I + S orthogonal to the columns of known: Lanczos with full reorthogonalisation."""
    q = np.random.default_rng(0).standard_normal(n)
    q -= known @ (known.T @ q)
    basis, a, b = np.empty((n, min(n, STEPS)), order="F"), [], []
    basis[:, 0] = q / np.linalg.norm(q)
    for step in range(basis.shape[1]):
        own = basis[:, : step + 1]
        v = own[:, -1] + np.bincount(i, s * own[j, -1], n)
        a.append(v @ own[:, -1])
        for _ in range(2):
            v -= known @ (known.T @ v)
            v -= own @ (own.T @ v)
        size = np.linalg.norm(v)
        last = size < CLOSE or step + 1 == basis.shape[1]
        if last or step % 20 == 19:
            values, vectors = np.linalg.eigh(np.diag(a) + np.diag(b, 1) + np.diag(b, -1))
            if last or size * abs(vectors[-1, -1]) < CLOSE:
                return float(values[-1]), own @ vectors[:, -1]
        b.append(size)
        basis[:, step + 1] = v / size
    raise AssertionError  # the last step returns


def _coordinate(i: np.ndarray, j: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Of the three smallest eigenvalues of the normalised Laplacian of a symmetric matrix, the vector of the first above TOLERANCE.

    Each component of the graph has an eigenvalue of 0, whose vector is known and taken out beforehand. If the three
    are all 0, any vector of that space will do: that of the second component is taken.
    """
    degree = np.maximum(np.bincount(i, w, n), 1e-9)
    label = _components(i, j, n)
    of = np.unique(label[i])
    known = np.sqrt(degree)[:, None] * (label[:, None] == of[None, :3])
    known /= np.linalg.norm(known, axis=0)
    s = w / np.sqrt(degree[i] * degree[j])
    while known.shape[1] < min(3, n - 1):
        value, vector = _largest(i, j, s, n, known)
        if 2 - value > TOLERANCE:
            return vector
        known = np.column_stack([known, vector])
    return known[:, min(1, known.shape[1] - 1)]


def coordinates(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Standardised eigenvector of the first eigenvalue above TOLERANCE, as 32-bit floats; zeros for tiny graphs."""
    if n <= 2 or not len(w):
        return np.zeros(n, np.float32)
    z = _coordinate(i, j, w, n)
    return ((z - z.mean()) / (z.std() + 1e-9)).astype(np.float32)


def embedding(affinity: DataFrame, tokens: DataFrame) -> DataFrame:
    """token, id, z (FLOAT). affinity: a, b, w, symmetric; tokens: token, id (from 0).

    The graph has a vocabulary's size, so one task decomposes it.
    """
    ids = tokens.select("token", "id")
    edges = affinity.join(ids.select(F.col("token").alias("a"), F.col("id").alias("i")), "a").join(ids.select(F.col("token").alias("b"), F.col("id").alias("j")), "b")
    rows = edges.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "w", F.lit(None).cast("string").alias("token")).unionByName(
        ids.select(F.col("id").cast("long").alias("i"), F.lit(-1).cast("long").alias("j"), F.lit(0.0).alias("w"), "token")
    )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        if not t.num_rows:
            return
        i, j, w = (t[c].to_numpy() for c in ("i", "j", "w"))
        names = j < 0
        order = np.argsort(i[names])
        words = np.array(t["token"].to_pylist(), object)[names][order]
        edge = np.lexsort((j[~names], i[~names]))
        z = coordinates(len(words), i[~names][edge], j[~names][edge], w[~names][edge])
        yield pa.record_batch({"token": pa.array(words, pa.string()), "id": pa.array(range(len(words)), pa.int64()), "z": pa.array(z, pa.float32())})

    return rows.coalesce(1).mapInArrow(solve, "token string, id long, z float")


def z_gap(edges: DataFrame, z: DataFrame) -> DataFrame:
    """edges (a, b, ...) with dz: the 32-bit difference of both ends, widened afterwards."""
    own = z.select(F.col("token").alias("a"), F.col("z").alias("z_a"))
    other = z.select(F.col("token").alias("b"), F.col("z").alias("z_b"))
    own, other = F.broadcast(own), F.broadcast(other)  # a vocabulary each
    return edges.join(own, "a").join(other, "b").withColumn("dz", (F.col("z_a") - F.col("z_b")).cast("double")).drop("z_a", "z_b")


def auto_sigma(edges: DataFrame, z: DataFrame, sigma: float = 0.0, multiplier: float = 1.0) -> DataFrame:
    """sigma: as given, or the exact median of |dz| over the edges; times the multiplier."""
    if sigma > 0:
        return edges.sparkSession.range(1).select(F.lit(sigma * multiplier).alias("sigma"))
    return z_gap(edges, z).agg((F.coalesce(F.percentile(F.abs("dz"), 0.5) + 1e-6, F.lit(1.0)) * multiplier).alias("sigma"))


def permuted(z: DataFrame, seed: int) -> DataFrame:
    """z with its values dealt anew by a seeded permutation of the ids: the control without structure.

    A permutation of a vocabulary is drawn on the driver.
    """
    n = z.count()
    deal = np.random.default_rng(seed).permutation(n)
    table = z.sparkSession.createDataFrame([(i, int(s)) for i, s in enumerate(deal)], "id long, source long")
    return z.select("token", "id").join(table, "id").join(z.select(F.col("id").alias("source"), "z"), "source").select("token", "id", "z")
