"""Quality classifier: hashed word n-gram logistic regression by FTRL, scored as sparse dot products.

Training takes at most ``PER_LABEL`` labelled rows of each quality (the bound of the sample), those with the
smallest hash of their doc_id, weighted back to the labels' true proportions. Their n-grams are hashed on the
executors; one task runs the updates over them in hash order. Every whole text is then scored where it lies: no
shuffle, and only the weights (1 MB) travel.

Word n-grams come in two forms, of the words and of their shapes (kinds of first and last bytes, and whether a word
repeats the one before), so that words never seen in training still tell something.

Edge cases: null and empty texts have no n-grams and get the score of the bias alone. doc_id null is never held out
and never learned from. Labels other than 0 and 1 are ignored; of several labels for a doc_id the smallest holds; of
several texts for one the smallest is learned from. Without labelled rows every score is 0.5. Repeated rows are
scored each. Other columns of the documents are kept; score, held_out and predicted are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .linear_text import Features, Model, calibrate, train_ftrl
from .scratch import bounded_batches

PER_LABEL = 4096
KEEP_AT = 0.3
FEATURES = Features(words=(1, 2), shapes=(1, 2))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; null for null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, per_label: int = PER_LABEL) -> DataFrame:
    """doc_id, text, y, importance, turn (the order of learning) of at most 2 * per_label rows."""
    lab = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("y")).where(usable)
    turn = F.xxhash64(F.lit(11), "doc_id")
    picks = [lab.where(F.col("y") == y).withColumn("turn", turn).orderBy("turn", "doc_id").limit(per_label) for y in (0, 1)]
    total = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count("*").alias("n")).collect()}
    weight = {y: n / min(n, per_label) for y, n in total.items()}
    mean = sum(total.values()) / max(1, sum(min(n, per_label) for n in total.values()))
    importance = F.when(F.col("y") == 0, weight.get(0, 1.0) / mean if total else 1.0).otherwise(weight.get(1, 1.0) / mean if total else 1.0)
    few = picks[0].unionByName(picks[1]).withColumn("importance", importance)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), *(F.first(c).alias(c) for c in ("y", "importance", "turn")))


def fit(sample: DataFrame, features: Features, calibration: Column | None = None, epochs: int = 4) -> Model:
    """Train on the rows of ``labelled_sample``; those for which ``calibration`` holds only set slope and shift."""
    bounded_batches(sample.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features.sparse(t) for t in b.column("text").to_pylist()]
            yield pa.record_batch(
                {"slots": pa.array([i.tobytes() for i, _ in found], pa.binary()), "vals": pa.array([x.tobytes() for _, x in found], pa.binary())}
                | {c: b.column(c) for c in ("y", "importance", "turn", "doc_id", "cal")}
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def rows() -> Iterator:
            for b in batches:
                for r in b.to_pylist():
                    row = np.frombuffer(r["slots"], np.int32), np.frombuffer(r["vals"], np.float32).astype(np.float64), r["y"], r["importance"]
                    if r["cal"]:
                        held.append(row)
                    else:
                        yield row

        model = train_ftrl(rows(), features, epochs)
        if held:
            margins = np.array([float(model.weights[i] @ x) + model.bias for i, x, _, _ in held])
            calibrate(model, margins, np.array([r[2] for r in held]), np.array([r[3] for r in held]))
        yield pa.record_batch({"w": [model.weights.tobytes()], "b": [model.bias], "slope": [model.slope], "shift": [model.shift]})

    ready = sample.withColumn("cal", F.lit(False) if calibration is None else F.coalesce(calibration, F.lit(False)))
    ready = ready.mapInArrow(hashed, "slots binary, vals binary, y int, importance double, turn long, doc_id long, cal boolean")
    row = ready.repartition(1).sortWithinPartitions("turn", "doc_id").mapInArrow(learn, "w binary, b double, slope double, shift double").first()
    if row is None:  # nothing to learn from
        return Model(features, np.zeros(1 << features.bits, np.float32))
    return Model(features, np.frombuffer(bytes(row["w"]), np.float32), row["b"], row["slope"], row["shift"])


def scorer(model: Model) -> Callable[[Column], Column]:
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.probability(model.margin(t)) for t in texts.to_pylist()], pa.float64())

    return F.arrow_udf(score, "double")


def classify(docs: DataFrame, model: Model, keep_at: float = KEEP_AT) -> DataFrame:
    """docs with held_out, score and predicted."""
    bounded_batches(docs.sparkSession)
    out = docs.withColumn("score", scorer(model)(F.col("text")))
    return out.withColumns({"held_out": F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)), "predicted": F.when(F.col("score") >= keep_at, 1).otherwise(0)})


def quality_model(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(labelled_sample(docs, labels, fold(F.col("doc_id"), 5) != 0), FEATURES)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return classify(docs, quality_model(docs, labels)).select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op2_quality_classifier": op2_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
