"""Encoding of a stream of texts: stateless, so the batch expressions work unchanged."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import MARK, text_words
from ..operators.encoding import encode_word, ranks_of


def encode_stream(texts: DataFrame, merges: Sequence[tuple[str, str]]) -> DataFrame:
    """texts (streaming or not) with tokens, the pieces of text in order. Rows keep their order and columns; no state is held."""
    sent = texts.sparkSession.sparkContext.broadcast(ranks_of(merges))

    def run(column: pa.Array) -> pa.Array:
        memo: dict[str, list[str]] = {}
        out = []
        for words in column.to_pylist():
            pieces: list[str] = []
            for w in words or []:
                if w not in memo:
                    memo[w] = encode_word(MARK + w, sent.value)
                pieces += memo[w]
            out.append(pieces)
        return pa.array(out, pa.list_(pa.string()))

    return texts.withColumn("tokens", F.arrow_udf(run, "array<string>")(text_words(F.col("text"))))
