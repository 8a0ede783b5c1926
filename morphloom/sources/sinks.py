"""Results as JSON and as a text table."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_sorted_json(df: DataFrame, column: str = "json") -> DataFrame:
    """Each row as one JSON string with its keys in alphabetical order; nulls are kept."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias(column))


def json_document(results: Mapping) -> str:
    return json.dumps(results, indent=2, sort_keys=True)


def text_table(columns: Sequence[str], rows: Sequence[Sequence]) -> str:
    """Left-justified columns as wide as their longest cell, divided by bars."""
    cells = [list(map(str, columns)), *([str(x) for x in r] for r in rows)]
    width = [max(len(r[i]) for r in cells) for i in range(len(columns))]
    lines = [" | ".join(x.ljust(w) for x, w in zip(r, width, strict=True)) for r in cells]
    return "\n".join([lines[0], "-+-".join("-" * w for w in width), *lines[1:]])
