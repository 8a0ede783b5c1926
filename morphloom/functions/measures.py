"""Column expressions that several operators share."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, with the four separators that Python's str.split also takes.
SPACE = r"(?U)[\s\x1c-\x1f]+"
MARK = "▁"  # stands before every word


def text_words(text: Column) -> Column:
    """The words of a text in order, as an array."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def token_domain(token: Column, stem_chars: str, suffix_chars: str) -> Column:
    """0 neither, 1 stem characters only, 2 suffix characters only, 3 both."""
    stem, suffix = (token.rlike(f"[{re.escape(x)}]") for x in (stem_chars, suffix_chars))
    return F.when(stem & suffix, 3).when(stem, 1).when(suffix, 2).otherwise(0)


def bits_per_byte(nats_per_token: Column, tokens: Column, n_bytes: Column) -> Column:
    return nats_per_token / F.lit(math.log(2)) * tokens / n_bytes


def bits_per_token(nats_per_token: Column) -> Column:
    return nats_per_token / F.lit(math.log(2))


def sequence_length(tokens_per_byte: Column, mode: str = "fixed", fixed: int = 128, byte_span: int = 512, least: int = 64, most: int = 256) -> Column:
    """Tokens a sequence: fixed, or as many as a span of bytes holds (rounded half to even), within bounds."""
    if mode == "fixed":
        return F.lit(fixed)
    return F.greatest(F.lit(least), F.least(F.lit(most), F.bround(tokens_per_byte * byte_span, 0).cast("int")))


def bytes_per_sequence(length: Column, tokens_per_byte: Column) -> Column:
    return length / F.greatest(F.lit(1e-9), tokens_per_byte)
