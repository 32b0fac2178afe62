"""Column helpers shared by the text operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASCII_SPACE = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else.

    ``lower`` does exactly that when every character is one byte long, and is
    far cheaper than ``translate``, which then sees the other texts only.
    """
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def ascii_strip(text: Column) -> Column:
    """Drop the six ASCII white-space characters at both ends."""
    return F.trim(text, F.lit(ASCII_SPACE))


def unused_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores added as keep it from a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
