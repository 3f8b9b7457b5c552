"""Text expressions: white space, folding, names.

Everything is a JVM-side column expression. The one exception is full case folding of strings that hold
characters outside ASCII, which Spark has no expression for: those rows, and only those, pass through an
Arrow function.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as white space (the Unicode property and the four ASCII separators).
WHITE_SPACE = r"\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# Apostrophes of any shape, dropped before a name is cut into words.
APOSTROPHES = "'`´ʹʻʼʽˈˊˋ‘’‛′‵＇"

_SPACES = f"[{WHITE_SPACE}]+"
_EDGES = f"^[{WHITE_SPACE}]+|[{WHITE_SPACE}]+$"
_WORD = re.compile(r"[^\W_]+")
_DROP = {ord(c): None for c in APOSTROPHES}


def strip(c: Column) -> Column:
    """``c`` without white space of any kind at either end (Spark's trim knows only U+0020)."""
    return F.regexp_replace(c, _EDGES, "")


def collapse_space(c: Column) -> Column:
    """Runs of white space become one blank; none is left at the ends."""
    return strip(F.regexp_replace(c, _SPACES, " "))


def is_blank(c: Column) -> Column:
    """True for null and for strings of white space only."""
    return c.isNull() | (F.length(strip(c)) == 0)


def fold_words(name: str) -> list[str]:
    """The words of a name: full case folding, apostrophes dropped, runs of letters and digits."""
    return _WORD.findall(name.casefold().translate(_DROP))


@F.pandas_udf(T.StringType())
def _alike_arrow(names: pd.Series) -> pd.Series:
    return names.map(lambda s: None if s is None else " ".join(sorted(fold_words(s))))


@F.pandas_udf(T.StringType())
def _fold_arrow(names: pd.Series) -> pd.Series:
    return names.map(lambda s: None if s is None else s.casefold())


def _ascii(c: Column) -> Column:
    return c.rlike(r"^[\x00-\x7f]*$")


def casefold(c: Column) -> Column:
    """Full Unicode case folding; ASCII strings stay in the JVM."""
    return F.when(_ascii(c), F.lower(c)).otherwise(_fold_arrow(F.when(~_ascii(c), c)))


def alike_key(c: Column) -> Column:
    """Two names are alike exactly when their keys are equal: the sorted words, joined by blanks.

    Null gives null. A name without letters and digits gives the empty string.
    """
    words = F.regexp_extract_all(F.lower(F.translate(c, "'`", "")), F.lit("[a-z0-9]+"), F.lit(0))
    return F.when(_ascii(c), F.array_join(F.array_sort(words), " ")).otherwise(_alike_arrow(F.when(~_ascii(c), c)))
