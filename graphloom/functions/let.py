"""Binding a value once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once. Columns built in one projection and used in the lambda of
    the next are inlined by the optimizer and then evaluated for every element; a lambda's variable is not."""
    return F.transform(F.array(value), body)[0]
