"""Expression building blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it in `body`, inside one expression."""
    return F.transform(F.array(value), body)[0]


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters do not repeat.

    The optimiser pushes a filter below a projection by copying the expression it reads, which
    would run a whole rule pack twice. A filter on a generator's output stays above it, and an
    outer generator gets no inferred filter of its own.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def sql_str(value: str) -> str:
    """A string as a Spark SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
