"""Listings of audit and fleet tables: a time range newest first, the rows of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_range(df: DataFrame, time: str, since=None, until=None) -> DataFrame:
    """Rows with since <= time < until; plain comparisons, which reach the scan."""
    out = df
    if since is not None:
        out = out.filter(F.col(time) >= F.lit(since).cast("timestamp"))
    if until is not None:
        out = out.filter(F.col(time) < F.lit(until).cast("timestamp"))
    return out


def newest(df: DataFrame, time: str, tie: str, since=None, until=None, limit: int | None = None) -> DataFrame:
    """Rows of a range, newest first: a top-k where a limit is asked for, else one range sort."""
    ordered = in_range(df, time, since, until).orderBy(F.col(time).desc(), F.col(tie).desc())
    return ordered.limit(limit) if limit else ordered


def of_group(df: DataFrame, **equal) -> DataFrame:
    """Rows whose columns have the given values: agents, versions, keys, releases or tokens of a group."""
    out = df
    for column, value in equal.items():
        out = out.filter(F.col(column) == value)
    return out


def sessions(decisions: DataFrame, since=None, until=None) -> DataFrame:
    """(session_id, first_at, last_at, decisions, denied) of the sessions with a decision in the range."""
    return in_range(decisions, "timestamp", since, until).groupBy("session_id").agg(
        F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"), F.count("*").alias("decisions"),
        F.count_if(F.col("decision") == "deny").alias("denied"))
