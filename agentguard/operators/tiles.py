"""Counters kept as tiles: hourly partial aggregates that add up to those of any window.

A batch of decisions becomes one row per hour and kind of decision. Tiles are written under the number of their batch, so a batch
that is written again replaces itself. A window is answered from the tiles of its whole hours and from the
raw rows of the two hours that it cuts, which a filter on time finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
#: Kinds of decisions that are counted apart.
KINDS = ("decision", "stage", "scanner_type", "tool")
SUMS = ("decisions", "timeouts", "redacted", "upstream_errors", "received", "sent", "actions")


def counted(decisions: DataFrame, time: str = "timestamp") -> DataFrame:
    """Rows (KINDS, us, SUMS): what each decision adds to the counters.

    `upstream_error`, `layer_received`, `layer_sent` and `adaptive_action` are boolean columns where they are known.
    """
    reason = F.col("reason")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("bigint") if c in decisions.columns else F.lit(0).cast("bigint")
    parts = (F.lit(1).cast("bigint"), F.contains(reason, F.lit("timeout")).cast("bigint"), F.startswith(reason, F.lit("response redacted")).cast("bigint"),
             flag("upstream_error"), flag("layer_received"), flag("layer_sent"), flag("adaptive_action"))
    kinds = [F.coalesce(F.col(k), F.lit("")).alias(k) for k in KINDS]
    return decisions.select(*kinds, F.unix_micros(F.col(time).cast("timestamp")).alias("us"), *[p.alias(s) for p, s in zip(parts, SUMS, strict=True)])


def tiles_of(rows: DataFrame) -> DataFrame:
    """(hour, KINDS, SUMS) of `counted` rows; rows without a time belong to no hour."""
    hour = F.floor(F.col("us") / HOUR_US)
    return rows.where("us IS NOT NULL").groupBy(hour.alias("hour"), *KINDS).agg(*[F.sum(s).alias(s) for s in SUMS])


def write_tiles(decisions: DataFrame, path: str, batch: int, time: str = "timestamp") -> None:
    """Write the tiles of a batch; once more under the same number replaces them."""
    tiles_of(counted(decisions, time)).write.mode("overwrite").parquet(f"{path}/batch={int(batch)}")


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def window_counts(tiles: DataFrame, decisions: DataFrame, start_us: int, end_us: int, time: str = "timestamp") -> DataFrame:
    """(KINDS, SUMS) over start <= time < end, equal to an aggregate of all rows in it.

    `decisions` are read for the cut hours at both ends only.
    """
    first, past = -(-start_us // HOUR_US), end_us // HOUR_US
    at = lambda us: F.timestamp_micros(F.lit(us))
    if first > past:  # inside one hour
        edges = (F.col(time) >= at(start_us)) & (F.col(time) < at(end_us))
    else:
        edges = (F.col(time) >= at(start_us)) & (F.col(time) < at(first * HOUR_US)) | (F.col(time) >= at(past * HOUR_US)) & (F.col(time) < at(end_us))
    whole = tiles.where(F.col("hour").between(first, past - 1)).select(*KINDS, *SUMS)
    cut = counted(decisions.where(edges), time).select(*KINDS, *SUMS)
    return whole.unionByName(cut).groupBy(*KINDS).agg(*[F.sum(s).alias(s) for s in SUMS])


def summary(counts: DataFrame) -> DataFrame:
    """(metric, value) of the counters over `window_counts`."""
    n, denied = F.col("decisions"), F.col("decision") == "deny"
    of = lambda cond: F.sum(F.when(cond, n).otherwise(0))
    answers = F.startswith("stage", F.lit("response"))
    metrics: dict[str, Column] = {
        "requests": F.sum(n), "allowed": of(F.col("decision") == "allow"), "denied": of(denied), "redacted": F.sum("redacted"), "timeouts": F.sum("timeouts"),
        "responses": of(answers), "responses_blocked": of(answers & denied), "upstream_errors": F.sum("upstream_errors"),
        "crosslayer_received": F.sum("received"), "crosslayer_sent": F.sum("sent"), "adaptive_actions": F.sum("actions")}
    one = counts.agg(*[F.coalesce(c, F.lit(0)).cast("bigint").alias(k) for k, c in metrics.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in metrics])).alias("m")).select("m.*")
