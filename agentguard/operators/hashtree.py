"""Which key ranges of a table changed, found by walking down a hash tree.

Leaves are ranges of `width` keys, at the same places in every table, so rows that come or go move no other leaf. A node
holds the number of its rows and eight sums of the parts of their keyed digests; a parent is the sum of its FANOUT
children, so each level is an aggregate of the one below. Two trees are compared from the top, and only the children of nodes
that differ are looked at: for a change in n rows, FANOUT nodes on each of log n levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentguard.operators.audit import row_digest
from agentguard.session import staged

FANOUT_BITS = 4
_SUMS = [f"s{k}" for k in range(8)]


def digest_tree(df: DataFrame, key: str, columns, width: int, secret: str = "") -> list[DataFrame]:
    """Levels of the tree, leaves first, each a staged table (node, rows, s0 to s7); the last has node 0, and -1 where keys are negative.

    `key` is a whole number; rows without one are under node NULL of each level.
    """
    digest = row_digest(columns, secret)
    parts = [F.conv(F.substring("__h", 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)") for k in range(8)]
    rows = df.select(F.floor(F.col(key) / width).alias("node"), digest.alias("__h"))
    leaves = rows.groupBy("node").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(p).cast("decimal(38,0)").alias(s) for p, s in zip(parts, _SUMS, strict=True)])
    levels = [staged(leaves, "tree-0")]
    # Shifting ends at 0, or at -1 for keys below zero.
    while not levels[-1].where("node NOT IN (-1, 0)").isEmpty():
        up = levels[-1].groupBy(F.shiftright("node", FANOUT_BITS).alias("node")).agg(
            F.sum("rows").alias("rows"), *[F.sum(s).cast("decimal(38,0)").alias(s) for s in _SUMS])
        levels.append(staged(up, f"tree-{len(levels)}"))
    return levels


def _differing(old: DataFrame, new: DataFrame) -> DataFrame:
    """(node, rows_before, rows_after) of nodes whose sums differ, or that one side lacks."""
    a = old.withColumnsRenamed({c: f"old_{c}" for c in old.columns})
    same = [F.col(f"old_{s}").eqNullSafe(F.col(s)) for s in ["rows", *_SUMS]]
    joined = a.join(new, F.col("old_node").eqNullSafe(F.col("node")), "full_outer")
    equal = F.coalesce(same[0], F.lit(False))
    for s in same[1:]:
        equal = equal & s
    return joined.where(~equal).select(
        F.coalesce("node", "old_node").alias("node"), F.coalesce("old_rows", F.lit(0)).alias("rows_before"), F.coalesce("rows", F.lit(0)).alias("rows_after"))


def digest_locate(stored: list[DataFrame], current: list[DataFrame], width: int, looked_at: list[int] | None = None) -> DataFrame:
    """(low, high, rows_before, rows_after): ranges [low, high) of keys whose rows differ; low and high are NULL for rows without a key.

    The taller tree begins at the height of the other, as a table that grew has further levels above. `looked_at` takes the number of
    nodes that were compared on each level, leaves last.
    """
    height = min(len(stored), len(current))
    found = None
    for level in range(height - 1, -1, -1):
        old, new = stored[level], current[level]
        if found is not None:
            below = F.shiftright("node", FANOUT_BITS).eqNullSafe(F.col("up"))
            old, new = (side.join(found, below, "left_semi") for side in (old, new))
        if looked_at is not None:
            looked_at.append(old.count() + new.count())
        differing = _differing(old, new)
        if level:
            found = staged(differing.select(F.col("node").alias("up")), "tree-differing")
    return differing.select((F.col("node") * width).alias("low"), ((F.col("node") + 1) * width).alias("high"), "rows_before", "rows_after")
