"""Interval joins: few cells for a point, whatever the intervals' places."""

import random

from pyspark.sql import functions as F

from agentguard.operators import ordered

SECOND = 1_000_000


def test_intervals_of_like_lengths_share_a_level(spark):
    """A point is sent once per level that occurs, so intervals of five minutes anywhere must not occur at many."""
    rng = random.Random(5)
    rows = []
    for length in (1, 300 * SECOND, 300 * SECOND, 86_400 * SECOND, 366 * 86_400 * SECOND):
        for _ in range(200):
            start = rng.randrange(-10**15, 2 * 10**15)
            rows.append((start, start + length))
    rows += [(5, 5), (9, 2)]
    cells = spark.createDataFrame(rows, "s long, e long").withColumn("c", ordered.join_cells_of(F.col("s"), F.col("e"))).collect()
    levels = {}
    for s, e, found in cells:
        if e <= s:
            assert not found
            continue
        assert 1 <= len(found) <= 4 and len({c.level for c in found}) == 1
        size = 1 << (ordered.UNIT_BITS + 2 * found[0].level)
        assert found[0].cell * size <= s < (found[0].cell + 1) * size and found[-1].cell * size < e <= (found[-1].cell + 1) * size
        assert [c.cell for c in found] == list(range(found[0].cell, found[0].cell + len(found)))
        levels.setdefault(e - s, set()).add(found[0].level)
    assert all(len(found) <= 2 for found in levels.values())
