"""Ordered operators that stay parallel when one key holds much of the data.

A plain window sends all rows of a key to one task. Here the rows of all keys are sorted by range into pieces of about
PIECE_ROWS rows, wherever a key begins or ends. Each piece is worked on alone, and what has to cross into the
next is carried in one row per piece, or per key and piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentguard.functions.expr import let
from agentguard.session import staged

SLICES_PER_WINDOW = 16
PIECE_ROWS = 100_000
#: Cells of intervals: 2**UNIT_BITS microseconds at level 0, four times as long at each further level.
UNIT_BITS, LEVELS = 20, 22


def micros(ts: Column) -> Column:
    """Event time in microseconds."""
    return F.unix_micros(ts.cast("timestamp"))


def trailing(df: DataFrame, keys, us: str, window_us: int, aggs: dict[str, Column], strict: bool = True) -> DataFrame:
    """Aggregates over the last `window_us` of a key, the current row and its peers included.

    `strict` leaves out a row exactly `window_us` old. Keys are cut into time slices of
    sixteen windows; the rows of a slice's last window are copied into the next slice.
    """
    length = window_us * SLICES_PER_WINDOW
    slice_no = F.floor(F.col(us) / length)
    late = F.pmod(F.col(us), F.lit(length)) >= length - window_us
    cut = df.withColumn("__own", slice_no).withColumn(
        "__slice", F.explode(F.when(late, F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own"))))
    span = window_us - 1 if strict else window_us
    w = Window.partitionBy(*keys, "__slice").orderBy(us).rangeBetween(-span, 0)
    out = cut.withColumns({name: agg.over(w) for name, agg in aggs.items()})
    return out.filter("__own = __slice").drop("__own", "__slice")


def in_pieces(df: DataFrame, order, label: str) -> DataFrame:
    """The rows with `__piece`, numbers of ranges of `order` that ascend with it. Rows that are equal in `order` share a piece."""
    rows = staged(df, label)
    pieces = -(-rows.count() // PIECE_ROWS)
    if pieces <= 1:
        return rows.withColumn("__piece", F.lit(0))
    return staged(rows.repartitionByRange(pieces, *order).withColumn("__piece", F.spark_partition_id()), label + "-pieces")


def _carried(pieces: DataFrame, keys, order, value: str, total, strict: bool) -> DataFrame:
    """Add `__inside` (aggregate of the key's earlier rows in the piece; with `strict` without the row itself) and `__carry` (that of its earlier pieces)."""
    to = -1 if strict else 0
    inside = Window.partitionBy("__piece", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, to)
    before = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    ends = pieces.groupBy("__piece", *keys).agg(total(value).alias("__end")).withColumn("__carry", total("__end").over(before)).drop("__end")
    ends = ends.withColumnsRenamed({k: f"__k_{k}" for k in ["__piece", *keys]})
    same = [pieces[k].eqNullSafe(ends[f"__k_{k}"]) for k in ["__piece", *keys]]
    return pieces.withColumn("__inside", total(value).over(inside)).join(ends, same).drop(*[f"__k_{k}" for k in ["__piece", *keys]])


def running_total(pieces: DataFrame, order, value: str, out: str) -> DataFrame:
    """Sum of `value` over all rows of all keys up to and including each row of `in_pieces`."""
    inside = Window.partitionBy("__piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    ends = pieces.groupBy("__piece").agg(F.sum(value).alias("__end")).withColumn(
        "__carry", F.coalesce(F.sum("__end").over(before), F.lit(0))).drop("__end")
    return pieces.withColumn(out, F.sum(value).over(inside)).join(ends, "__piece").withColumn(out, F.col(out) + F.col("__carry")).drop("__carry")


def trailing_count(df: DataFrame, keys, us: str, window_us: int, out: str, strict: bool = True) -> DataFrame:
    """Number of rows of the same key in the last `window_us`, the row and its peers included, by two prefix ranks.

    The rank of a moment is the number of rows up to it. Each distinct time of a key asks for its own rank and for that of the
    moment where its window begins; rows and questions are sorted together, and the difference of the two ranks is the
    count. `strict` leaves out a row exactly `window_us` old. Rows without a time get NULL.
    """
    times = staged(df.where(F.col(us).isNotNull()).groupBy(*keys, F.col(us).alias("__t")).agg(F.count(F.lit(1)).alias("__n")), "times")
    own = times.select(*keys, "__t", F.lit(0).alias("__kind"), "__n", F.col("__t").alias("__of"))
    asked = times.select(*keys, (F.col("__t") - window_us).alias("__t"), F.lit(1 if strict else -1).alias("__kind"), F.lit(0).cast("bigint").alias("__n"), F.col("__t").alias("__of"))
    order = [*keys, "__t", "__kind"]
    ranked = running_total(in_pieces(own.unionByName(asked), order, "ranks"), order, "__n", "__rank")
    counts = ranked.groupBy(*keys, "__of").agg(
        (F.max(F.when(F.col("__kind") == 0, F.col("__rank"))) - F.max(F.when(F.col("__kind") != 0, F.col("__rank")))).alias(out))
    counts = counts.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    same = [df[k].eqNullSafe(counts[f"__k_{k}"]) for k in keys]
    return df.join(counts, [*same, df[us] == counts["__of"]], "left").drop("__of", *[f"__k_{k}" for k in keys])


def running_sum(df: DataFrame, keys, us: str, ties, value: str, out: str) -> DataFrame:
    """Sum of `value` over a key up to and including each row, in order of (`us`, `ties`), which tell its rows apart."""
    order = [us, *ties]
    rows = _carried(in_pieces(df, [*keys, *order], "sums"), keys, order, value, F.sum, strict=False)
    return rows.withColumn(out, F.coalesce("__carry", F.lit(0)) + F.col("__inside")).drop("__piece", "__inside", "__carry")


def previous(df: DataFrame, keys, us: str, ties, value: str, out: str, slice_us: int) -> DataFrame:
    """Value of the row before, in order of (`us`, `ties`); NULL for a key's first row.

    Rows look back inside their time slice; the first row of a slice takes the last value of
    the slice before, found from one row per slice.
    """
    cut = df.withColumn("__slice", F.floor(F.col(us) / slice_us))
    last = cut.groupBy(*keys, "__slice").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(us, *ties)).alias("__l"))
    over = Window.partitionBy(*keys).orderBy("__slice")
    last = last.withColumn("__before", F.lag("__l").over(over)).drop("__l")
    inside = F.lag(F.struct(F.col(value).alias("v"))).over(Window.partitionBy(*keys, "__slice").orderBy(us, *ties))
    rows = cut.withColumn("__in", inside).join(last, [*keys, "__slice"])
    return rows.withColumn(out, F.coalesce("__in", "__before")["v"]).drop("__slice", "__in", "__before")


def merge_intervals(df: DataFrame, keys, start_us: str, end_us: str) -> DataFrame:
    """Overlapping or touching intervals of a key become one: (keys, start_us, end_us, merged).

    An interval begins a new one where no earlier start of its key reaches it. The furthest end so far is a running maximum:
    inside a piece, and over the maxima of the pieces before. Intervals may have any length.
    """
    rows = df.select(*keys, F.col(start_us).alias("__s"), F.col(end_us).alias("__e")).groupBy(*keys, "__s").agg(
        F.max("__e").alias("__e"), F.count("*").alias("__n"))
    reach = _carried(in_pieces(rows, [*keys, "__s"], "intervals"), keys, ["__s"], "__e", F.max, strict=True)
    begins = F.when(F.greatest("__inside", "__carry") >= F.col("__s"), 0).otherwise(1)
    flagged = staged(reach.withColumn("__new", begins).drop("__inside", "__carry"), "intervals-flagged")
    islands = running_total(flagged, [*keys, "__s"], "__new", "__island")
    return islands.groupBy(*keys, "__island").agg(
        F.min("__s").alias("start_us"), F.max("__e").alias("end_us"), F.sum("__n").alias("merged")).drop("__island")


def active_at(intervals: DataFrame, at_us: int, start_us: str = "start_us", end_us: str = "end_us") -> DataFrame:
    """The intervals [start, end) that hold a moment; a filter that reaches the scan."""
    return intervals.filter((F.col(start_us) <= at_us) & (F.col(end_us) > at_us))


def cells_of(start: Column, end: Column) -> Column:
    """Disjoint aligned cells (level, cell) that cover [start, end) in microseconds: at most six a level, 78 for a year."""

    def step(acc: Column, level: Column) -> Column:
        low, high = acc["low"], acc["high"]
        up, down = F.shiftleft(F.shiftright(low + 3, 2), 2), F.shiftleft(F.shiftright(high, 2), 2)
        last = (up >= down) | (level == LEVELS - 1)
        candidates = lambda first: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: first + i)
        head = F.filter(candidates(low), lambda c: c < F.when(last, high).otherwise(up))
        tail = F.filter(candidates(down), lambda c: ~last & (c < high))
        cell = lambda c: F.struct(level.cast("int").alias("level"), c.alias("cell"))
        return F.struct(
            F.when(last, high).otherwise(F.shiftright(up, 2)).alias("low"), F.when(last, high).otherwise(F.shiftright(down, 2)).alias("high"),
            F.concat(acc["cells"], F.transform(F.concat(head, tail), cell)).alias("cells"))

    first, past = F.shiftright(start, UNIT_BITS), F.shiftright(end - 1, UNIT_BITS) + 1
    begin = F.struct(first.alias("low"), past.alias("high"), F.array().cast("array<struct<level:int,cell:bigint>>").alias("cells"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), begin, step, lambda acc: acc["cells"])


def join_cells_of(start: Column, end: Column) -> Column:
    """One to four neighbouring cells of one level, the lowest at which so few cover [start, end); none for an empty interval.

    They reach beyond the interval by less than a cell on each side. Intervals of like lengths share a level or two.
    """
    bounds = F.struct(start.cast("bigint").alias("s"), (end.cast("bigint") - 1).alias("e"))

    def covered(b: Column) -> Column:
        at = lambda us, level: F.shiftright(us, UNIT_BITS + 2 * level)
        cells = lambda level: F.transform(F.sequence(at(b["s"], level), at(b["e"], level)), lambda c: F.struct(F.lit(level).alias("level"), c.alias("cell")))
        out = cells(LEVELS - 1)
        for level in reversed(range(LEVELS - 1)):
            out = F.when(at(b["e"], level) - at(b["s"], level) < 4, cells(level)).otherwise(out)
        return F.when(b["e"] >= b["s"], out)

    return let(bounds, covered)


def interval_join(points: DataFrame, intervals: DataFrame, keys, us: str, start_us: str, end_us: str, how: str = "left") -> DataFrame:
    """Points joined to the intervals [start, end) that hold them, by key and cell; `how` is left or inner.

    An interval becomes at most four cells of one level, however long it is, and a point one cell for each level
    that occurs: exactly one of an interval's cells can hold it. The times themselves decide at the ends.
    """
    cells = intervals.withColumnsRenamed({k: f"__r_{k}" for k in keys}).withColumn("__c", F.explode(join_cells_of(F.col(start_us), F.col(end_us))))
    cells = staged(cells.select("*", F.col("__c.level").alias("__r_level"), F.col("__c.cell").alias("__r_cell")).drop("__c"), "interval-cells")
    levels = sorted(r[0] for r in cells.select("__r_level").distinct().collect())
    at = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(us, UNIT_BITS + 2 * k).alias("cell")) for k in levels])
    cut = points.withColumn("__c", F.explode(at.cast("array<struct<level:int,cell:bigint>>"))).select(
        "*", F.col("__c.level").alias("__level"), F.col("__c.cell").alias("__cell")).drop("__c")
    same = [F.col(k) == F.col(f"__r_{k}") for k in keys]
    held = [F.col("__level") == F.col("__r_level"), F.col("__cell") == F.col("__r_cell"), F.col(us) >= F.col(start_us), F.col(us) < F.col(end_us)]
    met = cut.join(cells, [*same, *held]).drop("__level", "__cell", "__r_level", "__r_cell", *[f"__r_{k}" for k in keys])
    if how == "inner":
        return met
    found = met.select(*[F.col(k).alias(f"__r_{k}") for k in keys], F.col(us).alias("__r_us")).distinct()
    alone = points.join(found, [*same, F.col(us) == F.col("__r_us")], "left_anti")
    return met.unionByName(alone, allowMissingColumns=True)
